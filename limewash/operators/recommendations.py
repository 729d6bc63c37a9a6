"""Recommendation tables: what to ask a model about, and what it answered.

The model itself is outside. One table holds the questions (one row per issue), another the raw
answers (one row per response); both can hold the issues of any number of data sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.functions.dates import add_dates
from limewash.functions.numbers import to_loose_number
from limewash.functions.text import quoted, trim
from limewash.operators.melting import ranked, top_values, value_frequencies
from limewash.operators.suspicious import suspicious_of
from limewash.session import materialise

# The actions a recommendation may name.
ALLOWED_ACTIONS = ("keep", "normalize_values", "coerce_type", "title_case", "flag_for_manual_review")

ITEM = (
    "struct<issue_id: string, inferred_domain: string, recommended_action: string, reasoning: string, "
    "fix_params: struct<mappings: map<string,string>, target_type: string>>"
)
SAMPLES = 4
TOP_COUNTS = 3


def parse_responses(responses: DataFrame, key: str = "response_id", text: str = "response") -> DataFrame:
    """One row per recommendation in a table of raw response texts.

    A well-formed array is taken whole; an item without an issue id rejects it. From a broken
    array every complete object with an issue id is kept. Unknown actions become a manual review.
    """
    bare = F.regexp_replace(quoted(text), "```(?:json)?", "")
    start, end = F.instr(bare, "["), F.length(bare) - F.instr(F.reverse(bare), "]") + 1
    closed = (F.instr(bare, "]") > 0) & (end > start)
    body = F.when(start > 0, F.when(closed, F.substr(bare, start, end - start + 1)).otherwise(F.substr(bare, start)))
    rest = F.when(start > 0, F.substr(bare, start))  # a broken array may end inside an inner one
    rows = responses.select(quoted(key).alias("response_id"), body.alias("body"), rest.alias("rest"))
    array = F.from_json("body", f"array<{ITEM}>", {"mode": "PERMISSIVE"})
    rows = rows.withColumn("items", array)
    # a broken array parses to null, or to a list whose last item was cut
    rows = rows.withColumn("sound", F.col("items").isNotNull() & F.col("body").isNotNull())
    salvaged = F.transform(_objects(F.col("rest")), lambda x: F.from_json(x, ITEM))
    complete = F.filter(salvaged, lambda x: x["issue_id"].isNotNull())
    whole = F.when(F.forall("items", lambda x: x["issue_id"].isNotNull()), F.col("items"))
    items = F.when(F.col("sound"), whole).otherwise(complete)
    found = rows.select("response_id", F.posexplode(items).alias("position", "item"))
    action = F.col("item.recommended_action")
    return found.select(
        "response_id",
        "position",
        F.col("item.issue_id").alias("issue_id"),
        F.when(action.isin(*ALLOWED_ACTIONS), action).otherwise("flag_for_manual_review")
        .alias("recommended_action"),
        F.coalesce("item.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("item.inferred_domain", F.lit("")).alias("inferred_domain"),
        F.col("item.fix_params").alias("fix_params"),
    )


def _objects(body: Column) -> Column:
    """The complete outermost objects of a text, whatever their depth: one walk over its characters
    that counts braces outside quoted strings."""
    begin = F.struct(
        F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("start"),
        F.array().cast("array<struct<start:int,end:int>>").alias("found"),
    )

    def walk(s, c):
        text = s["quoted"]
        up, down = ~text & (c == "{"), ~text & (c == "}") & (s["depth"] > 0)
        depth = s["depth"] + up.cast("int") - down.cast("int")
        closed = down & (depth == 0)
        quote = (c == '"') & ~s["escaped"] & (s["depth"] > 0)
        return F.struct(
            (s["at"] + 1).alias("at"), depth.alias("depth"), (text != quote).alias("quoted"),
            (text & (c == "\\") & ~s["escaped"]).alias("escaped"),
            F.when(up & (s["depth"] == 0), s["at"]).otherwise(s["start"]).alias("start"),
            F.when(closed, F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), s["at"].alias("end"))))).otherwise(s["found"]).alias("found"),
        )

    found = F.aggregate(F.split(body, ""), begin, walk, lambda s: s["found"])
    return F.transform(found, lambda s: F.substring(body, s["start"], s["end"] - s["start"] + 1))


def match_recommendations(recommendations: DataFrame, issues: DataFrame) -> DataFrame:
    """Recommendations for known issues only; for each issue the last one."""
    known = recommendations.join(issues.select(F.col("id").alias("issue_id")).distinct(), "issue_id", "left_semi")
    order = F.struct("response_id", "position")
    fields = [c for c in known.columns if c not in ("issue_id", "response_id", "position")]
    latest = known.groupBy("issue_id").agg(F.max_by(F.struct(*fields), order).alias("last"))
    return latest.select("issue_id", *[F.col(f"last.{c}").alias(c) for c in fields])


def without_recommendations(issues: DataFrame, recommendations: DataFrame) -> DataFrame:
    known = recommendations.select(F.col("issue_id").alias("id"))
    return issues.join(known, "id", "left_anti")


def drop_identity_mappings(mappings: Column) -> Column:
    """Mappings that change a value, a mapping to null included."""
    return F.map_filter(mappings, lambda k, v: v.isNull() | (k != v))


def value_table(df: DataFrame) -> DataFrame:
    """The stored frequencies (column, value, n) that samples, counts and value lists of issues are read from."""
    return materialise(value_frequencies(df), "frequencies")


def issue_payload(
    issues: DataFrame, df: DataFrame, freq: DataFrame | None = None, samples: int = SAMPLES, top_counts: int = TOP_COUNTS
) -> DataFrame:
    """One row per issue: type, gaps, distinct values, a few samples and the top counts.

    Samples and counts are short arrays of the length asked for; value lists that may grow are rows of
    ``issue_values`` instead. ``freq`` is the ``value_table`` both may share.
    """
    freq = value_table(df) if freq is None else freq
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    kinds = freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("present"))
    some = ranked(freq, samples, F.asc("value")).groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "value"))), lambda x: x["value"])
        .alias("sample_values")
    )
    tops = top_values(freq, top_counts).groupBy("column").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "value", "n"))),
            lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")),
        ).alias("top_value_counts")
    )
    facts = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string").join(F.broadcast(rows))
    for part in (kinds, some, tops):  # one row per column each
        facts = facts.join(F.broadcast(part), "column", "left")
    missing = F.col("rows") - F.coalesce("present", F.lit(0))
    facts = facts.withColumn("missing_percent", F.round(F.try_divide(100.0 * missing, F.col("rows")), 1)).drop("rows", "present")
    named = issues.select(
        F.col("id").alias("issue_id"), F.col("category").alias("issue_type"), "column",
        F.col("message").alias("description"),
    )
    return named.join(F.broadcast(facts), "column", "left")


def unparseable_values(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, value): distinct non-null values that are not of the type the column leans to."""
    return unparseable_of(value_frequencies(df, columns), columns, target)


def unparseable_of(freq: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``unparseable_values`` from frequencies."""
    cells = freq.where(F.col("column").isin(columns)).select("column", "value")
    if target == "datetime":
        bad = add_dates(cells, {"parsed": F.col("value")}).where(F.col("parsed").isNull())
    else:
        bad = cells.where(to_loose_number(F.col("value")).isNull())
    return bad.select("column", "value")


def issue_values(issues: DataFrame, df: DataFrame, freq: DataFrame | None = None, short: bool = False) -> DataFrame:
    """(issue_id, kind, value): suspicious values of text issues, unparseable ones of type issues; all
    of them, or with ``short`` the first few suspicious ones of each rule."""
    lean = [
        (r["column"], r["t"]) for r in issues.where("category = 'mixed_types'")
        .select("column", F.col("stats")["inferred_type"].alias("t")).collect()  # one row per column
    ]
    text = [r["column"] for r in issues.where("category = 'text_quality'").select("column").collect()]
    freq = value_table(df) if freq is None and (text or lean) else freq
    spark = df.sparkSession
    out = spark.createDataFrame([], "column string, value string, kind string, category string")
    if text:
        trimmed = freq.where(F.col("column").isin(text)).withColumn("value", trim(F.col("value"))).where("value <> ''")
        odd = suspicious_of(materialise(trimmed.groupBy("column", "value").agg(F.sum("n").alias("n")), "texts"), short)
        out = out.unionByName(odd.select(
            "column", "value", F.lit("suspicious").alias("kind"), F.lit("text_quality").alias("category")
        ))
    for target in ("numeric", "datetime"):
        columns = [c for c, t in lean if t == target]
        if columns:
            bad = unparseable_of(freq, columns, target)
            out = out.unionByName(bad.select(
                "column", "value", F.lit("unparseable").alias("kind"), F.lit("mixed_types").alias("category")
            ))
    ids = issues.select(F.col("id").alias("issue_id"), "column", "category")
    return out.join(ids, ["column", "category"]).select("issue_id", "kind", "value")
