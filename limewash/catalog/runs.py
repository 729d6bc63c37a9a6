"""Queries for whole cleaning plans, actions, fixes, recommendations and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.catalog.cells import CUSTOMER_TEXT, _PRICE_SQL, _TITLE_SQL, _WORD_CASE, sql_clean, sql_trim
from limewash.catalog.messy import messy, spread, stored, table, with_view
from limewash.catalog.registry import query
from limewash.catalog.tables import _ALL_RULES, _text_freq
from limewash.operators import actions as A
from limewash.operators import recommendations as R
from limewash.operators.issues import actionable_issues, detect_issues
from limewash.operators.profiling import profile_dataset
from limewash.plans.batch import analyse, run
from limewash.plans.cleaner import Cleaner
from limewash.session import materialise, scratch, scratch_path
from limewash.sources.delimited import detect_separator, load_csv, preview, rejected_lines, save_csv

KEEP_ALL = dict(headers=False, drop_empty=False)
STEP_OFF = dict(KEEP_ALL, int_like=False, number_text=False, email=False, coerce=False)

_BALANCE = "CAST(replace(replace(replace(balance, '$', ''), ',', ''), ' ', '') AS BIGINT)"
_CLEAN_CUSTOMER = f"""SELECT DISTINCT id AS "Id", {sql_clean('name')} AS "Name", {sql_clean('segment')} AS "Segment",
    lower({sql_trim('email')}) AS "Email", phone AS "Phone", {_BALANCE} AS "Balance", CAST(nation AS BIGINT) AS "Nation" FROM m"""


@query("clean", with_view("messy_customer", _CLEAN_CUSTOMER))
def clean_customers(spark, sf):
    df = messy(spark, sf, "messy_customer")
    return Cleaner().fit(df).transform(df)


def _shown(name: str, text: str) -> str:
    return f"""coalesce({text}, '') AS "{name}\""""


@query("preview", with_view("messy_customer", "SELECT " + ", ".join([
    *[_shown(c, f'CAST("{c}" AS VARCHAR)') for c in ("Id", "Name", "Segment", "Email", "Phone", "Nation")],
    _shown("Balance", """'$' || format('{:,}', "Balance")"""),
]) + f" FROM ({_CLEAN_CUSTOMER}) AS c"))
def _(spark, sf):
    df = messy(spark, sf, "messy_customer")
    plan = Cleaner().fit(df)
    return preview(plan.transform(df), plan.currency_columns)


@query("report_shape", with_view("messy_customer", """
    SELECT CAST((SELECT count(*) FROM customer) AS BIGINT) AS rows_before, CAST((SELECT count(*) FROM customer) AS BIGINT) AS rows_after,
        4 AS columns_before, 4 AS columns_after, CAST(0 AS BIGINT) AS duplicate_rows_before
"""))
def _(spark, sf):
    summary = batch_run(spark, sf).report.select("summary.*")
    return summary.select("rows_before", "rows_after", "columns_before", "columns_after", "duplicate_rows_before")


@query("clean_orders", with_view("messy_orders", """
    SELECT id, true_date AS order_date, CASE WHEN id % 50 = 0 THEN '1984-02-34' WHEN id % 30 = 0 THEN NULL
        ELSE strftime(true_date, '%Y-%m-%d') END AS ship_date, CAST(age AS BIGINT) AS age, status, priority, true_date FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_orders")
    return Cleaner(headers=False).fit(df).transform(df)


@query("clean_by_segment", with_view("messy_customer", f"""
    SELECT "Segment" AS segment, count(*) AS n, CAST(sum("Balance") AS BIGINT) AS balance FROM ({_CLEAN_CUSTOMER}) GROUP BY 1
"""))
def clean_by_segment(spark, sf):
    return clean_customers(spark, sf).groupBy(F.col("Segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Balance").alias("balance")
    )


_SIZE = "CASE WHEN size = 'inf' THEN NULL ELSE regexp_replace(size, '[a-z]', '', 'g') END"


@query("coerce_mixed", with_view("messy_part", f"""
    SELECT id, size, CAST(CASE upper({sql_trim('quantity')}) {_WORD_CASE} ELSE quantity END AS BIGINT) AS quantity,
        ratio, title, code, person, {sql_trim('price')} AS price, weight FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part")
    return Cleaner(**dict(STEP_OFF, coerce=True)).fit(df).transform(df)


@query("normalize_numeric", with_view("messy_part", f"""
    SELECT id, size, {sql_trim('quantity')} AS quantity, ratio, title, code, person,
        CASE WHEN {_PRICE_SQL} = price THEN {sql_trim('price')} ELSE {_PRICE_SQL} END AS price, weight
    FROM (SELECT *, id % 50 + 1 AS n FROM m) AS x
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part")
    return Cleaner(**dict(STEP_OFF, number_text=True)).fit(df).transform(df)


@query("normalize_int_like", with_view("messy_part", f"""
    SELECT id, {_SIZE} AS size, {sql_trim('quantity')} AS quantity, ratio, title, regexp_replace(code, '[A-Z]', '') AS code, person,
        {sql_trim('price')} AS price, weight FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part")
    return Cleaner(**dict(STEP_OFF, int_like=True)).fit(df).transform(df)


@query("capitalize_names", with_view("messy_part", f"""
    SELECT id, title, {_TITLE_SQL.format('person')} AS person FROM (SELECT id, code AS title, person FROM m) AS x
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part").select("id", F.col("code").alias("title"), "person")
    return Cleaner(**dict(STEP_OFF, name_case="title")).fit(df).transform(df)


_SENTENCE = "upper(left({0}, 1)) || lower(substr({0}, 2))"


@query("sentence_names", with_view("messy_part", f"""
    SELECT id, title, {_SENTENCE.format('person')} AS person FROM (SELECT id, code AS title, person FROM m) AS x
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part").select("id", F.col("code").alias("title"), "person")
    return Cleaner(**dict(STEP_OFF, name_case="sentence")).fit(df).transform(df)


def _any(condition: str) -> str:
    return "EXISTS (SELECT 1 FROM m WHERE " + " OR ".join(condition.format(c=c, t=sql_trim(c), v=sql_clean(c)) for c in CUSTOMER_TEXT) + ")"


_STEP_TESTS = {
    "trim_whitespace": _any("{c} <> {t}"),
    "standardize_nulls": _any("{c} IS NOT NULL AND {v} IS NULL"),
    "normalize_column_names": "EXISTS (SELECT 1 FROM (SELECT unnest({}) AS c) WHERE c <> upper(c[1]) || c[2:])".format(["id", *CUSTOMER_TEXT]),
    "drop_empty_columns": " OR ".join(f"(SELECT count({c}) = 0 FROM m)" for c in CUSTOMER_TEXT),
    "normalize_int_like_strings": "EXISTS (SELECT 1 FROM m WHERE regexp_matches(nation, '[A-Za-z]'))",
    "normalize_numeric_strings": "EXISTS (SELECT 1 FROM m WHERE regexp_matches(balance, '[$,]'))",
    "normalize_email_like_columns": f"EXISTS (SELECT 1 FROM m WHERE lower({sql_trim('email')}) <> {sql_trim('email')})",
    "coerce_mixed_types": "(SELECT bool_and(regexp_full_match(nation, '[0-9]+')) FROM m)",
    "drop_empty_rows": "EXISTS (SELECT 1 FROM m WHERE id IS NULL AND " + " AND ".join(f"{sql_clean(c)} IS NULL" for c in CUSTOMER_TEXT) + ")",
    "remove_duplicates": f"(SELECT count(*) FROM m) > (SELECT count(*) FROM ({_CLEAN_CUSTOMER}))",
}


@query("steps_applied", with_view("messy_customer", "SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS position, step FROM (" + " UNION ALL ".join(
    f"SELECT {o} AS o, '{step}' AS step WHERE {test}" for o, (step, test) in enumerate(_STEP_TESTS.items())
) + ") AS s"))
def _(spark, sf):
    """The steps are known once the run has been written; its rows are counted by the same job."""
    df = messy(spark, sf, "messy_customer")
    done = Cleaner().fit(df).run(df)
    with scratch(spark):
        materialise(done.df, "cleaned")
    return done.steps_table()


@query("coerce_numeric", with_view("messy_part", "SELECT id, try_cast(weight AS DOUBLE) AS weight FROM m"))
def _(spark, sf):
    df = messy(spark, sf, "messy_part").select("id", "weight")
    return Cleaner(**dict(STEP_OFF, coerce=True, lossy_numbers=True)).fit(df).transform(df)


# --- actions -----------------------------------------------------------------------------------

@query("act_drop_missing", with_view("messy_orders", "SELECT id, status FROM m WHERE status IS NOT NULL"))
def _(spark, sf):
    return A.drop_missing(messy(spark, sf, "messy_orders"), "status").select("id", "status")


@query("act_drop_column", with_view("messy_numeric", "SELECT * EXCLUDE (constant) FROM m"))
def _(spark, sf):
    return A.drop_column(messy(spark, sf, "messy_numeric"), "constant")


@query("act_fillna", with_view("messy_orders", "SELECT id, coalesce(status, 'U') AS status FROM m"))
def _(spark, sf):
    return A.fill_missing(messy(spark, sf, "messy_orders"), "status", "U").select("id", "status")


@query("act_cast", with_view("messy_orders", """
    SELECT id, true_date AS order_date, CAST(age AS DOUBLE) AS age, priority, status, CAST(id AS STRING) AS id_text FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_orders").select(
        "id", "order_date", "age", "priority", "status", F.col("id").alias("id_text")
    )
    df = A.cast_column(A.cast_column(df, "order_date", "datetime"), "age", "numeric")
    return A.cast_column(df, "id_text", "string")


_ACTIONS = [
    A.Action("missing::empty_col", "drop_column", "empty_col"),
    A.Action("missing::gone", "drop_column", "gone"),
    A.Action("missing::segment", "fillna_constant", "segment", {"value": "OTHER"}),
    A.Action("missing::name", "fillna_constant", "name"),
    A.Action("mixed::nation", "cast_type", "nation", {"target_type": "numeric"}),
    A.Action("x", "rename", "name"),
    A.Action("duplicates::dataset", "drop_duplicate_rows"),
]


@query("apply_actions", with_view("messy_customer", """
    SELECT DISTINCT id, name, coalesce(segment, 'OTHER') AS segment, email, phone, balance, CAST(nation AS DOUBLE) AS nation
    FROM (SELECT * REPLACE (CASE WHEN segment = 'N/A' THEN NULL ELSE segment END AS segment) FROM m) AS x
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_customer")
    df = df.withColumn("segment", F.when(F.col("segment") != "N/A", F.col("segment")))
    return A.apply_actions(df, _ACTIONS)[0]


@query("action_log", with_view("messy_customer", """
    SELECT 0 AS step, 'drop_column' AS action, 'empty_col' AS "column", NULL::BIGINT AS rows_removed, NULL::BIGINT AS filled_count, NULL AS error
    UNION ALL SELECT 1, 'drop_column', 'gone', NULL, NULL, 'column_not_found'
    UNION ALL SELECT 2, 'fillna_constant', 'segment', NULL, count_if(segment = 'N/A'), NULL FROM m
    UNION ALL SELECT 3, 'fillna_constant', 'name', NULL, NULL, 'missing_value_param'
    UNION ALL SELECT 4, 'cast_type', 'nation', NULL, NULL, NULL
    UNION ALL SELECT 5, 'rename', 'name', NULL, NULL, 'unsupported_action'
    UNION ALL SELECT 6, 'drop_duplicate_rows', NULL, count(*) - (SELECT count(*) FROM customer), NULL, NULL FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_customer")
    df = df.withColumn("segment", F.when(F.col("segment") != "N/A", F.col("segment")))
    log = A.apply_actions(df, _ACTIONS)[1]
    return log.select("step", "action", "column", "rows_removed", "filled_count", "error")


@query("auto_type_fixes", with_view("messy_part", """
    SELECT id, title, CASE WHEN id % 25 = 3 THEN NULL ELSE try_cast(weight AS DOUBLE) END AS weight, CAST(n AS BIGINT) AS n
    FROM (SELECT id, title, weight, id % 50 AS n FROM m) AS x
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part").select("id", "title", "weight", (F.col("id") % 50).cast("string").alias("n"))
    return A.type_fixes(df)[0]


@query("auto_rules", with_view("messy_customer", """
    SELECT DISTINCT id, name, CAST(nation AS BIGINT) AS nation FROM m
"""))
def _(spark, sf):
    return A.automatic_rules(messy(spark, sf, "messy_customer").select("id", "name", "nation"))[0]


_MAPPING = {"US": "USA", "US.": "USA", "usa": "USA", "Italy1": "Italy", "Francce": None}
_MAPPED = """CASE WHEN country IN ('US', 'US.', 'usa') THEN 'USA' WHEN country = 'Italy1' THEN 'Italy'
    WHEN country = 'Francce' THEN NULL ELSE country END"""


@query("apply_fix", with_view("messy_codes", f"""
    SELECT id, {_MAPPED} AS country, {_TITLE_SQL.format('segment')} AS segment FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_codes").select("id", "country", "segment")
    df = A.apply_fix(df, A.Fix("normalize_values", "country", {"mappings": _MAPPING}))
    df = A.apply_fix(df, A.Fix("keep", "segment"))
    return A.apply_fix(df, A.Fix("title_case", "segment"))


@query("apply_mapping_table", with_view("messy_codes", f"SELECT id, {_MAPPED} AS country FROM m"))
def _(spark, sf):
    """The mapping comes as a table derived from the data, and is joined."""
    df = messy(spark, sf, "messy_codes").select("id", "country")
    value = F.col("value")
    rules = df.select(F.col("country").alias("value")).distinct().select(
        "value", F.when(F.upper(F.replace(value, F.lit("."), F.lit(""))).isin("US", "USA"), "USA")
        .when(value == "Italy1", "Italy").when(value == "Francce", None).otherwise(value).alias("replacement"),
    )
    return A.map_values(df, "country", rules)


@query("safe_coerce", with_view("messy_part", """
    SELECT id, CASE WHEN weight = 'unknown' THEN NULL ELSE CAST(try_cast(weight AS DOUBLE) AS DOUBLE) END AS weight, title FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part").select("id", "weight", "title")
    df = A.map_values(df, "weight", {"unknown": None})
    return A.safe_coerce(A.safe_coerce(df, "weight"), "title")


@query("replay_fixes", with_view("messy_codes", f"SELECT id, {_MAPPED} AS country, segment FROM m"))
def _(spark, sf):
    base = messy(spark, sf, "messy_codes").select("id", "country", "segment")
    fixes = {
        "text_quality::country": A.Fix("normalize_values", "country", {"mappings": _MAPPING}),
        "text_quality::segment": A.Fix("title_case", "segment"),
    }
    del fixes["text_quality::segment"]  # undone
    return A.replay_fixes(base, fixes, ["text_quality::country", "text_quality::segment"])


# --- recommendations ---------------------------------------------------------------------------

def responses(spark, sf) -> DataFrame:
    """One raw model response per supplier, in every shape a response may come in."""
    k = F.col("s_suppkey")
    item = F.concat(
        F.lit('{"issue_id":"i'), k % 7, F.lit('","inferred_domain":"name","recommended_action":"'),
        F.when(k % 3 == 0, "normalize_values").when(k % 3 == 1, "title_case").otherwise("invent"),
        F.lit('","reasoning":"a \\"{b}\\"","fix_params":{"mappings":{"'), F.col("s_name"), F.lit('":"s'), k,
        F.lit('","same":"same","gone":null}}}'),
    )
    bad = F.lit('{"recommended_action":"keep"}')
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
        .when(k % 5 == 1, F.concat(F.lit("Sure: ["), item, F.lit(","), item, F.lit("] done")))
        .when(k % 5 == 2, F.concat(F.lit("["), item, F.lit(',{"issue_id":"cut","reas')))
        .when(k % 5 == 3, F.concat(F.lit("["), item, F.lit(","), bad, F.lit("]")))
        .otherwise("no answer")
    )
    return spread(table(spark, sf, "supplier")).select(k.alias("response_id"), text.alias("response"))


_ACTION_SQL = "CASE s_suppkey % 3 WHEN 0 THEN 'normalize_values' WHEN 1 THEN 'title_case' ELSE 'flag_for_manual_review' END"
_PARSED = f"""
    SELECT s_suppkey AS response_id, CAST(p AS INT) AS position, 'i' || CAST(s_suppkey % 7 AS VARCHAR) AS issue_id,
        {_ACTION_SQL} AS recommended_action, 'a "{{b}}"' AS reasoning, 'name' AS inferred_domain, s_name
    FROM supplier, (VALUES (0), (1)) AS v(p) WHERE s_suppkey % 5 IN (0, 1, 2) AND (p = 0 OR s_suppkey % 5 = 1)
"""


@query("parse_recs", f"SELECT * EXCLUDE (s_name) FROM ({_PARSED})")
def _(spark, sf):
    return R.parse_responses(responses(spark, sf)).drop("fix_params")


def known_issues(spark, sf) -> DataFrame:
    ids = table(spark, sf, "supplier").select(F.concat(F.lit("i"), F.col("s_suppkey") % 7).alias("id")).distinct()
    return ids.where(F.col("id") != "i3")


@query("match_recs", f"""
    SELECT issue_id, recommended_action, s_name AS mapped FROM ({_PARSED}) WHERE issue_id <> 'i3'
    QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY response_id DESC, position DESC) = 1
""")
def _(spark, sf):
    recs = R.match_recommendations(R.parse_responses(responses(spark, sf)), known_issues(spark, sf))
    return recs.select(
        "issue_id", "recommended_action", F.element_at(F.map_keys("fix_params.mappings"), 1).alias("mapped")
    )


@query("issues_without_recs", f"""
    SELECT DISTINCT 'i' || CAST(s_suppkey % 11 AS VARCHAR) AS id FROM supplier WHERE 'i' || CAST(s_suppkey % 11 AS VARCHAR) NOT IN
        (SELECT issue_id FROM ({_PARSED}) WHERE recommended_action = 'title_case')
""")
def _(spark, sf):
    recs = R.parse_responses(responses(spark, sf)).where("recommended_action = 'title_case'")
    issues = table(spark, sf, "supplier").select(F.concat(F.lit("i"), F.col("s_suppkey") % 11).alias("id")).distinct()
    return R.without_recommendations(issues, recs)


@query("drop_identity", f"""
    SELECT response_id, position, s_name AS key, 's' || CAST(response_id AS VARCHAR) AS value FROM ({_PARSED})
    UNION ALL SELECT response_id, position, 'gone', NULL FROM ({_PARSED})
""")
def _(spark, sf):
    recs = R.parse_responses(responses(spark, sf))
    kept = R.drop_identity_mappings(F.col("fix_params.mappings"))
    return recs.select("response_id", "position", F.explode(kept).alias("key", "value"))


@query("issue_payload", with_view("messy_codes", " UNION ALL ".join(
    f"""SELECT 'text_quality::{c}' AS issue_id, 'text_quality' AS issue_type, '{c}' AS "column", 'string' AS dtype,
        round(100.0 * count_if({c} IS NULL) / count(*), 1) AS missing_percent, count(DISTINCT {c}) AS unique_values,
        (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM m WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 4)) AS samples,
        (SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS top_counts
        FROM m"""
    for c in ("country", "segment")
)))
def _(spark, sf):
    df = stored(spark, sf, "messy_codes")
    found = actionable_issues(detect_issues(profile_dataset(df)), df)
    return R.issue_payload(found, df).select(
        "issue_id", "issue_type", "column", "dtype", "missing_percent", "unique_values", F.array_join("sample_values", "|").alias("samples"),
        F.array_join(F.transform("top_value_counts", lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), "|").alias("top_counts"),
    )


@query("issue_values", _text_freq("messy_codes", ["country", "segment", "plain"]) + f"""
    , odd AS (SELECT "column", value FROM ({_ALL_RULES}) GROUP BY 1, 2)
    SELECT 'text_quality::' || "column" AS issue_id, 'suspicious' AS kind, value FROM odd
    UNION ALL SELECT DISTINCT 'mixed::weight', 'unparseable', weight FROM (
        SELECT CASE WHEN c_custkey % 30 = 0 THEN 'n' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS weight FROM customer) WHERE try_cast(weight AS BIGINT) IS NULL
""")
def _(spark, sf):
    """Suspicious and unparseable values of all issues, whole lists, from one table of frequencies."""
    df = stored(spark, sf, "messy_codes")
    weight = F.when(F.col("id") % 30 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    df = df.select("country", "segment", "plain", weight.alias("weight"))
    return R.issue_values(detect_issues(profile_dataset(df)), df)


@query("unparseable_values", with_view("messy_part", """
    SELECT DISTINCT 'mixed::weight' AS issue_id, 'unparseable' AS kind, weight AS value FROM m WHERE weight = 'unknown'
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part").select("id", "weight")
    found = detect_issues(profile_dataset(df)).where("category = 'mixed_types'")
    return R.issue_values(found, df)


# --- files -------------------------------------------------------------------------------------

def written(lines: DataFrame, name: str) -> str:
    """Write lines of text as one folder of files in shared scratch space; returns the folder."""
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def customer_lines(spark, sf, sep: str) -> DataFrame:
    """A file per customer table: header in every part, some short, wide and quoted lines."""
    k = F.col("c_custkey")
    quote = F.concat(F.lit('"'), F.col("c_name"), F.lit(' x"'))
    name = F.when(k % 11 == 0, quote).when(k % 13 == 0, "N/A").when(k % 17 == 0, "").otherwise(F.col("c_name"))
    number = F.when(k % 20 == 0, F.concat(F.lit("1"), F.lit(sep), F.lpad((k % 1000).cast("string"), 3, "0")))
    number = number.otherwise((k % 1000).cast("string"))
    row = F.concat_ws(sep, k, name, number, F.col("c_mktsegment"))
    row = F.when(k % 23 == 1, F.concat_ws(sep, k, name)).otherwise(row)
    return spread(table(spark, sf, "customer")).select(row.alias("value"))


def with_header(lines: DataFrame, header: str) -> DataFrame:
    """Put the header first in every part, as a folder of CSV files has it."""
    ordered = lines.repartition(4, "value").withColumn("part", F.spark_partition_id())
    heads = lines.sparkSession.range(4).select(F.lit(header).alias("value"), F.col("id").cast("int").alias("part"))
    both = heads.withColumn("rank", F.lit(0)).unionByName(ordered.withColumn("rank", F.lit(1)))
    return both.repartition(4, "part").sortWithinPartitions("part", "rank").select("value", "part")


def customer_file(spark, sf, sep: str, name: str) -> str:
    lines = with_header(customer_lines(spark, sf, sep), sep.join(["id", "name", "number", "segment"]))
    path = scratch_path(spark, name)
    lines.write.partitionBy("part").text(path)
    return path + "/*"


@query("csv_sniff", """
    SELECT ';' AS sep, count(*) FILTER (c_custkey % 20 <> 0 OR c_custkey % 23 = 1) AS n FROM customer
    UNION ALL SELECT ',', count(*) FROM customer
""")
def _(spark, sf):
    out = None
    for sep in (";", ","):
        path = customer_file(spark, sf, sep, "sniff")
        found = detect_separator(spark, path)
        row = load_csv(spark, path, found)[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit(found).alias("sep"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("csv_rejected", """
    SELECT concat_ws(';', c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '"' || c_name || ' x"' WHEN c_custkey % 13 = 0 THEN 'N/A'
            WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END, '1', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), c_mktsegment) AS line, 5 AS fields
    FROM customer WHERE c_custkey % 20 = 0 AND c_custkey % 23 <> 1
""")
def _(spark, sf):
    return rejected_lines(spark, customer_file(spark, sf, ";", "rejected")).select("line", "fields")


@query("csv_prose", """
    SELECT CAST(doc_id AS VARCHAR) AS id, nullif(text, '') AS body FROM documents
""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    path = scratch_path(spark, "prose")
    save_csv(spread(docs), path, ",")
    return load_csv(spark, path, ",")[0]


def note_lines(spark, sf) -> DataFrame:
    """Records of customers with inch marks, doubled quotes, line breaks and fields too many, of which some are empty."""
    k, name = F.col("c_custkey"), F.col("c_name")
    note = F.when(k % 7 == 0, F.concat(F.lit('"'), name, F.lit(';\n""'), k.cast("string"), F.lit('""\n"')))
    note = note.when(k % 5 == 0, F.concat(k.cast("string"), F.lit('" pipe'))).otherwise(name)
    more = F.when(k % 9 == 0, ';;"more;\n"').when(k % 4 == 0, ";").otherwise("")
    return spread(table(spark, sf, "customer")).select(F.concat(k.cast("string"), F.lit(";"), note, more).alias("value"))


@query("csv_records", """
    WITH r AS (
        SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_name || ';' || chr(10) || '"' || c_custkey || '"' || chr(10)
                WHEN c_custkey % 5 = 0 THEN c_custkey || '" pipe' ELSE c_name END AS note,
            CASE WHEN c_custkey % 7 = 0 THEN '"' || c_name || ';' || chr(10) || '""' || c_custkey || '""' || chr(10) || '"'
                WHEN c_custkey % 5 = 0 THEN c_custkey || '" pipe' ELSE c_name END AS raw,
            CASE WHEN c_custkey % 9 = 0 THEN ';;"more;' || chr(10) || '"' WHEN c_custkey % 4 = 0 THEN ';' ELSE '' END AS more
        FROM customer)
    SELECT CAST(k AS VARCHAR) AS id, note, NULL AS line, NULL AS fields FROM r WHERE more = ''
    UNION ALL SELECT NULL, NULL, k || ';' || raw || more, CASE WHEN k % 9 = 0 THEN 4 ELSE 3 END FROM r WHERE more <> ''
""")
def _(spark, sf):
    path = scratch_path(spark, "notes")
    with_header(note_lines(spark, sf), "id;note").write.partitionBy("part").text(path)
    loaded = load_csv(spark, path + "/*", ";")[0]
    return loaded.unionByName(rejected_lines(spark, path + "/*", ";").select("line", "fields"), allowMissingColumns=True)


_NAME_SQL = """CASE WHEN c_custkey % 11 = 0 THEN c_name || ' x' WHEN c_custkey % 13 = 0 THEN 'N/A'
    WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END"""


@query("csv_load", f"""
    SELECT CAST(c_custkey AS VARCHAR) AS id, {_NAME_SQL} AS name,
        CASE WHEN c_custkey % 23 = 1 THEN NULL ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS number,
        CASE WHEN c_custkey % 23 = 1 THEN NULL ELSE c_mktsegment END AS segment
    FROM customer WHERE c_custkey % 20 <> 0 OR c_custkey % 23 = 1
""")
def _(spark, sf):
    return load_csv(spark, customer_file(spark, sf, ";", "semicolons"))[0]


@query("csv_thousands_repair", f"""
    SELECT CAST(c_custkey AS VARCHAR) AS id, {_NAME_SQL} AS name,
        CASE WHEN c_custkey % 23 = 1 THEN NULL WHEN c_custkey % 20 = 0 THEN '1' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
            ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS number,
        CASE WHEN c_custkey % 23 = 1 THEN NULL ELSE c_mktsegment END AS segment FROM customer
""")
def _(spark, sf):
    return load_csv(spark, customer_file(spark, sf, ",", "commas"))[0]


@query("csv_encoding", """
    SELECT CAST(c_custkey AS VARCHAR) AS "Größe", 'é' || c_name AS name FROM customer
""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Größe"), F.concat(F.lit("é"), F.col("c_name")).alias("name")
    )
    path = scratch_path(spark, "latin")
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return load_csv(spark, path)[0]


@query("csv_save", with_view("messy_orders", """
    SELECT CAST(id AS VARCHAR) AS id, priority, status, CAST(age AS VARCHAR) AS age FROM m
"""))
def _(spark, sf):
    path = scratch_path(spark, "saved")
    save_csv(messy(spark, sf, "messy_orders").select("id", "priority", "status", "age"), path, ";")
    return load_csv(spark, path)[0]


def batch_run(spark, sf):
    return run(spark, customer_file(spark, sf, ",", "batch"), scratch_path(spark, "out"), scratch_path(spark, "report"))


@query("run_batch", f"""
    SELECT c_custkey AS "Id", CASE WHEN c_custkey % 13 = 0 AND c_custkey % 11 <> 0 THEN NULL ELSE {_NAME_SQL} END AS "Name",
        CASE WHEN c_custkey % 23 = 1 THEN NULL WHEN c_custkey % 20 = 0 THEN 1000 + c_custkey % 1000
            ELSE c_custkey % 1000 END AS "Number",
        CASE WHEN c_custkey % 23 = 1 THEN NULL ELSE c_mktsegment END AS "Segment" FROM customer
""")
def _(spark, sf):
    return batch_run(spark, sf).cleaned


@query("report_summary")
def _(spark, sf):
    return batch_run(spark, sf).report.select("summary.*").drop("input_path", "output_path")


@query("analyse", with_view("messy_customer", """
    SELECT CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM m)) AS BIGINT) AS row_count, 7 AS column_count, CAST(0 AS BIGINT) AS duplicate_rows
"""))
def _(spark, sf):
    result = analyse(messy(spark, sf, "messy_customer"))
    return result.profile_after.summary().select(
        F.col("rows").alias("row_count"), F.col("columns").alias("column_count"), "duplicate_rows"
    )
