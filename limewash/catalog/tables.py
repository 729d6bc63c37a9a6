"""Queries for row and column operators, profiles, suspicious values, issues and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from limewash.catalog.cells import CODE_TEXT, PART_TEXT, _CONSISTENT_SQL, _ID_SQL, _KIND_SQL, sql_clean, sql_trim
from limewash.catalog.messy import VIEWS, messy, stored, with_view
from limewash.catalog.registry import query
from limewash.operators import rows as R
from limewash.operators.issues import actionable_issues, detect_issues, issue_batch, quality_score
from limewash.operators.melting import value_frequencies
from limewash.operators.profiling import (
    cleaning_summary, column_counts, infer_types, missingness_patterns, numeric_codes, outliers,
    profile_dataset, redundant_pairs, schema_table,
)
from limewash.operators.suspicious import (
    RULES, id_like_columns, suspicious_values, text_frequencies,
)
from limewash.plans.cleaner import Cleaner
from limewash.session import materialise
from limewash.sources.delimited import export_format
from limewash.sources.report import profile_json

DTYPES = {
    "messy_numeric": {
        "order_id": "bigint", "qty": "bigint", "qty_x2": "bigint", "constant": "int", "price": "double",
        "discount": "double", "status": "string", "flag": "string",
    },
}
NUMBERS = ["order_id", "qty", "qty_x2", "constant", "price", "discount"]


@query("drop_empty_columns", with_view(
    "messy_customer", "SELECT id, name, segment, email, phone, balance, nation FROM m"
))
def _(spark, sf):
    return R.drop_empty_columns(messy(spark, sf, "messy_customer"))


@query("drop_empty_rows", with_view("wide_null_rows", f"""
    SELECT * FROM m WHERE id IS NOT NULL OR lower({sql_trim('kind')}) NOT IN ('', 'nan')
        OR lower({sql_trim('props')}) NOT IN ('', 'nan')
"""))
def _(spark, sf):
    return R.drop_empty_rows(messy(spark, sf, "wide_null_rows"))


@query("dedupe", with_view("messy_customer", "SELECT DISTINCT * FROM m"))
def _(spark, sf):
    return R.drop_duplicates(messy(spark, sf, "messy_customer"))


@query("duplicate_count", with_view("messy_customer", """
    SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM m)) AS distinct_rows,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM m)) AS duplicate_rows FROM m
"""))
def _(spark, sf):
    return R.duplicate_count(messy(spark, sf, "messy_customer"))


def _counts_sql(ordinal: int, c: str, dtype: str) -> str:
    return f"""SELECT {ordinal} AS ordinal, '{c}' AS "column", '{dtype}' AS dtype, count(*) - count({c}) AS missing_count,
        round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS cardinality,
        count({c}) AS non_null_count FROM m"""


@query("profile_columns", with_view("messy_numeric", " UNION ALL ".join(
    _counts_sql(i, c, t) for i, (c, t) in enumerate(DTYPES["messy_numeric"].items())
)))
def _(spark, sf):
    return column_counts(messy(spark, sf, "messy_numeric"))


@query("value_counts", with_view("messy_customer", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY 2"
    for c in ("id", "name", "segment", "email", "phone", "balance", "nation", "empty_col")
)))
def _(spark, sf):
    return value_frequencies(messy(spark, sf, "messy_customer"))


def _iqr_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3,
        round(CASE WHEN q3 = q1 THEN q1 ELSE q1 - 1.5 * (q3 - q1) END, 4) AS lower_bound,
        round(CASE WHEN q3 = q1 THEN q3 ELSE q3 + 1.5 * (q3 - q1) END, 4) AS upper_bound,
        (SELECT count(*) FROM m WHERE q3 <> q1 AND {c} < q1 - 1.5 * (q3 - q1)) AS count_below,
        (SELECT count(*) FROM m WHERE q3 <> q1 AND {c} > q3 + 1.5 * (q3 - q1)) AS count_above
        FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM m) AS q"""


@query("outliers_iqr", with_view("messy_numeric", " UNION ALL ".join(_iqr_sql(c) for c in NUMBERS)))
def _(spark, sf):
    found = outliers(stored(spark, sf, "messy_numeric"))
    rounded = [F.round(c, 4).alias(c) for c in ("q1", "q3", "lower_bound", "upper_bound")]
    return found.select("column", *rounded, "count_below", "count_above")


def _z_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(3.0 AS DOUBLE) AS z_threshold,
        (SELECT count(*) FROM m WHERE sd > 0 AND abs(({c} - mu) / sd) > 3.0) AS z_count,
        round(CASE WHEN sd > 0 THEN greatest(hi - mu, mu - lo) / sd ELSE 0.0 END, 6) AS max_abs_z
        FROM (SELECT avg(CAST({c} AS DOUBLE)) AS mu, stddev_pop(CAST({c} AS DOUBLE)) AS sd,
            CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM m) AS q"""


@query("outliers_zscore", with_view("messy_numeric", " UNION ALL ".join(_z_sql(c) for c in NUMBERS)))
def _(spark, sf):
    found = outliers(stored(spark, sf, "messy_numeric"))
    return found.select("column", "z_threshold", "z_count", F.round("max_abs_z", 6).alias("max_abs_z"))


def _codes_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS cardinality, count({c}) AS non_null_count,
        round(count(DISTINCT {c}) / count({c}), 3) AS unique_ratio FROM m
        HAVING count({c}) >= 20 AND count(DISTINCT {c}) >= 20 AND count(DISTINCT {c}) > 0.5 * count({c})"""


@query("numeric_codes", with_view("messy_numeric", " UNION ALL ".join(_codes_sql(c) for c in NUMBERS)))
def _(spark, sf):
    df = messy(spark, sf, "messy_numeric")
    return numeric_codes(column_counts(df), infer_types(df))


_CELLS = list(DTYPES["messy_numeric"])
_PATTERN_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", when_column, when_value, round(rate, 1) AS missing_rate_when, "
    f"round(overall, 1) AS overall_missing_pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{o}' AS when_column, {i} AS o, CAST({o} AS VARCHAR) AS when_value, "
        f"100.0 * count_if({c} IS NULL) / count(*) AS rate FROM m WHERE {o} IS NOT NULL AND (SELECT count(DISTINCT {o}) FROM m) <= 80 GROUP BY {o} HAVING count(*) >= 10"
        for i, o in enumerate(_CELLS) if o != c
    )
    + f") AS s, (SELECT 100.0 * count_if({c} IS NULL) / count(*) AS overall, count_if({c} IS NULL) AS missing FROM m) AS t "
    f"WHERE missing >= 10 AND overall >= 5 AND rate >= 20 AND rate >= 1.2 * overall AND rate - overall >= 15 "
    f"QUALIFY row_number() OVER (ORDER BY rate DESC, o, when_value) = 1"
    for c in ("price", "status")
)


_PATTERNS_SQL = "SELECT * FROM (" + _PATTERN_SQL.replace(" UNION ALL SELECT 'status' AS \"column\"", ") UNION ALL SELECT * FROM (SELECT 'status' AS \"column\"") + ")"


@query("missingness_pattern", with_view("messy_numeric", _PATTERNS_SQL))
def _(spark, sf):
    return missingness_patterns(messy(spark, sf, "messy_numeric"))


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(r, 4) AS correlation FROM (SELECT CASE WHEN "
    f"stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r FROM "
    f"(SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS p) AS q "
    f"WHERE abs(r) >= 0.99"
    for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]
)


@query("redundant_pairs", with_view("messy_numeric", _PAIRS_SQL))
def _(spark, sf):
    return redundant_pairs(messy(spark, sf, "messy_numeric"))


def _type(c: str, dtype: str) -> str:
    return "numeric" if dtype in ("bigint", "int", "double") else "categorical"


_DATASET_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{_type(c, t)}' AS inferred_type, count(*) - count({c}) AS missing_count,
        round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS cardinality,
        count(*) AS row_count, (SELECT count(*) FROM m) - (SELECT count(*) FROM (SELECT DISTINCT * FROM m)) AS duplicate_rows
        FROM m"""
    for c, t in DTYPES["messy_numeric"].items()
)


@query("profile_dataset", with_view("messy_numeric", f""", base AS ({_DATASET_SQL}),
    iqr AS ({" UNION ALL ".join(_iqr_sql(c) for c in NUMBERS)}), far AS ({" UNION ALL ".join(_z_sql(c) for c in NUMBERS)}),
    codes AS ({" UNION ALL ".join(_codes_sql(c) for c in NUMBERS)}), gaps AS ({_PATTERNS_SQL})
    SELECT base.*, lower_bound, upper_bound, count_below, count_above, z_threshold, z_count, max_abs_z,
        codes.cardinality AS code_kinds, codes.non_null_count AS code_values, unique_ratio, when_column, when_value, missing_rate_when, overall_missing_pct
    FROM base LEFT JOIN iqr USING ("column") LEFT JOIN far USING ("column") LEFT JOIN codes USING ("column") LEFT JOIN gaps USING ("column")
"""))
def _(spark, sf):
    p = profile_dataset(stored(spark, sf, "messy_numeric"))
    iqr, far, codes, gaps = "outliers_iqr", "outliers_zscore", "numeric_but_categorical", "missingness_pattern"
    return p.column_profiles.select(
        "column", "dtype", "inferred_type", "missing_count", "missing_pct", "cardinality",
        F.lit(p.rows).cast("bigint").alias("row_count"), F.lit(p.duplicate_rows).cast("bigint").alias("duplicate_rows"),
        F.round(f"{iqr}.lower_bound", 4).alias("lower_bound"), F.round(f"{iqr}.upper_bound", 4).alias("upper_bound"), f"{iqr}.count_below", f"{iqr}.count_above",
        f"{far}.z_threshold", F.col(f"{far}.count").alias("z_count"), F.round(f"{far}.max_abs_z", 6).alias("max_abs_z"),
        F.col(f"{codes}.cardinality").alias("code_kinds"), F.col(f"{codes}.non_null_count").alias("code_values"), f"{codes}.unique_ratio",
        f"{gaps}.when_column", f"{gaps}.when_value", f"{gaps}.missing_rate_when", f"{gaps}.overall_missing_pct",
    )


@query("profile_json", with_view("messy_codes", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{"bigint" if c == "id" else "string"}' AS dtype, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS cardinality,
        count({c}) AS non_null_count, count(*) AS row_count, 5 AS column_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM m)) AS duplicate_rows FROM m"""
    for c in ("id", "country", "segment", "code", "plain")
)))
def _(spark, sf):
    """The JSON document, read back into columns."""
    text = profile_json(profile_dataset(stored(spark, sf, "messy_codes")))
    column = "struct<column: string, dtype: string, missing_count: bigint, cardinality: bigint, non_null_count: bigint>"
    read = text.select(F.from_json("profile", f"rows bigint, columns int, duplicate_rows bigint, column_profiles array<{column}>").alias("p"))
    return read.select(
        F.col("p.rows").alias("row_count"), F.col("p.columns").alias("column_count"), "p.duplicate_rows", F.inline("p.column_profiles")
    )


_CUSTOMER_DTYPES = {"id": "bigint", **{c: "string" for c in (
    "name", "segment", "email", "phone", "balance", "nation", "empty_col")}}


def _schema_sql(c: str, t: str) -> str:
    value = sql_clean(c) if t == "string" else c
    return f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({value}) AS non_null,
        round(100.0 * (count(*) - count({value})) / count(*), 1) AS missing_pct FROM m"""


@query("schema_table", with_view("messy_customer", " UNION ALL ".join(
    _schema_sql(c, t) for c, t in _CUSTOMER_DTYPES.items()
)))
def _(spark, sf):
    return schema_table(messy(spark, sf, "messy_customer"))


@query("clean_summary", with_view("messy_customer", """
    SELECT * FROM (SELECT 0 AS line, 'rows ' || CAST(count(*) AS VARCHAR) || ' -> ' || (SELECT CAST(count(*) AS VARCHAR) FROM customer) AS change FROM m
    UNION ALL SELECT 1, 'columns 8 -> 7' UNION ALL SELECT 2, 'dropped 1 empty column(s)'
    UNION ALL SELECT 3, 'types changed in balance: string->bigint, nation: string->bigint')
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_customer")
    result = Cleaner(headers=False).fit(df).run(df)
    result.df.write.format("noop").mode("overwrite").save()
    n = result.row_counts()
    lines = cleaning_summary(df, result.df, n["rows_in"], n["rows_out"])
    return spark.createDataFrame(list(enumerate(lines)), "line int, change string")


@query("export_format", with_view("messy_orders", """
    SELECT id, priority, strftime(true_date, '%Y-%m-%d') AS true_date FROM m
"""))
def _(spark, sf):
    return export_format(messy(spark, sf, "messy_orders").select("id", "priority", "true_date"))


# --- suspicious values -------------------------------------------------------------------------

def _text_freq(view: str, columns: list[str]) -> str:
    """Oracle table f: value frequencies of trimmed, non-blank text."""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {sql_trim(c)} AS value, count(*) AS n FROM m WHERE {sql_trim(c)} <> '' GROUP BY 2"
        for c in columns
    )
    return f"WITH m AS ({VIEWS[view]}), f AS ({parts}), tot AS (SELECT \"column\" AS c, sum(n) AS total, count(*) AS kinds, " \
        "sum(CASE WHEN regexp_matches(value, '[0-9]') THEN n ELSE 0 END) / sum(n) AS digits FROM f GROUP BY 1), " \
        "keyed AS (SELECT *, lower(trim(regexp_replace(value, '[^A-Za-z0-9 ]', '', 'g'))) AS k FROM f) "


def _all(where: str, source: str = "f") -> str:
    return f"SELECT \"column\", value, n FROM {source} WHERE {where}"


SUSPICIOUS_SQL = {
    "mojibake": _all("regexp_matches(value, 'Ã[\\x{80}-\\x{bf}]')"),
    "hex_byte": _all("regexp_matches(value, '[A-Za-z] ([89][0-9A-Fa-f]|[A-Fa-f][0-9]) [A-Za-z]')"),
    "stray_digits": _all(
        "regexp_matches(value, '^[A-Za-z ]+[0-9]+$|^[0-9]+[A-Za-z ]+$') AND \"column\" IN "
        "(SELECT c FROM tot WHERE digits > 0 AND digits < 0.3)"
    ),
    "punctuation": "SELECT \"column\", value, n FROM keyed WHERE k <> '' QUALIFY row_number() OVER "
                   "(PARTITION BY \"column\", k ORDER BY n DESC, value) > 1",
    "short_code": """SELECT "column", value, n FROM keyed WHERE ("column", k) IN (
        SELECT s."column", s.k FROM (SELECT "column", k, sum(n) AS t FROM keyed GROUP BY 1, 2) AS s
        JOIN (SELECT "column", k, sum(n) AS t FROM keyed GROUP BY 1, 2) AS l ON l."column" = s."column"
            AND length(l.k) > length(s.k) AND starts_with(l.k, s.k)
        WHERE length(s.k) BETWEEN 2 AND 3 GROUP BY 1, 2, s.t HAVING max(l.t) >= 3 * s.t)""",
    "rare": _all(
        "kinds <= 200 AND n <= greatest(1, floor(0.01 * total))", "(SELECT * FROM f JOIN tot ON \"column\" = c)"
    ),
}
_SUS_VIEWS = {
    "mojibake": ("messy_part", ["title", "person"]), "hex_byte": ("messy_part", ["title", "person"]),
    "stray_digits": ("messy_codes", CODE_TEXT), "punctuation": ("messy_codes", CODE_TEXT),
    "short_code": ("messy_codes", CODE_TEXT), "rare": ("messy_codes", CODE_TEXT),
}
_KEYS = {
    "mojibake": "sus_mojibake", "hex_byte": "sus_hex", "stray_digits": "sus_digits", "punctuation": "sus_punct",
    "short_code": "sus_short_code", "rare": "sus_rare",
}


def _register_rule(rule: str) -> None:
    view, columns = _SUS_VIEWS[rule]

    @query(_KEYS[rule], _text_freq(view, columns) + SUSPICIOUS_SQL[rule])
    def _(spark, sf):
        return RULES[rule](text_frequencies(messy(spark, sf, view), columns))


for _rule in RULES:
    _register_rule(_rule)

_ALL_RULES = " UNION ALL ".join(
    f"SELECT \"column\", value, n, {i} AS p, '{rule}' AS rule FROM ({SUSPICIOUS_SQL[rule]})"
    for i, rule in enumerate(RULES)
)


@query("suspicious_values", _text_freq("messy_codes", ["country", "segment", "plain"]) + f"""
    SELECT "column", value, max(n) AS n, arg_min(rule, p) AS rule FROM ({_ALL_RULES}) WHERE "column" NOT IN (
        SELECT "column" FROM ({" UNION ALL ".join(_ID_SQL.format(c=c, t=sql_trim(c)) for c in ("country", "segment", "plain"))}) WHERE is_id)
    GROUP BY 1, 2
""")
def _(spark, sf):
    return suspicious_values(messy(spark, sf, "messy_codes"), CODE_TEXT)


@query("id_columns_of_parts", with_view("messy_part", " UNION ALL ".join(
    _ID_SQL.format(c=c, t=sql_trim(c)) for c in ("size", "title", "code", "person")
)))
def _(spark, sf):
    return id_like_columns(text_frequencies(messy(spark, sf, "messy_part"), ["size", "title", "code", "person"]))


# --- issues and score --------------------------------------------------------------------------

def _fact_sql(i: int, c: str, t: str) -> str:
    kind = _type(c, t)
    below = (
        f"(SELECT count(*) FROM m, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM m) AS q WHERE q3 <> q1 AND "
        f"({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))" if kind == "numeric" else "0"
    )
    return f"""SELECT {i} AS o, '{c}' AS c, '{kind}' AS kind, round(100.0 * (count(*) - count({c})) / count(*), 2) AS pct,
        count({c}) AS n, count(DISTINCT {c}) AS k, {below} AS outside FROM m"""


_FACTS = " UNION ALL ".join(_fact_sql(i, c, t) for i, (c, t) in enumerate(DTYPES["messy_numeric"].items()))
_ISSUES_SQL = f"""
    SELECT 'missing::' || c AS id, 'missingness' AS category, CASE WHEN pct >= 60 THEN 'error' ELSE 'warning' END AS severity,
        c AS "column" FROM facts WHERE pct >= 30
    UNION ALL SELECT 'constant::' || c, 'constant', 'info', c FROM facts WHERE n > 0 AND k = 1
    UNION ALL SELECT 'type_validation::' || c, 'other', 'info', c FROM facts WHERE kind = 'numeric' AND n >= 20 AND k >= 20 AND k > 0.5 * n
    UNION ALL SELECT 'cardinality::' || c, 'cardinality', 'info', c FROM facts WHERE kind <> 'numeric' AND k > 100 AND k > 0.5 * n
    UNION ALL SELECT 'outliers::' || c, 'outliers', 'info', c FROM facts WHERE outside > 0
    UNION ALL SELECT 'text_quality::' || c, 'text_quality', 'info', c FROM facts WHERE kind <> 'numeric' AND n >= 10
    UNION ALL SELECT 'redundant::' || col_a || '::' || col_b, 'redundant', 'info', col_a FROM ({_PAIRS_SQL})
    UNION ALL SELECT 'duplicates::dataset', 'duplicates', 'warning', NULL FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM m)) AS d FROM m) WHERE d > 0
"""


def _issues_cte() -> str:
    return f"WITH m AS ({VIEWS['messy_numeric']}), facts AS ({_FACTS}), iss AS ({_ISSUES_SQL}) "


@query("detect_issues", _issues_cte() + "SELECT * FROM iss")
def _(spark, sf):
    found = detect_issues(profile_dataset(stored(spark, sf, "messy_numeric")))
    return found.select("id", "category", "severity", "column")


@query("issue_suggestions", _issues_cte() + f"""
    SELECT 'missing::' || c AS id, 0 AS position, 'drop_column' AS kind, c AS "column", false AS safe FROM facts WHERE pct >= 85
    UNION ALL SELECT 'constant::' || c, 0, 'drop_column', c, false FROM facts WHERE n > 0 AND k = 1
    UNION ALL SELECT 'redundant::' || col_a || '::' || col_b, o, 'drop_column', CASE o WHEN 0 THEN col_b ELSE col_a END, false
        FROM ({_PAIRS_SQL}), (SELECT unnest([0, 1]) AS o)
    UNION ALL SELECT id, 0, 'drop_duplicate_rows', NULL, true FROM iss WHERE category = 'duplicates'
""")
def _(spark, sf):
    """What each issue proposes, in its order, and whether that may be done without asking."""
    rows = stored(spark, sf, "messy_numeric")
    found = detect_issues(profile_dataset(rows))
    return found.select("id", F.posexplode("suggestions").alias("position", "s")).select(
        "id", "position", "s.kind", F.col("s.params")["column"].alias("column"), "s.safe"
    )


@query("quality_score", _issues_cte() + """
    SELECT round((completeness + 100.0 + validity + uniqueness) / 4.0, 1) AS score, round(completeness, 1) AS completeness,
        100.0::DOUBLE AS consistency, CAST(validity AS DOUBLE) AS validity, round(uniqueness, 1) AS uniqueness
    FROM (SELECT 100.0 - (SELECT avg(pct) FROM facts) AS completeness,
        greatest(0, 100.0 - 5.0 * (SELECT count(*) FROM iss WHERE category = 'missingness')
            - 2.0 * (SELECT count(*) FROM iss WHERE category = 'outliers'))::DOUBLE AS validity,
        100.0 - 100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM m))) / count(*) AS uniqueness FROM m)
""")
def _(spark, sf):
    p = profile_dataset(stored(spark, sf, "messy_numeric"))
    return quality_score(p, detect_issues(p))


@query("actionable_issues", with_view("messy_codes", """
    SELECT 'text_quality::' || "column" AS id, 1 AS priority FROM ({}) WHERE NOT is_consistent
""".format(" UNION ALL ".join(
    _CONSISTENT_SQL.format(c=c, t=sql_trim(c), id=_ID_SQL.format(c=c, t=sql_trim(c))) for c in CODE_TEXT
))))
def _(spark, sf):
    df = stored(spark, sf, "messy_codes")
    return actionable_issues(detect_issues(profile_dataset(df)), df).select("id", "priority")


_BATCH_COLUMNS = [*PART_TEXT, "title", "weight", "code", "person"]  # the last four once more, under other names
_BATCH_KINDS = " UNION ALL ".join(
    f"""SELECT {i} AS o, '{c}{'' if i < len(PART_TEXT) else 2}' AS c, kind FROM ({_KIND_SQL.format(c=c, none="'text'", rest="'text'", out="kind")}) AS k"""
    for i, c in enumerate(_BATCH_COLUMNS)
)


@query("issue_batch", with_view("messy_part", f"""
    SELECT CASE kind WHEN 'text' THEN 'text_quality::' ELSE 'mixed::' END || c AS id, CASE kind WHEN 'text' THEN 1 ELSE 0 END AS priority
    FROM ({_BATCH_KINDS}) ORDER BY priority, o LIMIT 8
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part")
    df = df.select(*PART_TEXT, *[F.col(c).alias(f"{c}2") for c in _BATCH_COLUMNS[len(PART_TEXT):]])
    found = detect_issues(profile_dataset(materialise(df, "parts"))).where("category in ('mixed_types', 'text_quality')")
    return issue_batch(found).select("id", "priority")
