"""Queries for the cell functions and the column detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from limewash.catalog.messy import messy, table, with_view
from limewash.catalog.registry import query
from limewash.functions import text
from limewash.functions.constants import NULL_SENTINELS, NUMBER_WORDS
from limewash.functions.dates import add_dates
from limewash.functions.headers import clean_headers
from limewash.functions.numbers import add_number_text, to_loose_number, to_number, word_numbers
from limewash.operators.actions import fallback_types
from limewash.operators.detectors import column_evidence, decide, person_columns
from limewash.operators.issues import text_consistency as consistency
from limewash.operators.profiling import infer_types
from limewash.operators.suspicious import id_like_columns, text_frequencies

SENTINELS = ", ".join(f"'{s}'" for s in NULL_SENTINELS)
TRIM_SQL = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def sql_trim(c: str) -> str:
    return TRIM_SQL.format(c)


def sql_clean(c: str) -> str:
    """Trimmed text with null-like words as null."""
    return f"CASE WHEN lower({sql_trim(c)}) IN ({SENTINELS}) THEN NULL ELSE {sql_trim(c)} END"


def per_column(view: str, columns: list[str], body: str) -> str:
    """The same statement for several columns; ``{c}`` is the column, ``v`` its clean value."""
    parts = [
        f"SELECT * FROM (WITH v AS (SELECT {sql_clean(c)} AS v FROM m) {body.format(c=c)})"
        for c in columns
    ]
    return with_view(view, " UNION ALL ".join(parts))


@query("trim_whitespace", with_view(
    "messy_customer", f"SELECT id, {sql_trim('name')} AS name, {sql_trim('segment')} AS segment FROM m"
))
def _(spark, sf):
    df = messy(spark, sf, "messy_customer")
    return df.select("id", *[text.trim(F.col(c)).alias(c) for c in ("name", "segment")])


@query("standardize_nulls", with_view(
    "messy_customer",
    f"SELECT id, CASE WHEN lower({sql_trim('segment')}) IN ({SENTINELS}) THEN NULL ELSE segment END AS segment FROM m",
))
def _(spark, sf):
    return messy(spark, sf, "messy_customer").select("id", text.null_if_sentinel(F.col("segment")).alias("segment"))


@query("normalize_columns", """
    SELECT c_custkey AS "Customer Id", c_name AS "Original Title", c_nationkey AS "Genre",
        c_acctbal AS "Account Balance", c_mktsegment AS "Descripcion Larga" FROM customer
""")
def _(spark, sf):
    names = [" customer  id ", "Original titl", "Genr", "account balance", "Descripción larga"]
    return table(spark, sf, "customer").toDF(*clean_headers(names))


@query("parse_dates", with_view("messy_orders", """
    SELECT id, true_date AS order_date, CASE WHEN id % 50 = 0 OR id % 30 = 0 THEN NULL ELSE true_date END AS ship_date
    FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_orders").select("id", "order_date", "ship_date")
    return add_dates(df, {c: F.col(c) for c in ("order_date", "ship_date")})


_WORD_CASE = " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in NUMBER_WORDS.items())


@query("word_numbers", with_view(
    "messy_part", f"SELECT id, CASE upper({sql_trim('quantity')}) {_WORD_CASE} ELSE quantity END AS quantity FROM m"
))
def _(spark, sf):
    return messy(spark, sf, "messy_part").select("id", word_numbers(F.col("quantity")).alias("quantity"))


_PRICE_SQL = """CASE id % 12 WHEN 0 THEN '1' || CAST(n + 100 AS STRING) || '.5' WHEN 1 THEN CAST(n AS STRING) || '473'
    WHEN 2 THEN CAST(n AS STRING) || '.7' WHEN 3 THEN CAST(n AS STRING) || '.9' WHEN 4 THEN '-' || CAST(n AS STRING)
    WHEN 5 THEN CAST(n AS STRING) WHEN 6 THEN price WHEN 7 THEN '40' || CAST(n + 100 AS STRING)
    WHEN 8 THEN CAST(n + 100 AS STRING) || CAST(n + 200 AS STRING) || '.25' WHEN 9 THEN CAST(n AS STRING) || '.5'
    ELSE price END"""


@query("numeric_strings", with_view(
    "messy_part", f"SELECT id, price, {_PRICE_SQL} AS number_text FROM (SELECT *, id % 50 + 1 AS n FROM m) AS x"
))
def _(spark, sf):
    df = messy(spark, sf, "messy_part").select("id", "price")
    return add_number_text(df, {"number_text": F.col("price")})


@query("int_like", with_view("messy_part", """
    SELECT id, CASE WHEN size = 'inf' THEN NULL ELSE regexp_replace(size, '[a-z]', '', 'g') END AS size FROM m
"""))
def _(spark, sf):
    return messy(spark, sf, "messy_part").select("id", text.int_like_text(F.col("size")).alias("size"))


_TITLE_SQL = (
    "array_to_string(list_transform(regexp_extract_all({0}, '[[:alpha:]]+|[^[:alpha:]]+'), "
    "lambda x: upper(x[1]) || lower(x[2:])), '')"
)


@query("title_case", with_view(
    "messy_part", f"SELECT id, {_TITLE_SQL.format('person')} AS person FROM m"
))
def _(spark, sf):
    return messy(spark, sf, "messy_part").select("id", text.title_case(F.col("person")).alias("person"))


@query("email_normalize", with_view("messy_customer", f"SELECT id, lower({sql_trim('email')}) AS email FROM m"))
def _(spark, sf):
    return messy(spark, sf, "messy_customer").select("id", F.lower(text.trim(F.col("email"))).alias("email"))


@query("to_numeric", with_view("messy_part", """
    SELECT id, CASE WHEN regexp_full_match(trim(size), '[0-9]+') THEN try_cast(trim(size) AS DOUBLE)
            WHEN size = 'inf' THEN CAST('inf' AS DOUBLE) END AS size,
        try_cast(weight AS DOUBLE) AS weight FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_part")
    return df.select("id", to_number(F.col("size")).alias("size"), to_number(F.col("weight")).alias("weight"))


CUSTOMER_TEXT = ["name", "segment", "email", "phone", "balance", "nation", "empty_col"]
PART_TEXT = ["size", "quantity", "ratio", "title", "code", "person", "price", "weight"]
ORDER_TEXT = ["order_date", "ship_date", "age", "status", "priority"]


def _share(pattern: str, least: int, share: float, name: str) -> str:
    """Detector SQL: enough values and enough of them matching."""
    return (
        f"SELECT '{{c}}' AS \"column\", count(v) AS n, count(CASE WHEN {pattern} THEN 1 END) AS matches, "
        f"count(v) >= {least} AND count(CASE WHEN {pattern} THEN 1 END) >= {share} * count(v) AS {name} FROM v"
    )


def _detector(view: str, columns: list[str], count: str, flag: str):
    def run(spark, sf):
        rows = decide(column_evidence(messy(spark, sf, view), columns), int_like=False)
        return rows.select("column", F.col("values").alias("n"), F.col(count).alias("matches"), flag)

    return run


query("detect_email", per_column(
    "messy_customer", CUSTOMER_TEXT, _share("regexp_matches(v, '@.+\\.')", 10, 0.6, "is_email")
))(_detector("messy_customer", CUSTOMER_TEXT, "emails", "is_email"))
query("detect_phone", per_column(
    "messy_customer", CUSTOMER_TEXT, _share("regexp_matches(v, '^[0-9+\\-()\\s]{{7,}}$')", 10, 0.6, "is_phone")
))(_detector("messy_customer", CUSTOMER_TEXT, "phones", "is_phone"))
query("detect_ratio", per_column(
    "messy_part", PART_TEXT, _share("regexp_matches(v, '^\\s*[0-9]+\\s*/\\s*[0-9]+\\s*$')", 1, 0.2, "is_ratio")
))(_detector("messy_part", PART_TEXT, "ratios", "is_ratio"))
query("detect_currency", per_column(
    "messy_customer", CUSTOMER_TEXT, _share("v LIKE '$%'", 1, 0.2, "is_currency")
))(_detector("messy_customer", CUSTOMER_TEXT, "dollars", "is_currency"))


@query("detect_int_like", per_column(
    "messy_part", PART_TEXT,
    _share("regexp_matches(v, '^(?i)(inf|infinity|[0-9]+[a-z]?|[a-z]?[0-9]+)$')", 5, 0.8, "is_int_like"),
))
def _(spark, sf):
    rows = decide(column_evidence(messy(spark, sf, "messy_part"), PART_TEXT))
    return rows.select("column", F.col("values_0").alias("n"), F.col("int_like").alias("matches"), "is_int_like")


def _date_forms(year: str, separators: str) -> list[str]:
    """Day first, then month first, for each separator."""
    return [s.join((a, b, year)) for s in separators for a, b in (("%d", "%m"), ("%m", "%d"))]


_FULL = [s.join(("%Y", "%m", "%d")) for s in "-./"] + _date_forms("%Y", "-/")
_NAMED = [form for month in ("%b", "%B") for form in (f"%d {month} %Y", f"{month} %d %Y")] + ["%B %d, %Y"]
_DATE_SQL = f"""coalesce(try_strptime(d, {_FULL + _NAMED}),
    CASE WHEN regexp_matches(d, '^[0-9]{{{{1,2}}}}-[0-9]{{{{1,2}}}}-[0-9]{{{{2}}}}$') THEN try_strptime(d, {_date_forms('%y', '-')}) END,
    CASE WHEN regexp_matches(d, '^[0-9]{{{{2}}}}$') THEN try_strptime(d, '%y') END)"""
_DATE_FLAGS = f"""
    SELECT '{{c}}' AS "column", count(v) AS n, count(p) AS matches,
        count(v) >= 10 AND count(p) = count(v) AND count_if(NOT regexp_matches(v, '^[0-9]{{{{1,7}}}}$')) > 0.1 * count(v) AS is_date,
        count(p) >= 0.8 * count(v) AND count_if(NOT regexp_matches(v, '^[0-9]{{{{1,7}}}}$')) > 0.1 * count(v) AS is_date_like
    FROM (SELECT v, {_DATE_SQL.replace('{{', '{{{{').replace('}}', '}}}}')} AS p
        FROM (SELECT v, replace(regexp_replace(regexp_replace(v, '\\s+', ' ', 'g'), '([0-9]+)(st|nd|rd|th)', '\\1'), ' of ', ' ') AS d FROM v) AS a) AS b
""".replace("{{{{", "{{").replace("}}}}", "}}")


@query("detect_dates", per_column("messy_orders", ORDER_TEXT, _DATE_FLAGS))
def _(spark, sf):
    rows = decide(column_evidence(messy(spark, sf, "messy_orders"), ORDER_TEXT))
    return rows.select("column", F.col("values").alias("n"), F.col("dates").alias("matches"), "is_date", "is_date_like")


_PERSON_SQL = """
    SELECT '{c}' AS "column", coalesce(n >= 20 AND ats < 0.2 AND dig < 0.3 AND nam >= 0.6 AND (multi >= 0.5 OR NOT
        ((short_n >= 0.5 AND short_kinds <= 30) OR (kinds <= 50 AND most >= 0.15))), false) AS is_person
    FROM (SELECT count(v) AS n, avg(CAST(contains(v, '@') AS INT)) AS ats,
        avg(CAST(regexp_matches(v, '[0-9]') AS INT)) AS dig,
        avg(CAST(regexp_matches(v, '^[A-Za-z][A-Za-z.''\\-]*(\\s+[A-Za-z][A-Za-z.''\\-]*){{0,3}}$') AS INT)) AS nam,
        avg(CAST(regexp_matches(v, '\\s') AS INT)) AS multi, avg(CAST(length(v) <= 12 AS INT)) AS short_n,
        count(DISTINCT CASE WHEN length(v) <= 12 THEN v END) AS short_kinds, count(DISTINCT v) AS kinds,
        (SELECT max(c) FROM (SELECT count(v) AS c FROM v WHERE v IS NOT NULL GROUP BY v)) / count(v) AS most
        FROM v WHERE v IS NOT NULL) AS s
"""


@query("detect_person", per_column("messy_part", PART_TEXT, _PERSON_SQL))
def _(spark, sf):
    return person_columns(messy(spark, sf, "messy_part"), PART_TEXT)


@query("infer_coercion", with_view("messy_part", """
    SELECT * FROM (VALUES ('size', 'numeric'), ('quantity', 'numeric'), ('ratio', NULL), ('title', NULL), ('code', 'numeric'),
        ('person', NULL), ('price', NULL), ('weight', 'numeric')) AS t("column", leaning)
    WHERE (SELECT count(*) FROM m) >= 10
"""))
def _(spark, sf):
    return decide(column_evidence(messy(spark, sf, "messy_part"), PART_TEXT)).select("column", "leaning")


_ID_SQL = """
    SELECT '{c}' AS "column", total >= 5 AND tokens AND lengths <= 3 AND modal >= 0.85 * total AS is_id FROM (
        SELECT sum(n) AS total, bool_and(t) AS tokens, count(*) AS lengths, max(n) AS modal FROM (
            SELECT length(v) AS l, count(*) AS n, bool_and(regexp_full_match(v, '[a-zA-Z0-9_-]+') AND length(v) <= 64) AS t
            FROM (SELECT {t} AS v FROM m) AS a WHERE v <> '' GROUP BY 1) AS b) AS c
"""
CODE_TEXT = ["country", "segment", "code", "plain"]


@query("detect_id", with_view("messy_codes", " UNION ALL ".join(
    _ID_SQL.format(c=c, t=sql_trim(c)) for c in CODE_TEXT
)))
def _(spark, sf):
    return id_like_columns(text_frequencies(messy(spark, sf, "messy_codes"), CODE_TEXT))


_CONSISTENT_SQL = """
    SELECT '{c}' AS "column", (SELECT is_id FROM ({id}) AS i) OR avg(CAST(regexp_matches(v, '@.+\\.') AS INT)) >= 0.5 OR NOT (
        bool_and(v = lower(v) AND v <> upper(v))
        OR (avg(CAST(regexp_matches(v, '[0-9]') AS INT)) > 0 AND avg(CAST(regexp_matches(v, '[0-9]') AS INT)) < 0.5)
        OR (SELECT max(k) FROM (SELECT count(DISTINCT v) AS k FROM (SELECT {t} AS v FROM m) AS a WHERE v <> ''
            GROUP BY regexp_replace(lower(v), '\\s+', ' ', 'g')) AS b) > 1) AS is_consistent
    FROM (SELECT {t} AS v FROM m) AS a WHERE v <> ''
"""


@query("text_consistency", with_view("messy_codes", " UNION ALL ".join(
    _CONSISTENT_SQL.format(c=c, t=sql_trim(c), id=_ID_SQL.format(c=c, t=sql_trim(c))) for c in CODE_TEXT
)))
def _(spark, sf):
    return consistency(text_frequencies(messy(spark, sf, "messy_codes"), CODE_TEXT))


_PARSED = _DATE_SQL.replace("{{", "{").replace("}}", "}")
_KIND_SQL = f"""
    SELECT '{{c}}' AS "column", CASE WHEN count(v) = 0 THEN {{none}}
        WHEN count(try_cast(replace(replace(v, ',', ''), ' ', '') AS DOUBLE)) >= 0.9 * count(v) THEN 'numeric'
        WHEN count({_PARSED.replace('{', '{{').replace('}', '}}')}) >= 0.8 * count(v) THEN 'datetime'
        ELSE {{rest}} END AS {{out}}
    FROM (SELECT v, trim(replace(regexp_replace(regexp_replace(v, '\\s+', ' ', 'g'), '([0-9]+)(st|nd|rd|th)', '\\1'), ' of ', ' ')) AS d
        FROM (SELECT CAST({{c}} AS VARCHAR) AS v FROM m) AS a) AS b
"""
_STORED_SQL = """SELECT '{c}' AS "column", CASE WHEN typeof(any_value({c})) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'datetime' END AS {out} FROM m"""
_FEW = "CASE WHEN count(DISTINCT v) <= 50 AND count(v) >= 10 AND count(DISTINCT v) <= count(v) // 2 THEN 'categorical' ELSE 'text' END"


@query("infer_types", with_view("messy_orders", " UNION ALL ".join(
    [_KIND_SQL.format(c=c, none="'text'", rest=_FEW, out="inferred_type") for c in ORDER_TEXT]
    + [_STORED_SQL.format(c=c, out="inferred_type") for c in ("id", "true_date")]
)))
def _(spark, sf):
    return infer_types(messy(spark, sf, "messy_orders"))


@query("fallback_types", with_view("messy_part", " UNION ALL ".join(
    [_KIND_SQL.format(c=c, none="'string'", rest="'string'", out="target_type") for c in PART_TEXT] + [_STORED_SQL.format(c="id", out="target_type")]
)))
def _(spark, sf):
    return fallback_types(messy(spark, sf, "messy_part"))


@query("loose_numbers", with_view("messy_customer", """
    SELECT id, CAST(replace(trim(replace(balance, '$', '')), ',', '') AS DOUBLE) AS balance FROM m
"""))
def _(spark, sf):
    df = messy(spark, sf, "messy_customer")
    return df.select("id", to_loose_number(F.replace("balance", F.lit("$"), F.lit(""))).alias("balance"))
