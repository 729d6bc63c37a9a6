"""Messy views of the given tables, in SQL that Spark and DuckDB read alike.

The given tables are clean. Each view spoils some columns by arithmetic on the key, so that both
engines derive the same mess from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from limewash.session import materialise

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_MONTH = (
    "CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' "
    "WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' "
    "WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END"
)
_Y = "CAST(year(o_orderdate) AS STRING)"
_M = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_D = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
_D1 = "CAST(day(o_orderdate) AS STRING)"
_FIRST = "CASE k % 5 WHEN 0 THEN 'david' WHEN 1 THEN 'emily' WHEN 2 THEN 'maria' WHEN 3 THEN 'o''neil' ELSE 'jean-luc' END"
_LAST = "CASE k % 7 WHEN 0 THEN 'lee' WHEN 1 THEN 'DAVIS' WHEN 2 THEN 'mcdonald' WHEN 3 THEN 'Garcia' WHEN 4 THEN 'smith' WHEN 5 THEN 'di rossi' ELSE 'park' END"

_CUSTOMER = """
    SELECT c_custkey AS id,
        CASE WHEN c_custkey % 5 = 0 THEN '  ' || c_name || ' '
             WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS name,
        CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN ' none '
             WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN c_mktsegment || '.'
             WHEN c_custkey % 23 = 0 THEN c_mktsegment || '1'
             WHEN c_custkey % 3 = 0 THEN ' ' || c_mktsegment || '  ' ELSE c_mktsegment END AS segment,
        CASE WHEN c_custkey % 3 = 0 THEN ' User' ELSE 'user' END || CAST(c_custkey AS STRING) || '@'
            || CASE WHEN c_custkey % 4 = 0 THEN 'Mail.Example.COM' ELSE 'mail.example.com' END AS email,
        '+1 555 ' || CAST(1000000 + c_custkey AS STRING) AS phone,
        CASE WHEN c_custkey % 4 = 0 THEN '$ ' ELSE '$' END || CAST(c_custkey % 900 + 1 AS STRING) || ','
            || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') AS balance,
        CAST(c_nationkey AS STRING) AS nation,
        CAST(NULL AS STRING) AS empty_col
    FROM customer
"""

VIEWS = {
    "messy_customer": f"{_CUSTOMER} UNION ALL {_CUSTOMER} WHERE c_custkey % 10 = 0",
    "messy_orders": f"""
        SELECT o_orderkey AS id,
            CASE o_orderkey % 7
                WHEN 0 THEN {_Y} || '-' || {_M} || '-' || {_D}
                WHEN 1 THEN {_D} || '/' || {_M} || '/' || {_Y}
                WHEN 2 THEN {_D1} || ' ' || substr({_MONTH}, 1, 3) || ' ' || {_Y}
                WHEN 3 THEN {_MONTH} || ' ' || {_D1} || ', ' || {_Y}
                WHEN 4 THEN {_D} || '-' || {_M} || '-' || substr({_Y}, 3, 2)
                WHEN 5 THEN ' ' || {_Y} || '/' || {_M} || '/' || {_D} || ' '
                ELSE {_D1} || 'th of ' || {_MONTH} || '  ' || {_Y} END AS order_date,
            CASE WHEN o_orderkey % 50 = 0 THEN '1984-02-34' WHEN o_orderkey % 30 = 0 THEN 'NA'
                ELSE {_Y} || '-' || {_M} || '-' || {_D} END AS ship_date,
            CAST(20 + o_orderkey % 12 AS STRING) AS age,
            CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderkey % 10 = 0 THEN NULL
                ELSE o_orderstatus END AS status,
            o_orderpriority AS priority,
            o_orderdate AS true_date
        FROM orders
    """,
    "messy_part": f"""
        SELECT id,
            CASE WHEN k % 40 = 2 THEN 'inf' WHEN k % 4 = 0 THEN CAST(n AS STRING) || 'c'
                WHEN k % 4 = 1 THEN 'm' || CAST(n AS STRING) ELSE CAST(n AS STRING) END AS size,
            CASE k % 5 WHEN 0 THEN 'forty' WHEN 1 THEN 'SIXTY THOUSAND' WHEN 2 THEN ' one hundred'
                WHEN 3 THEN '75' ELSE 'Seven Hundred' END AS quantity,
            CAST(k % 90 + 60 AS STRING) || '/' || CAST(k % 50 + 40 AS STRING) AS ratio,
            CASE WHEN k % 97 = 0 THEN replace(p_name, ' ', ' B9 ')
                WHEN k % 89 = 0 THEN p_name || ' LÃ©on' WHEN k % 83 = 0 THEN p_name || '7'
                ELSE p_name END AS title,
            'P' || lpad(CAST(k AS STRING), 8, '0') AS code,
            {_FIRST} || ' ' || {_LAST} AS person,
            CASE k % 12 WHEN 0 THEN '$ 1.' || CAST(n + 100 AS STRING) || ',5' WHEN 1 THEN CAST(n AS STRING) || '.473'
                WHEN 2 THEN CAST(n AS STRING) || '.7.' WHEN 3 THEN '0' || CAST(n AS STRING) || '.9'
                WHEN 4 THEN '-' || CAST(n AS STRING) || ' ' WHEN 5 THEN CAST(n AS STRING) || '%'
                WHEN 6 THEN '24/' || CAST(n AS STRING) WHEN 7 THEN '$ 4o' || CAST(n + 100 AS STRING)
                WHEN 8 THEN CAST(n + 100 AS STRING) || ',' || CAST(n + 200 AS STRING) || '.25'
                WHEN 9 THEN CAST(n AS STRING) || ':5f' WHEN 10 THEN 'Se7en' ELSE '10-' || CAST(n AS STRING)
                END AS price,
            CASE WHEN k % 25 = 3 THEN 'unknown' WHEN k % 25 = 4 THEN NULL
                ELSE CAST(n + 1000 AS STRING) || '.50' END AS weight
        FROM (SELECT p_partkey AS id, p_partkey AS k, p_partkey % 50 + 1 AS n, p_name FROM part) AS p
    """,
    "messy_codes": """
        SELECT c_custkey AS id,
            CASE WHEN c_custkey % 40 = 0 THEN 'US' WHEN c_custkey % 40 = 1 THEN 'US.'
                WHEN c_custkey % 40 = 2 THEN 'usa' WHEN c_custkey % 40 = 3 THEN 'Italy1'
                WHEN c_custkey % 100 = 7 THEN 'Perú ' WHEN c_custkey = 11 THEN 'Francce'
                ELSE 'USA' END AS country,
            CASE WHEN c_custkey % 50 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment,
            'C' || CAST(1000000 + c_custkey AS STRING) AS code,
            c_mktsegment AS plain
        FROM customer
    """,
    "messy_numeric": """
        SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(floor(l_quantity) AS BIGINT) AS qty,
            CAST(2 * floor(l_quantity) AS BIGINT) AS qty_x2, 1 AS constant,
            CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 100
                ELSE l_extendedprice END AS price,
            l_discount AS discount,
            CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END AS status,
            l_returnflag AS flag
        FROM lineitem
    """,
    "wide_null_rows": """
        SELECT CASE WHEN event_id % 20 = 0 THEN NULL ELSE event_id END AS id,
            CASE WHEN event_id % 40 = 0 THEN '  ' WHEN event_id % 20 = 0 THEN 'nan'
                WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind,
            CASE WHEN event_id % 60 = 0 THEN 'NaN ' WHEN event_id % 20 = 0 THEN NULL ELSE props END AS props
        FROM events
    """,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of few splits out to all cores; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def messy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: spread(table(spark, sf_dir, t)) for t in used})


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A messy view as a written table, for work that reads its input many times."""
    return materialise(messy(spark, sf_dir, name), name)


def with_view(name: str, sql: str) -> str:
    """Oracle SQL over a messy view, available as ``m``."""
    return f"WITH m AS ({VIEWS[name]}) {sql}"
