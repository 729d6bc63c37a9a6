"""Profiles, exact quantiles, patterns, issues, scores, suspicious values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limewash.operators.detectors import column_evidence, type_evidence
from limewash.operators.issues import actionable_issues, detect_issues, issue_batch, quality_score
from limewash.operators.profiling import (
    cell_summary,
    distinct_counts, infer_types, missingness_patterns, outlier_stats, profile_dataset, redundant_pairs, schema_table,
)
from limewash.operators.quantiles import exact_quantiles
from limewash.operators.suspicious import short_codes, suspicious_values, text_consistency, text_frequencies


@pytest.mark.parametrize("sortable", [5, 60, 1_000_000])
def test_exact_quantiles_at_any_bound(spark, sortable):
    rng = random.Random(3)
    skewed = [7.0] * 900 + [rng.uniform(-5, 50) for _ in range(1800)]
    whole = [float(rng.randrange(40)) for _ in range(2700)]
    df = spark.createDataFrame(list(zip(skewed, whole)), "a double, b double")
    probabilities = [0.0, 0.25, 0.333, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["a", "b"], probabilities, {"a": 2700, "b": 2700}, sortable=sortable)
    assert got["a"] == pytest.approx(list(np.quantile(skewed, probabilities)))
    assert got["b"] == pytest.approx(list(np.quantile(whole, probabilities)))


def test_outliers(spark):
    values = [float(i) for i in range(40)] + [1000.0, None]
    df = spark.createDataFrame([(v, 5) for v in values], "v double, c int")
    stats = {s["column"]: s for s in outlier_stats(df)}
    assert (stats["v"]["count_below"], stats["v"]["count_above"], stats["v"]["z_count"]) == (0, 1, 1)
    constant = stats["c"]
    assert (constant["lower_bound"], constant["upper_bound"], constant["max_abs_z"]) == (5.0, 5.0, 0.0)


@pytest.mark.parametrize("below, above", [(0, 3), (10, 0), (90, 0), (40, 70), (150, 150)])
def test_infinities_count_alike_on_every_path(spark, below, above):
    rng = random.Random(5)
    values = [rng.uniform(-9, 9) for _ in range(203)] + [float("-inf")] * below + [float("inf")] * above + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n = {"v": 203 + below + above}
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    direct = exact_quantiles(df, ["v"], probabilities, n, sortable=10**6)["v"]
    ranked = sorted(v for v in values if v is not None and v == v)
    for p, got in zip(probabilities, direct):
        if (p * (n["v"] - 1)).is_integer():
            assert got == ranked[int(p * (n["v"] - 1))]
    for sortable in (3, 40, 250):
        assert repr(exact_quantiles(df, ["v"], probabilities, n, sortable=sortable)["v"]) == repr(direct)
    stats = outlier_stats(df)[0]
    low, high = stats["lower_bound"], stats["upper_bound"]
    finite = [v for v in values if v is not None]
    assert stats["count_below"] == sum(v < low for v in finite) and stats["count_above"] == sum(v > high for v in finite)
    assert (stats["z_count"], stats["max_abs_z"]) == (0, 0.0)


def test_constant_column_has_no_pair(spark):
    df = spark.createDataFrame([(i, 2 * i, 1, None if i % 3 else i) for i in range(30)], "a int, b int, c int, d int")
    pairs = {(r.col_a, r.col_b): r.correlation for r in redundant_pairs(df).collect()}
    assert pairs == {("a", "b"): 1.0, ("a", "d"): 1.0, ("b", "d"): 1.0}


def test_types(spark, frame):
    df = frame(
        n=["1,234", "5", "6"] * 5, d=["2020-01-01", "5 Jan 2020", "x"] * 5, c=["a", "b", "a"] * 5,
        t=[f"t{i}x" for i in range(15)], e=[None] * 15,
    ).withColumn("flag", F.lit(True)).withColumn("k", F.lit(1))
    got = {r["column"]: r.inferred_type for r in infer_types(df).collect()}
    # two thirds of the dates parse, which is below the bound, so the column is a category
    assert got == {
        "n": "numeric", "d": "categorical", "c": "categorical", "t": "text", "e": "text",
        "flag": "categorical", "k": "numeric",
    }


def test_distinct_counts_by_storage_type(spark):
    df = spark.createDataFrame([(1, 0.0, "a", True), (1, -0.0, "b", None), (2, 1.5, None, False)],
                               "i int, d double, s string, b boolean")
    got = {r["column"]: r.distinct_values for r in distinct_counts(df).collect()}
    assert got == {"i": 2, "d": 2, "s": 2, "b": 2}


def test_missingness_pattern(spark):
    rows = [("intern" if i % 5 == 0 else "staff", None if i % 5 == 0 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "role string, salary int")
    row = missingness_patterns(df).first()
    assert tuple(row) == ("salary", "role", "intern", 100.0, 20.0)


def test_profile_and_issues(spark):
    rows = [(i, "x", None if i % 10 < 7 else 1.5, str(i % 3) if i % 20 else "zz") for i in range(60)] + [(0, "x", None, "zz")]
    df = spark.createDataFrame(rows, "id int, one string, gap double, mixed string")
    p = profile_dataset(df)
    assert (p.rows, p.columns, p.duplicate_rows) == (61, 4, 1)
    issues = detect_issues(p)
    found = {r.id: r for r in issues.collect()}
    assert {"missing::gap", "constant::one", "constant::gap", "mixed::mixed", "duplicates::dataset",
            "type_validation::id", "text_quality::one"} <= set(found)
    assert found["missing::gap"].severity == "error"
    assert found["mixed::mixed"].suggestions[0].params == {"column": "mixed", "target_type": "numeric"}
    assert found["duplicates::dataset"].suggestions[0].safe
    row = quality_score(p, issues).first()
    assert row.consistency == 75.0 and row.validity == 95.0 and 0 < row.score < 100
    assert [r.id for r in issue_batch(actionable_issues(issues, df)).collect()][0] == "mixed::mixed"


def test_high_cardinality_text(frame):
    issues = detect_issues(profile_dataset(frame(t=[f"word {i}x" for i in range(150)])))
    assert "cardinality::t" in {r.id for r in issues.collect()}


def test_schema_table_counts_null_words(frame):
    row = schema_table(frame(a=["x", "N/A", "", "y"])).first()
    assert tuple(row) == ("a", "string", 2, 50.0)


def test_suspicious_values(frame):
    countries = ["USA"] * 60 + ["US"] * 5 + ["US."] * 3 + ["usa"] * 2 + ["Italy1"] * 2 + ["LÃ©on", "La vita B9 bella"]
    found = {r.value: r.rule for r in suspicious_values(frame(c=countries)).collect()}
    assert found == {
        "LÃ©on": "mojibake", "La vita B9 bella": "hex_byte", "Italy1": "stray_digits", "usa": "punctuation",
        "US.": "punctuation", "US": "short_code",
    }


def test_identifier_columns_are_not_suspicious(frame):
    assert suspicious_values(frame(c=[f"tt{1000 + i}" for i in range(30)])).count() == 0


def test_short_codes_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [("c", "".join(rng.choice("ab") for _ in range(rng.randint(1, 6))), rng.randint(1, 40)) for _ in range(60)]
    freq = {v: n for _, v, n in rows}
    want = {
        s for s, n in freq.items() if 2 <= len(s) <= 3
        and any(len(k) > len(s) and k.startswith(s) and m >= 3 * n for k, m in freq.items())
    }
    df = spark.createDataFrame([("c", v, n) for v, n in freq.items()], "column string, value string, n bigint")
    assert {r.value for r in short_codes(df).collect()} == want


def test_text_consistency(frame):
    df = frame(
        ids=[f"tt{100 + i}" for i in range(12)], same=["USA", "UK", "FR"] * 4, mixed=["USA", "usa", "FR"] * 4,
        lower=["a b", "c d", "e f"] * 4, mail=["A@x.org", "b@x.org", "c@x.org"] * 4, digit=["It1", "Fr", "De"] * 4,
    )
    got = {r["column"]: r.is_consistent for r in text_consistency(text_frequencies(df)).collect()}
    assert got == {"ids": True, "same": True, "mixed": False, "lower": False, "mail": True, "digit": False}


def jobs(spark, name, run):
    """How many jobs a run starts, and what it returns."""
    group = f"{name}-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def wide_table(spark, columns, rows=300):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(rows, columns)) * 10.0 ** rng.integers(-6, 7, columns) + 10.0 ** rng.integers(0, 9, columns)
    base[:, 1] = -3 * base[:, 0] + 1e-9
    base[:, 2] = base[:, 0] + rng.normal(size=rows) * base[:, 0].std() * 0.02
    base[:, 3] = 0.1
    data = [[None if rng.random() < 0.1 and j > 3 else float(x) for j, x in enumerate(row)] for row in base]
    for i in range(rows):
        data[i][4] = None if data[i][0] is None else float(i) if i % 2 else None
        data[i][5] = 2.0 * i if i % 2 else (None if i % 4 else 7.0)
    data[0][6] = float("inf")
    data[1][7] = float("nan")
    return spark.createDataFrame(data, ", ".join(f"c{j} double" for j in range(columns))), data


def correlations(data, least=0.99):
    """Pair by pair over the rows that have both."""
    columns = [np.array([np.nan if x is None else x for x in c]) for c in zip(*data)]
    out = {}
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            both = ~np.isnan(a) & ~np.isnan(columns[j])
            x, y = a[both], columns[j][both]
            if len(x) and np.isfinite(x).all() and np.isfinite(y).all() and len(set(x)) > 1 and len(set(y)) > 1:
                x, y = x - x.mean(), y - y.mean()
                r = (x * y).mean() / np.sqrt((x * x).mean() * (y * y).mean())
                if abs(r) >= least:
                    out[f"c{i}", f"c{j}"] = round(float(r), 4)
    return out


@pytest.mark.parametrize("block", [256, 9])
def test_correlations_by_blocks(spark, block):
    df, data = wide_table(spark, 40)
    got = {(r.col_a, r.col_b): r.correlation for r in redundant_pairs(df.repartition(5), block=block).collect()}
    want = correlations(data)
    assert got == want and {("c0", "c1"), ("c0", "c2")} <= set(want) and not any("c3" in p or "c6" in p for p in want)


def test_correlations_far_from_zero(spark):
    """Deviations many digits below the mean, an outlier that only some pairs see, and values without any spread."""
    rows = [(1e9 + i % 7 * 1e-3, 5e8 + i % 7 * 1e-3, None if i == 3 else float(i % 7), 0.3, 1e12 if i == 3 else float(i % 7)) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r.col_a, r.col_b): r.correlation for r in redundant_pairs(df).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "e"): 1.0}


def test_jobs_of_pairs_do_not_depend_on_the_number_of_columns(spark):
    few, _ = wide_table(spark, 8, 30)
    many, data = wide_table(spark, 200, 30)
    one, _ = jobs(spark, "few", lambda: redundant_pairs(few).collect())
    two, got = jobs(spark, "many", lambda: redundant_pairs(many).collect())
    want = correlations(data)
    assert one == two and {(r.col_a, r.col_b) for r in got} == set(want)


def test_digests_do_not_grow_with_the_texts(spark):
    rows = [(i, f"v{i % 50}", None if i % 3 else "x") for i in range(300)] + [(0, "v0", "x")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    long = df.withColumn("t", F.repeat("t", 1000))
    for table in (df, long):
        assert {r["column"]: r.distinct_values for r in distinct_counts(table).collect()} == {"id": 300, "t": 50, "u": 1}
    from limewash.operators.rows import duplicate_count

    assert tuple(duplicate_count(long).first()) == (301, 300, 1)
    shuffled = distinct_counts(long)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" in shuffled and not any("t#" in line for line in shuffled.splitlines() if "Aggregate" in line)


def test_equal_rows_and_digests(spark):
    rows = [(None, "a"), ("a", None), ("", "a"), ("a", ""), ("ab", "c"), ("a", "bc"), (None, None), (None, None), ("", None)]
    from limewash.operators.rows import duplicate_count

    assert tuple(duplicate_count(spark.createDataFrame(rows, "a string, b string")).first()) == (9, 8, 1)
    assert tuple(duplicate_count(spark.createDataFrame([], "a string")).first()) == (0, 0, 0)


def test_profile_reads_its_table_five_times_at_most(spark):
    rows = [(i, float(i % 9), None if i % 4 == 0 else f"w {i % 5}x", "gap" if i % 4 == 0 else "full", f"{i % 40},5") for i in range(400)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    schema = "k int, v double, t string, s string, n string"
    p = profile_dataset(spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(counted, schema))
    got = {r.column: r for r in p.column_profiles.collect()}
    assert (p.rows, p.duplicate_rows, got["n"].inferred_type, got["s"].inferred_type) == (400, 0, "numeric", "categorical")
    assert got["t"].missingness_pattern.when_value == "gap" and got["v"].outliers_iqr.lower_bound == -4.0
    assert reads.value == 5  # counts and types, moments and quartiles, outliers, patterns, pairs
    p.redundant_pairs.count()
    assert reads.value == 5


def test_values_are_judged_once_with_long_ones_as_their_cells(frame):
    """Dates and numbers are read behind the grouping of equal values; as cell by cell, also where texts are long."""
    texts = ["1" * 70, "1" * 70 + ".5", "1" + " " * 70 + "January 2020", "1 " + " " * 70 + "January 2020", "1" + "\t" * 70 + "2",
             " " * 70 + "2020-01-05" + " " * 70, "1 " * 40, "x" * 100, "5", "5", "5.5", "2020-01-05", "", None, "a" * 64 + " 1"]
    df = frame(t=texts, u=[*texts[1:], texts[0]])
    summary = cell_summary(df)
    got = {r["id"]: r for r in summary.collect()}
    for i, name in enumerate(df.columns):
        want = type_evidence(df, [name]).first()
        assert [got[i][x] for x in ("numbers", "dates", "fractions")] == [want[x] for x in ("numbers", "dates", "fractions")]
        assert got[i]["present"] == 14 and got[i]["distinct_values"] == 13
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp_ntz" in plan and "timestamp_ntz" not in plan[plan.rindex("Aggregate ["):]


def test_evidence_of_columns_is_weighed_by_value(frame):
    """Repeated values count as often as they stand; they meet before dates and numbers are read."""
    once = ["1/2/2020", "7", "x@y.zz", "N/A", " 3 ", None, "", "5c", "$ 1,000", "Ann Lee"]
    single, many = column_evidence(frame(t=once)).first().asDict(), column_evidence(frame(t=once * 9)).first().asDict()
    assert single["cells"] == 10 and single["nulled"] == 2
    assert {k: v if k == "column" else 9 * v for k, v in single.items()} == many
    plan = column_evidence(frame(t=once))._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp_ntz" in plan and "timestamp_ntz" not in plan[plan.rindex("Aggregate ["):]
