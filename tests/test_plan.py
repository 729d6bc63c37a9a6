"""Fitted plans: decisions, whole-table results and the shape of the Spark plan."""

import datetime as dt

from pyspark.sql import functions as F

from limewash import Cleaner, clean
from limewash.functions.dates import add_dates
from limewash.operators import rows as R
from limewash.plans.batch import analyse


def kinds(df):
    return dict(df.dtypes)


def column(df, name):
    return [r[0] for r in df.select(f"`{name}`").collect()]


def test_clean_end_to_end(spark, frame):
    df = frame(city=["Oslo ", "Bergen", " Oslo", "n/a", "Bergen\t"], floors=["7", " 12", "7 ", "", "12"])
    result = Cleaner().fit(df).run(df)
    assert sorted(map(tuple, result.df.collect())) == [("Bergen", 12), ("Oslo", 7)]
    assert result.row_counts() == {"rows_in": 5, "rows_filled": 4, "rows_out": 2}
    steps = result.steps_applied()
    assert {"trim_whitespace", "remove_duplicates", "drop_empty_rows"} <= set(steps)
    done = frame(city=["Oslo", "Bergen"], floors=["x1y", "x2y"])
    again = Cleaner().fit(done).run(done)
    assert again.df.count() == 2 and "remove_duplicates" not in again.steps_applied()


def test_empty_rows_and_columns(spark, frame):
    df = spark.createDataFrame([(None, None, "z"), (None, None, None), (7, None, None)], "n int, void int, t string")
    assert sorted(map(tuple, R.drop_empty_rows(df).collect()), key=str) == [(7, None, None), (None, None, "z")]
    assert R.drop_empty_rows(frame(p=["nan", "here"], q=["nan", None])).count() == 1
    assert R.drop_empty_columns(df).columns == ["n", "t"]
    twice = spark.createDataFrame([(5, 6, None)], "u int, v int, w int").toDF("u", "u", "")
    assert R.drop_empty_columns(twice).columns == ["u"]
    assert clean(frame(p=["kept", "  ", "null"], q=["", "-", "N/A"])).count() == 1


def test_filters_on_other_columns_reach_the_scan(spark, tmp_path):
    rows = [(i, f" {20 + i % 9} ", f"{i % 28 + 1:02d}/03/2021", f"v{i}") for i in range(60)]
    spark.createDataFrame(rows, "id int, amount string, day string, note string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cleaned = Cleaner(headers=False).fit(df).transform(df)
    plan = cleaned.where("id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(id,5)" in plan
    assert cleaned.where("id = 5").count() == 1 and cleaned.where("amount = 25").count() == 7
    dated = add_dates(df, {"day": F.col("day")}).where("id = 5")
    assert "EqualTo(id,5)" in dated._jdf.queryExecution().toString()
    on_cell = cleaned.where("amount > 25")._jdf.queryExecution().optimizedPlan().toString()
    once = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert on_cell.count("RLIKE") == once.count("RLIKE")


def test_small_ages_are_numbers_not_dates(frame):
    out = clean(frame(age=[str(20 + i) for i in range(12)]))
    assert kinds(out) == {"Age": "bigint"}


def test_dates_with_gaps(frame):
    values = [f"2020-01-{i + 1:02d}" for i in range(12)] + [None] * 6
    out = clean(frame(k=[f"r{i}x" for i in range(18)], d=values), Cleaner(headers=False))
    assert kinds(out)["d"] == "timestamp_ntz"
    assert column(out, "d").count(None) == 6


def test_phone_numbers_stay_text(frame):
    values = ["+1 555 123 4567"] * 11 + ["+1 555 123 4568"]
    out = clean(frame(phone=values), Cleaner(headers=False))
    assert kinds(out) == {"phone": "string"}
    assert sorted(set(column(out, "phone"))) == sorted(set(values))


def test_plain_decimals_skip_the_ladder(frame):
    out = clean(frame(k=["a1b", "b2c", "c3d"], v=["0.125", "0.5", ""]), Cleaner(headers=False))
    assert sorted(column(out, "v"), key=str) == [0.125, 0.5, None]


def test_null_word_in_numeric_column(frame):
    out = clean(frame(k=["ab", "cd", "ef"], v=["1", "N/A", "3"]), Cleaner(headers=False))
    assert kinds(out)["v"] == "bigint"


def test_no_value_is_lost_by_coercion(frame):
    values = [str(i) for i in range(11)] + ["oops"]
    assert kinds(clean(frame(v=values), Cleaner(headers=False))) == {"v": "string"}
    lossy = clean(frame(v=values), Cleaner(headers=False, lossy_numbers=True))
    assert kinds(lossy) == {"v": "bigint"} and lossy.count() == 11  # the emptied row goes


def test_int_like_column_and_infinity(frame):
    df = frame(k=list("abcdef"), v=["1c", "m2", "3", "inf", "5", "6"])
    out = clean(df, Cleaner(headers=False))
    assert sorted(column(out, "v"), key=str) == sorted([1, 2, 3, None, 5, 6], key=str)
    kept = clean(df, Cleaner(headers=False, int_like=False))
    assert kinds(kept)["v"] == "string"


def test_currency_is_detected_before_the_sign_goes(frame):
    df = frame(v=["$1,200", "$ 3,400", "$5"])
    plan = Cleaner(headers=False).fit(df)
    assert plan.currency_columns == ["v"]
    assert sorted(column(plan.transform(df), "v")) == [5, 1200, 3400]


def test_large_integers_are_exact(frame):
    out = clean(frame(v=["9007199254740993", "9223372036854775807", "1"]), Cleaner(headers=False))
    assert sorted(column(out, "v")) == [1, 9007199254740993, 9223372036854775807]


def test_odd_column_names(frame):
    out = clean(frame(**{"a.b c": ["1", "2"], "x`y": [" p ", "q"]}))
    assert out.columns == ["A.B C", "X`Y"] and out.count() == 2


def test_cleaning_twice_changes_nothing(spark):
    from limewash.catalog.messy import messy
    df = messy(spark, "/root/testdata/sf0.001", "messy_part")
    once = clean(df)
    twice = clean(once)
    assert kinds(once) == kinds(twice)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    from limewash.catalog.messy import messy
    df = messy(spark, "/root/testdata/sf0.001", "messy_customer")
    a, b = clean(df.repartition(2)), clean(df.repartition(16))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_is_native_with_one_shuffle(spark, frame):
    df = frame(**{f"c{i}": ["$1,2", "x"] for i in range(4)})
    text = plan_text(clean(df))
    assert "Python" not in text and text.count("Exchange hashpartitioning") == 1


def test_filters_are_not_copied_into_the_cell_work(frame):
    df = frame(v=["05/01/2020"] * 12, w=["$ 1,200"] * 12)
    out = Cleaner(headers=False).fit(df).transform(df).where(F.col("w") > 5)
    assert len(plan_text(out)) < 60_000
    parsed = add_dates(df, {"d": F.col("v")}).where(F.col("d").isNotNull())
    assert len(plan_text(parsed)) < 30_000


def test_number_of_jobs_does_not_grow_with_columns(spark, frame):
    tracker = spark.sparkContext.statusTracker()

    def jobs(width):
        df = frame(**{f"c{i}": ["$1,2", "x", "2020-01-01"] for i in range(width)})
        group = f"fit-{width}"
        spark.sparkContext.setJobGroup(group, group)
        Cleaner().fit(df)
        spark.sparkContext.setJobGroup("other", "other")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(2) == jobs(40)


def test_analyse_scores_between_0_and_100(frame):
    result = analyse(frame(a=["x", "y", ""], b=["1", "2", "3"]))
    row = result.quality.first()
    assert all(0 <= v <= 100 for v in row)


def test_dates_match_true_dates(spark):
    from limewash.catalog.messy import messy
    df = clean(messy(spark, "/root/testdata/sf0.001", "messy_orders"), Cleaner(headers=False))
    assert df.where(~F.col("order_date").eqNullSafe(F.col("true_date"))).count() == 0
    assert df.agg(F.min("order_date")).first()[0] > dt.datetime(1980, 1, 1)
