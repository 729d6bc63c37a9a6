"""Files in and out, actions, fixes, responses, batch run, stream."""

import json
import os

from pyspark.sql import functions as F

from limewash import Cleaner
from limewash.operators import actions as A
from limewash.operators import recommendations as R
from limewash.plans.batch import run
from limewash.operators import actions
from limewash.operators.recommendations import parse_responses
from limewash.sources.delimited import export_format, header_names, load_csv, preview, rejected_lines, save_csv, sniff_separator
from limewash.streaming.clean_stream import clean_stream


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_separator():
    assert [sniff_separator(s) for s in ("a;b", "a,b", "a;b,c", "a,b,c;d", "a")] == [";", ",", ";", ",", ";"]


def test_header_names():
    assert header_names("a;;a; b ", ";") == ["a", "Unnamed: 1", "a.1", "b"]


def test_short_and_wide_lines(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a;b;c\n1;2;3\n4;5\n6;7;8;9\n"x;y";N/A;\n')
    df, sep = load_csv(spark, path)
    assert sep == ";"
    assert rows(df) == rows(spark.createDataFrame([("1", "2", "3"), ("4", "5", None), ("x;y", "N/A", None)], "a string, b string, c string"))


def test_thousands_comma(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,qty,price,name\n1,1,000,5,x\n2,5,0,y\n3,2,500,1,999,z\n")
    df, _ = load_csv(spark, path)
    assert df.columns == ["id", "qty", "price", "name"]
    assert rows(df) == [("1", "1000", "5", "x"), ("2", "5", "0", "y"), ("3", "2500", "1999", "z")]


def test_unexplained_overflow_is_kept(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n1,2\n3,4,left over\n")
    df, _ = load_csv(spark, path)
    assert df.columns == ["a", "b", "Unnamed_0"] and ("3", "4", "left over") in rows(df)


def test_latin_1(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Größe;b\né;2\n", "latin-1")
    df, _ = load_csv(spark, path)
    assert df.columns == ["Größe", "b"] and rows(df) == [("é", "2")]


def test_quotes_decide_width_header_and_records(spark, tmp_path):
    prose = ", ".join(f"w{i}" for i in range(41))
    path = write(tmp_path, "a.csv", f'"last, first",age\n"Roe, Jo",7\n"{prose}",8\n"two\nlines",9\n')
    df, sep = load_csv(spark, path)
    assert sep == "," and df.columns == ["last, first", "age"]
    assert rows(df) == rows(spark.createDataFrame([("Roe, Jo", "7"), (prose, "8"), ("two\nlines", "9")], "a string, b string"))


def test_encoding_is_judged_per_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("n;v\né;1\n".encode())
    (tmp_path / "in" / "b.csv").write_bytes("v;n\n2;ü\n".encode("latin-1"))
    path = str(tmp_path / "in")
    df, _ = load_csv(spark, path)
    assert df.columns == ["n", "v"] and rows(df) == [("é", "1"), ("ü", "2")]
    assert rows(load_csv(spark, path, latin1=False)[0]) == [("é", "1"), ("\ufffd", "2")]


def test_rejected_lines_are_returned(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a;b\n1;2\n3;4;5\n"x;y";6\n')
    assert load_csv(spark, path)[0].count() == 2
    assert [(r.fields, r.line) for r in rejected_lines(spark, path).collect()] == [(3, "3;4;5")]
    assert rejected_lines(spark, write(tmp_path, "b.csv", "a,b\n1,2,3\n")).count() == 0


def test_jobs_of_loading_do_not_depend_on_the_width(spark, tmp_path):
    def jobs(extra):
        line = "1," + ",".join(["x"] * extra) + ",2"
        path = write(tmp_path, f"w{extra}.csv", "a,b\n" + "\n".join([line] * 5) + "\n")
        group = f"width-{extra}"
        spark.sparkContext.setJobGroup(group, group)
        load_csv(spark, path)
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(60)


def test_save_and_export(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-02-14 10:00:00' as t, 'a;b' as s union all select null, null")
    save_csv(export_format(df), str(tmp_path / "out"), ";")
    back, _ = load_csv(spark, str(tmp_path / "out"), ";")
    assert rows(back) == rows(spark.createDataFrame([("2024-02-14", "a;b"), (None, None)], "t string, s string"))


def test_preview(spark):
    df = spark.createDataFrame([(1234.4, "N/A"), (None, "x")], "m double, s string")
    assert rows(preview(df, ["m"])) == [("$1,234", ""), ("", "x")]


def test_batch_run(spark, tmp_path):
    path = write(tmp_path, "messy.csv", "a,b\n  x  ,1\n  x  ,1\ny,2\n,\n")
    out, report = str(tmp_path / "out"), str(tmp_path / "report")
    result = run(spark, path, out, report)
    assert rows(result.cleaned) == [("x", 1), ("y", 2)]
    assert rows(load_csv(spark, out, ",")[0]) == [("x", "1"), ("y", "2")]
    part = [f for f in os.listdir(report) if f.endswith(".json")]
    summary = json.loads((tmp_path / "report" / part[0]).read_text())["summary"]
    assert summary["rows_after"] == 2 and summary["columns_before"] == 2 and summary["quality_score"] > 0
    again = run(spark, path, str(tmp_path / "out2"))
    assert rows(again.cleaned) == rows(result.cleaned)


def test_actions_and_log(frame):
    df = frame(a=["1", None, "1", "x"], b=["p", "q", "p", "r"])
    out, log = A.apply_actions(df, [
        A.Action("i1", "fillna_constant", "a", {"value": "0"}),
        A.Action("i2", "drop_duplicate_rows"),
        A.Action("i3", "cast_type", "a", {"target_type": "numeric"}),
        A.Action("i4", "drop_rows_where_missing", "a"),
        A.Action("i5", "drop_column", "nope"),
        A.Action("i6", "fillna_constant", "a"),
        A.Action("i7", "explode", "a"),
    ])
    assert rows(out) == [(0.0, "q"), (1.0, "p")]
    got = {r.step: (r.rows_removed, r.filled_count, r.error) for r in log.collect()}
    assert got == {
        0: (None, 1, None), 1: (1, None, None), 2: (None, None, None), 3: (1, None, None),
        4: (None, None, "column_not_found"), 5: (None, None, "missing_value_param"), 6: (None, None, "unsupported_action"),
    }


def test_log_and_self_join_after_a_date_cast(frame):
    df = frame(k=["a", "b", "c"], d=["2020-01-05", "5 Jan 2020", "soon"])
    out, log = A.apply_actions(df, [
        A.Action("i1", "cast_type", "d", {"target_type": "datetime"}),
        A.Action("i2", "drop_rows_where_missing", "d"),
        A.Action("i3", "drop_duplicate_rows"),
    ])
    assert [(r.step, r.rows_removed) for r in log.orderBy("step").collect()] == [(0, None), (1, 1), (2, 0)]
    cleaned = Cleaner(headers=False).fit(df).transform(df)
    other = cleaned.select(F.col("k").alias("k2"), F.col("d").alias("d2"))
    assert cleaned.join(other, F.col("k") == F.col("k2")).count() == 3
    assert out.unionByName(out).count() == 4


def test_cast_keeps_nulls_and_uses_one_date_ladder(spark, frame):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert rows(A.cast_column(df, "a", "string")) == [("1",), (None,)]
    out = A.cast_column(frame(d=["05/01/2020", "January 5, 2020", "soon"]), "d", "datetime")
    assert [str(r.d) for r in out.collect()] == ["2020-01-05 00:00:00"] * 2 + ["None"]
    assert [r.n for r in A.cast_column(frame(n=["1,234", "x"]), "n", "numeric").collect()] == [1234.0, None]


def test_fixes(frame):
    df = frame(c=["one", "2", None, "bad"])
    out = A.apply_fix(df, A.Fix("normalize_values", "c", {"mappings": {"one": "1", "bad": None}}))
    assert out.dtypes == [("c", "double")] and rows(out) == [(1.0,), (2.0,), (None,), (None,)]
    many = {f"k{i}": f"v{i}" for i in range(300)}
    assert rows(A.map_values(frame(c=["k7", "z", None]), "c", many)) == [("v7",), ("z",), (None,)]
    assert A.apply_fix(df, A.Fix("flag_for_manual_review", "c")) is df
    assert A.apply_fix(df, A.Fix("coerce_type", "c")).dtypes == [("c", "string")]
    assert rows(A.apply_fix(frame(c=[" o'neil ", None]), A.Fix("title_case", "c"))) == [("O'Neil",), (None,)]


def test_replay(frame):
    df = frame(c=["us", "fr"])
    fixes = {"b": A.Fix("title_case", "c"), "a": A.Fix("normalize_values", "c", {"mappings": {"us": "usa land"}})}
    assert rows(A.replay_fixes(df, fixes, ["a", "b"])) == [("Fr",), ("Usa Land",)]
    fixes.pop("a")
    assert rows(A.replay_fixes(df, fixes, ["a", "b"])) == [("Fr",), ("Us",)]


def test_responses(frame):
    item = '{"issue_id": "x", "recommended_action": "title_case", "fix_params": {"mappings": {"a": "b", "c": null}}}'
    texts = {
        "fenced": f"```json\n[{item}]\n```",
        "cut": f'[{item}, {{"issue_id": "y", "reas',
        "unknown": '[{"issue_id": "z", "recommended_action": "burn"}]',
        "no_id": '[{"recommended_action": "keep"}]',
        "nothing": "sorry",
        "braces": '[{"issue_id": "w", "reasoning": "use } and { and \\"[\\"", "fix_params": {}}, {"bro',
    }
    df = frame(response_id=list(texts), response=list(texts.values()))
    got = {(r.response_id, r.issue_id): r for r in R.parse_responses(df).collect()}
    assert set(got) == {("fenced", "x"), ("cut", "x"), ("unknown", "z"), ("braces", "w")}
    assert got["unknown", "z"].recommended_action == "flag_for_manual_review"
    assert got["unknown", "z"].reasoning == ""
    assert got["fenced", "x"].fix_params.mappings == {"a": "b", "c": None}


def test_identity_mappings(spark):
    df = spark.sql("select map('a', 'a', 'b', 'c', 'd', null) as m")
    assert df.select(R.drop_identity_mappings(F.col("m"))).first()[0] == {"b": "c", "d": None}


def test_plan_on_a_stream(spark, frame, tmp_path):
    batch = frame(a=["  x ", "y", "N/A"], n=["$1,000", "$2,500", ""])
    plan = Cleaner(headers=False).fit(batch)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = clean_stream(plan, stream).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("cleaned")) == [("x", 1000), ("y", 2500)]


def test_a_repeated_key_of_a_mapping_multiplies_no_row(spark, frame, monkeypatch):
    df = frame(v=["1", "1", "x", None])
    table = spark.createDataFrame([("1", "b"), ("1", "a"), ("x", None), (None, "z")], "value string, replacement string")
    want = sorted([("a",), ("a",), (None,), (None,)], key=str)
    assert rows(actions.map_values(df, "v", table)) == want
    monkeypatch.setattr(actions, "BROADCAST_ROWS", 0)
    assert rows(actions.map_values(df, "v", table)) == want
    assert rows(actions.map_values(df, "v", {1: "q", "1": "w"})) == sorted([("w",), ("w",), ("x",), (None,)], key=str)


def test_broken_answers_of_any_depth_are_salvaged(spark):
    deep = '{"issue_id": "deep", "fix_params": {"mappings": {"a": "}{\\"", "b": "x"}, "more": {"c": {"d": [1, {"e": {}}]}}}}'
    text = "noise [" + deep + ', {"issue_id": "two", "reasoning": "{"}, {"issue_id": "cut", '
    got = parse_responses(spark.createDataFrame([(1, text), (2, None), (3, "[")], "response_id int, response string")).collect()
    assert [(r.response_id, r.issue_id) for r in got] == [(1, "deep"), (1, "two")]
    assert got[0].fix_params.mappings["a"] == '}{"'


def counted(spark, df):
    """A table that counts how often it is read, as one partition."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        reads.add(1)
        yield from batches

    return df.coalesce(1).mapInArrow(count, df.schema), reads


def test_the_log_reads_the_table_once(spark):
    rows_ = [(str(i % 7) if i % 5 else None, "x" if i % 3 else None, i % 4) for i in range(60)]
    df, reads = counted(spark, spark.createDataFrame(rows_, "a string, b string, c int"))
    chain = [
        A.Action("1", "fillna_constant", "a", {"value": "0"}), A.Action("2", "drop_duplicate_rows"), A.Action("3", "drop_rows_where_missing", "b"),
        A.Action("4", "cast_type", "a", {"target_type": "numeric"}), A.Action("5", "fillna_constant", "c", {"value": "word"}),
        A.Action("6", "drop_column", "c"), A.Action("7", "drop_duplicate_rows"), A.Action("8", "drop_duplicate_rows"),
    ]
    out, log = A.apply_actions(df, chain)
    got = [(r.step, r.rows_removed, r.filled_count) for r in log.orderBy("step").collect()]
    table = [("0" if a is None else a, b, c) for a, b, c in rows_]
    once = set(table)
    full = [r for r in once if r[1] is not None]
    last = {(float(a), b) for a, b, _ in full}
    assert sorted(map(tuple, out.collect())) == sorted(last)
    assert got == [
        (0, None, 12), (1, 60 - len(once), None), (2, len(once) - len(full), None), (3, None, None), (4, None, 0), (5, None, None),
        (6, len(full) - len(last), None), (7, 0, None),
    ]
    assert reads.value == 1


def test_automatic_rules_shuffle_whole_rows_once(spark):
    df, reads = counted(spark, spark.createDataFrame([(str(i % 20), "x") for i in range(50)], "a string, b string"))
    out, log = A.automatic_rules(df)
    assert sorted(map(tuple, out.collect())) == [(i, "x") for i in range(20)] and log[-1] == {"action": "remove_duplicates", "rows_removed": 30, "safe": True}
    assert reads.value == 2  # the evidence of types, and the result


def test_planning_a_replay_reads_the_base_once(spark):
    df, reads = counted(spark, spark.createDataFrame([("one", "2020-01-05", "x y", "3"), ("2", "soon", None, "4"), (None, "5 Jan 2020", "z", "5")], "a string, b string, c string, d string"))
    fixes = {
        "1": A.Fix("normalize_values", "a", {"mappings": {"one": "1"}}), "2": A.Fix("normalize_values", "b", {"mappings": {"soon": None}}),
        "3": A.Fix("title_case", "c"), "4": A.Fix("coerce_type", "d"), "5": A.Fix("normalize_values", "c", {"mappings": {"X Y": "9", "Z": "8"}}),
        "6": A.Fix("normalize_values", "gone", {"mappings": {"a": "b"}}),
    }
    out = A.replay_fixes(df, fixes, list("123456"))
    assert reads.value == 1
    assert [t for _, t in out.dtypes] == ["double", "timestamp_ntz", "double", "double"]
    assert rows(out.select("a", "c", "d")) == rows(spark.createDataFrame([(1.0, 9.0, 3.0), (2.0, None, 4.0), (None, 8.0, 5.0)], "a double, c double, d double"))
    # Made a number by one fix and text again by the next, a column is looked at anew.
    again = A.apply_fixes(df.select("a"), [fixes["1"], A.Fix("normalize_values", "a", {"mappings": {"2.0": "two"}})])
    assert rows(again) == rows(spark.createDataFrame([("1.0",), ("two",), (None,)], "a string"))


def test_replay_with_a_table_of_mappings(spark, frame):
    table = spark.createDataFrame([("one", "1"), ("bad", None)], "value string, replacement string")
    out = A.apply_fixes(frame(c=["one", "2", None, "bad"]), [A.Fix("normalize_values", "c", {"mappings": table})])
    assert out.dtypes == [("c", "double")] and rows(out) == [(1.0,), (2.0,), (None,), (None,)]


def test_fallback_types(spark, frame):
    df = frame(n=["1", "2,000", None], d=["2020-01-05", "5 Jan 2020", None], t=["a", "1", "2"], e=[None] * 3).withColumn("k", F.lit(1)).withColumn("f", F.lit(True))
    got = {r["column"]: r.target_type for r in A.fallback_types(df).collect()}
    assert got == {"n": "numeric", "d": "datetime", "t": "string", "e": "string", "k": "numeric", "f": "string"}
