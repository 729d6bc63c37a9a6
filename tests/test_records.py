"""Records of delimited files: quotes, line breaks, many splits, loaded and rejected records of one parse."""

import csv
import io
import itertools
import random
import re

import pytest

import __spark_entry__ as entry
from limewash.sources import records as R
from limewash.sources.delimited import load_csv, read_records, rejected_lines, save_csv

SF = "/root/testdata/sf0.001"


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stray_quotes_do_not_join_fields(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b,c\n5" pipe,6" pipe,7,8\n1,2,3\nx,"y""s, ""z""",w\n')
    df, _ = load_csv(spark, path)
    assert df.columns == ["a", "b", "c", "Unnamed_0"]
    assert rows(df) == rows(spark.createDataFrame([('5" pipe', '6" pipe', "7", "8"), ("1", "2", "3", None), ("x", 'y"s, "z"', "w", None)], "a string, b string, c string, d string"))


def test_header_over_two_lines(spark, tmp_path):
    df, _ = load_csv(spark, write(tmp_path, "a.csv", '"first\nname",age\nx,1\n"y\nz",2\n'))
    assert df.columns == ["first\nname", "age"] and rows(df) == [("x", "1"), ("y\nz", "2")]


def test_rejected_records_are_whole(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a;b\n"x\ny;z";2;EXTRA\n"p\nq;r;s;t";ok\n3;4;\n5;6;;;\n\n7\n')
    loaded, rejected = load_csv(spark, path)[0], rejected_lines(spark, path)
    assert rows(loaded) == rows(spark.createDataFrame([("p\nq;r;s;t", "ok"), ("7", None)], "a string, b string"))
    assert rows(rejected.select("fields", "line")) == [(3, '"x\ny;z";2;EXTRA'), (3, "3;4;"), (5, "5;6;;;")]
    assert loaded.count() + rejected.count() == read_records(spark, path).count() == 5


def test_values_of_fields(spark):
    raw = {"": None, '""': "", '"a"': "a", '"a""b"': 'a"b', '"a"b': "ab", 'a"b': 'a"b', '"a': "a", '"a""': 'a"', " x ": " x ", '"' + '""' * 5000 + '"': '"' * 5000, '"a\nb"': "a\nb"}
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    from pyspark.sql import functions as F

    assert {r.raw: r.value for r in df.select("raw", R.cell(F.col("raw")).alias("value")).collect()} == raw


def cells(rng, width):
    pieces = ["a", "é", ",", ";", '"', "\n", "1", " ", '5"', "\n\n", "x" * 40]
    return ["".join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(width)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sep", ",;")
def test_files_of_many_splits(spark, tmp_path, small_splits, seed, sep):
    """Against the parser of the standard library, over quotes, line breaks and records longer than a split."""
    rng = random.Random(seed)
    want = []
    (tmp_path / "in").mkdir()
    for part in range(3):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]), quoting=csv.QUOTE_MINIMAL)
        writer.writerow(["id", "b\nc" if part < 2 else "bc", "d"])
        for i in range(150):
            row = [f"{part}-{i}", *cells(rng, rng.choice([0, 1, 2, 2, 2, 3]))]
            if i == 70:
                row = [f"{part}-{i}", "long\n" * 900, "z"]
            writer.writerow(row)
            want.append([c or None for c in row])
        (tmp_path / "in" / f"{part}.csv").write_bytes(out.getvalue().encode())
    path = str(tmp_path / "in")
    splits = spark.read.text(path).rdd.getNumPartitions()
    assert splits > 3
    got = read_records(spark, path, sep)
    assert rows(got.select("cells")) == sorted(((w,) for w in want), key=str)
    loaded = load_csv(spark, path, sep)[0]
    if sep == ";":
        assert loaded.count() + rejected_lines(spark, path, sep).count() == len(want)
        assert rows(loaded.select("id")) == sorted((w[0],) for w in want if len(w) <= 3)
    else:
        assert loaded.count() == len(want)


def test_states_of_lines():
    """Against a reader of single characters."""

    def plain(text, inside, sep):
        start = not inside
        quote = inside
        i = 0
        while i < len(text):
            c = text[i]
            if quote:
                if c == '"' and text[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    quote = False
            elif c == sep:
                start = True
                i += 1
                continue
            elif c == '"' and start:
                quote = True
            start = False
            i += 1
        return quote

    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choices('",a', k=rng.randrange(10)))
        for inside in (False, True):
            assert R.ends_inside(text.encode(), inside, b",") == plain(text, inside, ","), (text, inside)


def test_every_split_reads_in_parallel(spark, tmp_path, small_splits):
    body = "".join(f'"{i}\n{"w" * 30}",{i}\n' for i in range(400))
    path = write(tmp_path, "a.csv", "a,b\n" + body)
    df, _ = load_csv(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 400
    batch, table = R.records(spark, path, ",")[0]
    assert batch.broken and table.rdd.getNumPartitions() > 8 and R.widest(batch, table) == 2
    assert re.search("PythonMapInArrow|MapInArrow", table._jdf.queryExecution().toString())


def test_empty_folder_of_lines(spark, tmp_path):
    path = write(tmp_path, "a.csv", "")
    assert load_csv(spark, path)[0].count() == 0 and read_records(spark, path).count() == 0
    header_only = write(tmp_path, "b.csv", "a;b\n")
    assert load_csv(spark, header_only)[0].columns == ["a", "b"] and load_csv(spark, header_only)[0].count() == 0


def test_prose_has_two_columns(spark):
    assert entry.queries()["csv_prose"](spark, SF).columns == ["id", "body"]


def test_cores_and_splits_may_change_between_reads(spark, tmp_path, monkeypatch):
    """Whatever splits each read of the files gets, as on a cluster whose executors come late."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    body = "".join(f'{i},"{"w, " * (i % 40)}\n""{i}"" {"v" * (i % 90)}"\n' for i in range(300))
    path = write(tmp_path, "a.csv", "id,body\n" + body)
    sizes = itertools.count()
    read = R._lines

    def lines(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str([100000, 700, 1100, 900][next(sizes) % 4]))
        return read(*args)

    monkeypatch.setattr(R, "_lines", lines)
    try:
        got = load_csv(spark, path, ",")[0].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(str(i), f'{"w, " * (i % 40)}\n"{i}" {"v" * (i % 90)}') for i in range(300)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_saved_white_space_comes_back(spark, tmp_path):
    texts = [(str(i), t) for i, t in enumerate([" a", "a ", "\ta\t", "  ", ' "a" ', "\n a, b \n", " "])]
    save_csv(spark.createDataFrame(texts, "id string, body string"), str(tmp_path / "out"), ",")
    assert sorted(map(tuple, load_csv(spark, str(tmp_path / "out"), ",")[0].collect())) == texts
