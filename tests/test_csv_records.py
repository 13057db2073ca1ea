"""The CSV scan against pandas, with files cut into many splits."""

import io
import random

import pandas as pd
import pytest

from ledeframe.sources import sinks as K
from ledeframe.sources import tables as S

SCHEMA = "a string, b string, c string"


@pytest.fixture()
def splits(spark):
    """Splits of a few bytes, whatever the size of a file."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def cut(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield cut
    for k, v in old.items():
        spark.conf.set(k, v)


def by_pandas(data: bytes, encoding="utf-8"):
    df = pd.read_csv(io.BytesIO(data), encoding=encoding, dtype=str, keep_default_na=True, lineterminator=None)
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def by_spark(spark, path, encoding="UTF-8"):
    return sorted(map(str, map(tuple, S.csv_scan(spark, path, SCHEMA, encoding).collect())))


def write(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


def random_csv(rnd, rows, breaks="\n"):
    def field():
        kind = rnd.random()
        if kind < 0.35:
            inner = "".join(rnd.choice(["x", "é", "word ", ",", '""', "\n", "\n\n", "1", " "]) for _ in range(rnd.randint(0, 25)))
            return f'"{inner}"'
        if kind < 0.45:
            return rnd.choice(["NA", "nan", "", "null"])
        return "".join(rnd.choice("abc é'9.") for _ in range(rnd.randint(1, 12)))

    lines = ["a,b,c"]
    for i in range(rows):
        lines.append(f"r{i}," + ",".join(field() for _ in range(2)))
        if rnd.random() < 0.05:
            lines.append("")
    return breaks.join(lines) + rnd.choice(["", breaks])


@pytest.mark.parametrize("seed,size", [(1, 40), (2, 97), (3, 1000), (4, 1 << 20)])
def test_like_pandas_in_splits(spark, splits, tmp_path, seed, size):
    rnd = random.Random(seed)
    text = random_csv(rnd, 150)
    splits(size)
    path = write(tmp_path / "x.csv", text.encode())
    assert by_spark(spark, path) == by_pandas(text.encode())
    assert S.csv_scan(spark, path, SCHEMA).count() == len(by_pandas(text.encode()))


def test_same_rows_as_the_multi_line_reader(spark, splits, tmp_path):
    text = random_csv(random.Random(9), 400)
    path = write(tmp_path / "x.csv", text.encode())
    whole = spark.read.schema(SCHEMA).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    splits(120)
    assert sorted(map(str, map(tuple, S.csv_scan(spark, path, SCHEMA, na_values=False).collect()))) == sorted(map(str, map(tuple, whole.collect())))


def test_latin1_crlf_and_stray_quotes(spark, splits, tmp_path):
    rows = ['a,b,c', 'r1,"é, ü\r\nsecond",x', 'r2,5" pipe,6"', 'r3,plain,"says ""hi"" \r\n\r\n"', 'r4,"",end', 'r5,it"s "odd",z']
    data = "\r\n".join(rows).encode("latin-1")
    for size in (7, 30, 4096):
        splits(size)
        assert by_spark(spark, write(tmp_path / f"l{size}.csv", data), "ISO-8859-1") == by_pandas(data, "latin-1")


def test_one_record_over_many_splits_and_several_files(spark, splits, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    long = "\n".join(f"line {i}" for i in range(400))
    texts = [f'a,b,c\n1,"{long}",x\n2,y,z\n', "a,b,c\n", f'a,b,c\n3,q,"{long}"', 'a,b,c\n\n\n4,"\n",\n\n']
    for i, t in enumerate(texts):
        (folder / f"f{i}.csv").write_text(t)
    splits(64)
    want = sorted(sum((by_pandas(t.encode()) for t in texts), []))
    assert by_spark(spark, str(folder)) == want and len(want) == 4


def test_header_alone_and_a_large_file_of_quoted_fields(spark, splits, tmp_path):
    assert by_spark(spark, write(tmp_path / "h.csv", b"a,b,c\n")) == []
    text = "a,b,c\n" + "".join(f'"{i}","t\n""{i}"", x","{i % 7}"\n' for i in range(20_000))
    path = write(tmp_path / "big.csv", text.encode())
    splits(16_000)
    df = S.csv_scan(spark, path, "a long, b string, c int")
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    got = {r["a"]: (r["b"], r["c"]) for r in df.collect()}
    assert got == {i: (f't\n"{i}", x', i % 7) for i in range(20_000)}


def test_utf16_takes_the_whole_file_reader(spark, tmp_path):
    data = 'a,b,c\n1,"x\ny",z\n'.encode("utf-16")
    assert by_spark(spark, write(tmp_path / "u.csv", data), "UTF-16") == by_pandas(data, "utf-16")


def test_first_file_of_a_pattern_a_folder_and_a_list(spark, tmp_path):
    for name, v in (("b", 2), ("a", 1), ("c", 3)):
        spark.createDataFrame([(v,)], "v int").coalesce(1).write.parquet(f"{tmp_path}/in/{name}.parquet")
    value = lambda p: [r["v"] for r in S.scan_first_file(spark, p).collect()]
    assert value(f"{tmp_path}/in/*.parquet") == [1]
    assert value(f"{tmp_path}/in") == [1]
    assert value([f"{tmp_path}/in/c.parquet", f"{tmp_path}/in/a.parquet"]) == [3]
    (tmp_path / "empty").mkdir()
    assert value([f"{tmp_path}/empty", f"{tmp_path}/in/b.parquet"]) == [2]
    with pytest.raises(ValueError):
        S.scan_first_file(spark, [])
    with pytest.raises(ValueError):
        S.scan_first_file(spark, f"{tmp_path}/empty")


def test_metrics_of_two_runs_written_one_after_the_other(spark, tmp_path):
    cols = "run_id string, epoch int, train_loss double, val_loss double, f1_score double"
    first = spark.createDataFrame([("a", 1, 0.5, 0.6, 0.1), ("a", 2, 0.4, 0.5, 0.2)], cols)
    second = spark.createDataFrame([("b", 1, 0.9, 0.8, 0.3)], cols)
    path = f"{tmp_path}/metrics"
    K.metrics_sink_csv(first, path)
    K.metrics_sink_csv(second, path)
    K.metrics_sink_csv(second.withColumn("val_loss", second["val_loss"] * 0), path)
    back = K.read_metrics_csv(spark, path, "epoch int, train_loss double, val_loss double, f1_score double, run_id string")
    assert sorted((r["run_id"], r["epoch"], r["val_loss"]) for r in back.collect()) == [("a", 1, 0.6), ("a", 2, 0.5), ("b", 1, 0.0)]
