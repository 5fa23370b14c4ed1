"""Splits of CSV files with line breaks in cells against a reader that takes the whole file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from dwellstat.sources import csv_records, readers


@pytest.fixture()
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in kept.items():
        spark.conf.set(k, v)


def whole_file(text):
    return [row for row in csv.reader(io.StringIO(text, newline=""))][1:]


def read(spark, path, n):
    schema = ", ".join(f"c{i} string" for i in range(n))
    rows = readers.read_csv(spark, str(path), schema).collect()
    return sorted([["" if x is None else x for x in r] for r in rows])


def random_file(rng, rows, breaks):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["c0", "c1", "c2"])
    bits = ["a", "bc", '"', ",", "<b>", " ", "é"] + (["\n", "\r\n"] if breaks else [])
    for i in range(rows):
        writer.writerow([str(i), "".join(rng.choices(bits, k=rng.randrange(12))), "".join(rng.choices(bits, k=rng.randrange(4))) + "."])
    return out.getvalue()


@pytest.mark.parametrize("size", [7, 64, 999])
@pytest.mark.parametrize("breaks", [True, False])
def test_splits_equal_the_whole_file(spark, tmp_path, small_splits, size, breaks):
    text = random_file(random.Random(size), 60, breaks)
    path = tmp_path / "x.csv"
    path.write_text(text, newline="")
    small_splits(size)
    assert read(spark, path, 3) == sorted(whole_file(text))
    splits = spark.read.option("lineSep", "\n").text(str(path)).select(F.spark_partition_id()).distinct().count()
    assert splits > 1 or size == 999


def test_cells_longer_than_splits(spark, tmp_path, small_splits):
    text = 'id,note\n1,"' + "line, with commas\n" * 40 + '"\n2,plain\n3,"x ""y""\n"\n4,5" pipe\n5,"never closed\n6,7\n'
    path = tmp_path / "x.csv"
    path.write_text(text, newline="")
    small_splits(50)
    got = {r.id: r.note for r in readers.read_csv(spark, str(path), "id string, note string").collect()}
    assert got["1"] == "line, with commas\n" * 40 and got["2"] == "plain" and got["3"] == 'x "y"\n' and got["4"] == '5" pipe'
    assert set(got) == {"1", "2", "3", "4", "5"} and got["5"].startswith("never closed\n6,7")


def test_headers_with_breaks_blank_lines_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeff"first\nname",b\n\n1,2\n\n', newline="")
    (tmp_path / "b.csv").write_text('\n\nb,"first\nname"\r\n20,10\r\n', newline="")
    (tmp_path / "c.csv").write_text('b,"first\nname"\n', newline="")
    rows = readers.read_text_csv(spark, str(tmp_path)).collect()
    assert sorted((r["first\nname"], r.b) for r in rows) == [("1", "2"), ("10", "20")]


def test_effects_compose(spark):
    lines = ["", "a,b", 'a,"b', 'c",d', '"x"', '5" x', '"a""', 'b"",c"', '","']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").select("i", csv_records.line_effect(F.col("value")).alias("e"))
    effect = [r.e for r in df.orderBy("i").collect()]
    for inside in (0, 1):
        after = csv_records._after(__import__("numpy").array(effect), inside).tolist()
        state = inside
        for line, got in zip(lines, after):
            opened = '"' if state else ""
            # whether the cell begun by the quote in front is still open behind the line
            parsed = list(csv.reader(io.StringIO(opened + line + "\n\x00end\n", newline="")))
            state = int(len(parsed) < 2)
            assert got == state


def test_no_file(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no CSV files"):
        readers.read_csv(spark, str(tmp_path), "a int")
