"""Readers and writers on real files."""

import pytest
from pyspark.sql import functions as F

from corpus_spark import sources as IO
from corpus_spark.operators.order import split_exact

TEXTS = ['plain', 'with "quotes" and, commas', "two\nlines", "  spaces  ", "中文　　x", "back\\slash", "\\"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "key string, body string")


def test_csv_round_trip(spark, rows, tmp_path):
    path = IO.write_csv(rows, str(tmp_path / "x.csv"))
    by_header = IO.read_csv(spark, path, multi_line=True)
    assert by_header.columns == ["key", "body"]
    assert sorted(map(tuple, by_header.collect())) == sorted(map(tuple, rows.collect()))
    forced = IO.read_csv(spark, path, columns=["id", "text"], multi_line=True)
    assert forced.columns == ["id", "text"] and forced.count() == len(TEXTS)


def test_hand_written_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('0,content\n1,"a ""b"", c"\n2,"x\ny"\n', encoding="utf-8")
    got = IO.read_any(spark, "a.csv", str(tmp_path), multi_line=True).collect()
    assert [tuple(r) for r in got] == [("1", 'a "b", c'), ("2", "x\ny")]
    forced = IO.read_csv(spark, str(tmp_path / "a.csv"), columns=["id", "text"], multi_line=True).collect()
    assert [r.id for r in forced] == ["1", "2"]


def test_json_and_text_by_suffix(spark, rows, tmp_path):
    rows.write.json(str(tmp_path / "x.json"))
    assert IO.read_any(spark, "x.json", str(tmp_path)).count() == len(TEXTS)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.txt").write_text("a\n\nb\n", encoding="utf-8")
    (tmp_path / "d" / "two.log").write_text("c\n", encoding="utf-8")
    lines = IO.read_text(spark, str(tmp_path / "d"), keep_file=True).collect()
    assert sorted(tuple(r) for r in lines) == [("", "one.txt"), ("a", "one.txt"), ("b", "one.txt")]
    assert IO.read_any(spark, "d/one.txt", str(tmp_path)).count() == 3
    (tmp_path / "d" / "zwei.txt").write_text("z\n", encoding="utf-8")
    folder = str(tmp_path / "d")
    assert IO.read_text(spark, folder).count() == 4
    assert IO.read_text(spark, folder, only_first_file=True).count() == 3
    kept = IO.read_text(spark, folder, keep_linebreaks=True).collect()
    assert sorted(r.text for r in kept) == ["\n", "a\n", "b\n", "z\n"]


def test_published_splits(spark, tmp_path):
    df = split_exact(spark.range(100), "id")
    IO.publish(df, str(tmp_path), "set", "rev")
    test = IO.read_named(spark, str(tmp_path), "set", split="test", revision="rev")
    assert test.columns == ["id"] and test.count() == 10
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    IO.copy_dataset(spark, str(tmp_path / "set" / "rev"), str(tmp_path / "copy"))
    assert IO.read_splits(spark, str(tmp_path / "copy")).groupBy("split").count().count() == 3
    assert IO.read_splits(spark, str(tmp_path / "copy"), "train").count() == 80


def test_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert IO.cached_or(spark, path, build).count() == 3
    assert IO.cached_or(spark, path, build).count() == 3
    assert len(calls) == 1


def test_metrics_log_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    IO.write_metrics(IO.speed_metrics(spark, 100, 4.0), path, "a", "train")
    IO.write_metrics(IO.speed_metrics(spark, 10, 1.0), path, "b", "eval")
    log = spark.read.json(path)
    assert log.count() == 6
    assert log.where("run = 'a' and metric = 'samples_per_second'").first().value == 25.0


def test_preview(spark):
    count, columns, first = IO.preview(spark.range(50), 3, F.col("id"))
    assert (count, columns) == (50, ["id"]) and {r.id for r in first.collect()} == {0, 1, 2}


def test_only_new_and_changed_files_are_read_again(spark, tmp_path):
    folder, seen = tmp_path / "texts", []
    folder.mkdir()
    for name in ("a b.txt", "c.txt"):
        (folder / name).write_text(f"{name}\nsame\n", encoding="utf-8")

    def build(lines):
        seen.append(sorted({r.file.rsplit("/", 1)[1] for r in lines.collect()}))
        return lines.select(F.upper("text").alias("line"), "file")

    def lines():
        return sorted(r.line for r in IO.cached_files(spark, str(folder), str(tmp_path / "cache"), build).collect())

    assert lines() == ["A B.TXT", "C.TXT", "SAME", "SAME"]
    assert lines() == ["A B.TXT", "C.TXT", "SAME", "SAME"] and len(seen) == 1
    (folder / "c.txt").write_text("changed line\n", encoding="utf-8")
    (folder / "d.txt").write_text("added\n", encoding="utf-8")
    assert lines() == ["A B.TXT", "ADDED", "CHANGED LINE", "SAME"]
    assert seen[1:] == [["c.txt", "d.txt"]]
    (folder / "d.txt").unlink()
    assert lines() == ["A B.TXT", "CHANGED LINE", "SAME"] and len(seen) == 2


def test_failed_publish_leaves_the_old_revision(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(10).withColumn("split", F.lit("train"))
    IO.publish(df, root, "set")
    broken = df.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="half-way"):
        IO.publish(broken, root, "set")
    before = IO.read_named(spark, root, "set")
    assert before.count() == 10
    IO.publish(before.withColumn("id", F.col("id") + 1), root, "set")  # from itself
    assert sorted(r.id for r in IO.read_named(spark, root, "set").collect()) == list(range(1, 11))
    assert before.count() == 10  # readers of the version before still can
    IO.publish(df, root, "set")
    assert len(list((tmp_path / "set" / "_current").glob("0*"))) == 2
    IO.write_splits(df, f"{root}/set", mode="append")
    assert IO.read_splits(spark, f"{root}/set").count() == 20
