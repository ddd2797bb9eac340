"""Named files: names and bytes read back, failed and repeated attempts, names that can't be."""

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from scorelake.sources import named_files


def read_back(spark, folder):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = len(os.path.realpath(folder)) + 1
    return {r["path"].removeprefix("file:").removeprefix("//")[at:]: bytes(r["content"]) for r in found.collect()}


def on_disk(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def table(spark, n=40):
    number = F.format_string("%04d", F.col("id"))
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("pages/page_"), number, F.lit(".png"))).otherwise(F.concat(F.lit("score_é "), number, F.lit(".clean.xml")))
    return spark.range(n).select(name.alias("name"), F.when(F.col("id") != 3, F.sha2(number, 256).cast("binary")).alias("data"), F.lit(1).alias("other")).repartition(5)


def test_names_and_bytes_come_back(spark, tmp_path):
    folder = os.path.realpath(str(tmp_path / "out"))
    df = table(spark)
    named_files.write_files(df, folder)
    want = {r["name"]: bytes(r["data"] or b"") for r in df.collect()}
    full = {k: v for k, v in want.items() if v}  # binaryFile leaves empty files out
    assert len(full) == 39 and read_back(spark, folder) == full and on_disk(folder) == sorted(want)
    # once more: names that are there are replaced, others stay
    again = df.where(F.col("name").startswith("pages")).withColumn("data", F.lit(b"new"))
    named_files.write_files(again, "file://" + folder)
    assert read_back(spark, folder) == {k: b"new" if k.startswith("pages") else v for k, v in full.items()}
    named_files.write_files(df.limit(0), folder)
    named_files.write_files(df.limit(1).select("name", F.lit("é\n").alias("data")), folder)
    assert "é\n".encode() in read_back(spark, folder).values()


def failing(df, after, name):
    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                if TaskContext.get().partitionId() == 1 and i >= after:
                    raise RuntimeError("lost")
                yield batch.slice(i, 1)

    return df.mapInArrow(task, df.schema)


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "out")
    named_files.write_files(spark.createDataFrame([("kept", bytearray(b"old"))], "name string, data binary"), folder)
    bad = failing(table(spark).select("name", "data").union(spark.createDataFrame([("kept", bytearray(b"new"))], "name string, data binary")).repartition(3), 2, "name")
    with pytest.raises(Exception, match="lost"):
        named_files.write_files(bad, folder)
    assert on_disk(folder) == ["kept"] and read_back(spark, folder) == {"kept": b"old"}


def test_an_attempt_that_isnt_committed_leaves_nothing(tmp_path):
    """Two attempts of one task, as speculation makes them, and one that broke off in the middle of a file."""
    folder = str(tmp_path)
    writer = named_files.NamedFilesWriter(folder, 0, 1).begin()
    rows = [("a/x", b"1"), ("y", b"22")]
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    with pytest.raises(ZeroDivisionError):
        writer.write((("z", b"half"), (1 // 0, b""))[k] for k in range(2))
    assert first != second
    writer.commit([second, None])
    assert on_disk(folder) == ["a/x", "y"] and os.listdir(folder).count(named_files.ATTEMPTS) == 0
    other = named_files.NamedFilesWriter(folder, 0, 1).begin()
    other.write(iter([("y", b"333")]))
    other.abort([None])
    with pytest.raises(FileNotFoundError):  # an attempt that begins after its job's end
        other.write(iter([("y", b"333")]))
    assert on_disk(folder) == ["a/x", "y"] and (tmp_path / "y").read_bytes() == b"22"


@pytest.mark.parametrize("name", ["../out", "/tmp/x", "a/../../b", "", None, "a//b", "./a", "_attempts/x", "a/.."])
def test_names_that_leave_the_folder(spark, tmp_path, name):
    df = spark.createDataFrame([(name, bytearray(b"1"))], "name string, data binary")
    assert named_files.checked(df).count() == 1
    with pytest.raises(Exception, match="name"):
        named_files.write_files(df, str(tmp_path / "out"))
    assert on_disk(tmp_path) == []


@pytest.mark.parametrize("parts", [1, 2])
def test_two_rows_of_one_name(spark, tmp_path, parts):
    df = spark.createDataFrame([("x", bytearray(b"1")), ("x", bytearray(b"2")), ("y", bytearray(b"3"))], "name string, data binary").repartition(parts)
    assert [tuple(r) for r in named_files.checked(df).collect()] == [("x", 2)]
    with pytest.raises(Exception, match="one name"):
        named_files.write_files(df, str(tmp_path / "out"))
    assert on_disk(tmp_path) == []


def test_options(spark, tmp_path):
    named_files.register(spark)
    df = spark.createDataFrame([("x", 1)], "name string, other int")
    with pytest.raises(Exception, match="name and data"):
        df.write.format("named_files").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="appends"):
        df.withColumn("data", F.lit("x")).write.format("named_files").mode("overwrite").save(str(tmp_path))
