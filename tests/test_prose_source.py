import os

import pytest
from pyspark.sql import functions as F

from quillmark.operators.report import check, exploded
from quillmark.sources.files import read_files
from quillmark.sources.prose import dealt, register


@pytest.fixture
def folder(spark, tmp_path):
    register(spark)
    rows = [("a.md", b"# crucial\n"), ("deep/er/b.JS", b"// \xff bad \xe2\x82 bytes \xc3"), ("c.txt", b""), ("d e.html", "<p>é robust</p>".encode()), ("x", b"\xed\xa0\x80plain")]
    spark.createDataFrame(rows, "path string, content binary").repartition(3).write.format("prose").mode("append").save(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_files_as_read_by_spark(spark, folder):
    mine = spark.read.format("prose").option("partitionBytes", 20).load(folder)
    assert mine.rdd.getNumPartitions() > 1
    rows = sorted(map(tuple, mine.collect()))
    assert [r for r in rows if r[2]] == sorted(map(tuple, read_files(spark, folder).collect()))  # Spark's own reader has no rows of empty files
    assert len(rows) == 5
    assert {r.lang for r in mine.collect()} == {"markdown", "js", "text", "html"}
    assert exploded(check(mine)).where("rule_id = 'overused-intensifiers'").count() == 2
    forced = spark.read.format("prose").option("lang", "html").load(folder)
    assert {r.lang for r in forced.select("lang").collect()} == {"html"}


def test_overwrite_append_and_failures(spark, folder):
    one = lambda p: spark.createDataFrame([(p, b"new")], "path string, content binary").write.format("prose")
    one("y.md").mode("append").save(folder)
    assert spark.read.format("prose").load(folder).count() == 6
    with pytest.raises(Exception):  # noqa: B017
        one("../out.md").mode("append").save(folder)
    assert spark.read.format("prose").load(folder).count() == 6 and not os.path.exists(os.path.join(folder, "..", "out.md"))
    one("z.md").mode("overwrite").save(folder)
    assert [r.text for r in spark.read.format("prose").load(folder).collect()] == ["new"]
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).write.format("prose").mode("append").save(folder)


def test_stream_goes_on_behind_its_offset(spark, folder, tmp_path):
    def run():
        q = (
            spark.readStream.format("prose").load(folder).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        )
        q = q.start()
        q.awaitTermination(60)
        q.stop()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert len(run()) == 5
    spark.createDataFrame([("late.md", b"late")], "path string, content binary").write.format("prose").mode("append").save(folder)
    after = run()
    assert len(after) == 6 and "late" in after and run() == after


def test_partitions_by_bytes():
    files = [(i, f"f{i}", n) for i, n in enumerate([5, 5, 30, 1, 1, 9, 0])]
    assert [p.paths for p in dealt(files, 10)] == [["f0", "f1"], ["f2"], ["f3", "f4"], ["f5", "f6"]]
    assert dealt([], 10) == []


def test_empty_folder(spark, tmp_path):
    register(spark)
    os.makedirs(tmp_path / "none")
    assert spark.read.format("prose").load(str(tmp_path / "none")).agg(F.count("*")).first()[0] == 0
