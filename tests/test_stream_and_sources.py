from quillmark.operators.report import check, exploded
from quillmark.sources.files import read_files, read_table, write_reports
from quillmark.streaming.stream import read_stream, totals, violations


def test_batch_equals_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, f"A crucial step {i}. He ran. She hid. All slept.") for i in range(20)], "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    q = violations(stream).writeStream.format("memory").queryName("v").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["doc_id", "rule_id", "start_index"]
    assert sorted(spark.table("v").select(*cols).collect()) == sorted(exploded(check(df)).select(*cols).collect())
    q = totals(stream).writeStream.format("memory").queryName("n").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.rule_id: r.n for r in spark.table("n").collect()} == {"overused-intensifiers": 20, "staccato-burst": 20}


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# crucial")
    (tmp_path / "b.JS").write_bytes(b"// \xff bad bytes")
    got = {r.path.rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert got["a.md"].lang == "markdown" and got["b.JS"].lang == "js" and "�" in got["b.JS"].text
    spark.createDataFrame([(7, "robust")], "k int, body string").write.parquet(str(tmp_path / "t"))
    df = read_table(spark, str(tmp_path / "t"), "k", "body")
    write_reports(check(df), str(tmp_path / "out"))
    assert '"counts_by_rule":{"overused-intensifiers":1}' in spark.read.text(str(tmp_path / "out")).first()["value"]


def test_spread_keeps_rows(spark, tmp_path):
    from quillmark.sources.files import spread

    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(50))
    many = spark.range(0, 50, 1, spark.sparkContext.defaultParallelism + 1)  # as many splits as cores
    assert spread(many) is many
