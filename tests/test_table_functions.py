import pytest

from quillmark.operators.masking import mask
from quillmark.operators.table_functions import FUNCTIONS, register


def test_masks_in_sql(spark):
    assert register(spark, "t_") == register(spark, "t_") == ["t_mask", "t_mask_ranges"]
    rows = [(1, "# Héad\n\n`code` é\n", "markdown"), (2, "<p>in</p>", "html"), (3, "x = 'é'; // n", "JS"), (4, "# plain", "text"), (5, None, "html"), (6, "no lang", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    docs.createOrReplaceTempView("t_docs")
    got = {r.doc_id: r for r in spark.sql("SELECT doc_id, m.* FROM t_docs, LATERAL t_mask(text, lang) m").collect()}
    for r in mask(docs).collect():
        assert (got[r.doc_id].masked, got[r.doc_id].n_ranges) == (r.masked, len(r.ranges))
    ranges = spark.sql("SELECT doc_id, r.* FROM t_docs, LATERAL t_mask_ranges(text, lang) r ORDER BY doc_id, pos").collect()
    assert [(r.doc_id, r.kind, r.start_index, r.end_index, r.content) for r in ranges] == [
        (1, "heading", 0, 8, "# Héad\n"), (3, "string-literal", 5, 7, "é"), (3, "comment", 10, 14, "// n"),
    ]
    assert spark.sql("SELECT * FROM t_docs, LATERAL t_mask_ranges(text, 'text')").count() == 0


def test_names_that_are_taken(spark):
    spark.udf.register("u_mask_ranges", lambda x: x)
    with pytest.raises(ValueError):
        register(spark, "u_")
    assert not spark.catalog.functionExists("u_mask") and len(FUNCTIONS) == 2
    with pytest.raises(Exception):  # noqa: B017
        register(spark, "v_")
        spark.sql("SELECT * FROM (SELECT 'a' AS text), LATERAL v_mask(text, 'cobol')").collect()
