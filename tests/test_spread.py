"""Steps that take long per row run on all cores, however few files their rows come from."""

from loomgraph.lineage import spread
from loomgraph.plans import table_queries


def test_documents_are_parsed_by_all_cores(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "s", 6) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table_queries._docs(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert docs.count() == 40


def test_spreading_keeps_all_rows(spark):
    assert spread(spark.range(1000).coalesce(1)).distinct().count() == 1000
