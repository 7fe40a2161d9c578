from pyspark.sql import functions as F

from earshot import more_queries


def test_documents_are_of_bounded_size(spark):
    """More listens are more documents, not larger ones."""
    path = more_queries._written(spark.range(100_000), 100_000, "bounded", F.to_json(F.struct("id")))
    sizes = [r.n for r in spark.read.text(path, wholetext=True).select(F.regexp_count("value", F.lit("id")).alias("n")).collect()]
    assert sum(sizes) == 100_000 and len(sizes) == 20 and max(sizes) < 2 * more_queries._PER_DOCUMENT
