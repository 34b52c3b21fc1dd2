"""Small frames for the tests of this folder."""


def documents(spark, texts, **columns):
    """doc_id and text, in input order; three partitions."""
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
