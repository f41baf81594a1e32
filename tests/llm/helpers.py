"""Small tables with the awkward rows that every operator must survive."""

from pyspark.sql import types as T

LONG = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000).strip()
TEXTS = [(1, "The quick brown fox."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (1, "The quick brown fox."), (1, "Another text, same id"), (None, "no id")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()),
                       T.StructField("n_words", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("words", T.StringType())])


def docs(spark, rows):
    """Rows of (doc_id, text) beside extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in rows], SCHEMA)
