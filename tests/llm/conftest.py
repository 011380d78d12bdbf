import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def make_docs(spark):
    """documents with the given (doc_id, text) pairs; lang and source may be null, extra clashing columns may follow."""
    def make(pairs, extra=False, lang=None):
        rows = [(i, t, lang(i) if lang else None, None, None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        if extra:
            from pyspark.sql import functions as F
            for c in ("_digest", "_text", "_salt", "keep_id", "size", "shard", "score", "label", "key", "n", "token", "words",
                      "_toxic", "_QUALITY", "_sha", "_id", "row", "sha", "id"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make
