"""Small hostile tables for the operators."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("h", T.StringType()), T.StructField("size", T.LongType()), T.StructField("shard", T.LongType())])

LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    texts = [None, "", "  \t\n", "one", "Same Text here", "same text HERE", "same text HERE", "Ünï cödé ÀÉ", "ünï cödé àé", LONG, LONG + "x", "password = hunter2secret9x", "mail a.b@c.de or +49 30 1234567 89 and 4111 1111 1111 1111 at 10.0.0.1", "\x00 odd \x1f\x85 bytes  ", "a\nb\n\nc\n"]
    out = [(k, t, ("en", "de", None)[k % 3], ("s1", None, "s2", "")[k % 4], None if t is None else len(t), "x", -1, 7) for k, t in enumerate(texts)]
    out.append((None, "null id", None, None, 7, None, None, None))
    out.append(out[4])
    out.append(out[4])
    return out


def hostile(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
