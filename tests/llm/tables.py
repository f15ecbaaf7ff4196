"""Small tables with the awkward rows every operator has to take."""

from pyspark.sql import types as T

#: names that operators use for themselves
EXTRA = ("row_id", "fp", "n_tokens", "key_hi", "row_hi", "hits", "items", "doc", "keep", "n_lines", "n_dropped", "kept_text", "spans", "score", "component", "lang_pred", "digits", "path", "node", "size", "gone", "first", "gone_", "name", "key", "n", "output", "h1", "word", "row", "phrase", "f")
SAME = "the very same words stand here in two rows of one small table"
ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "ab " * 40_000), (5, "x" * 200_000), (6, SAME), (7, SAME), (7, SAME), (None, "a row without any id"),
    (8, "\U0001f600 éß 漢字   \x1c \x00 end"), (9, "\n\n\n"), (10, "12 34 --- ***"), (11, "1" * 50_000), (12, "a@" * 20_000)]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])


def awkward(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None, None if t is None else len(t), *["extra"] * len(EXTRA)) for i, t in rows], SCHEMA).repartition(3)


def by_id(df, *columns):
    """Sorted (id, columns...) rows."""
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=repr)
