"""Documents to tokens: five stages, each written as Parquet and read again as the input of the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm import bpe, decontaminate, language, line_dedup, simhash
from reliefspark.llm.common import stored
from reliefspark.llm.queries import PATTERN, RANKS, remainder
from reliefspark.session import table


def row_key() -> Column:
    """Names a row by its text and id, never null.  Rows of one key are judged alike, rows that share only an id are not."""
    return F.concat_ws(":", F.sha2(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"), 256), F.col("doc_id").cast("string"))


def spare(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Documents whose key is not in the column ``name`` of ``gone``; they have no column of that name."""
    return docs.join(gone.select(name), row_key() == F.col(name), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go.  Every row is judged by its text alone, also if it has no id."""
    gone = spare(docs, "gone")
    found = language.identify(docs.select("doc_id", "text", "lang", row_key().alias(gone)), remainder(4) != 2, key_col=gone)
    return without(docs, found.where("lang_pred = 'und'"), gone)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that ten documents or more share, the first stays; documents that lose all they had go."""
    kept = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, min_docs=10, keep_first=True))
    kept = kept.where("n_dropped = 0 or kept_text rlike '[^ \\t-\\r]'")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))}
    return kept.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, null ids last, then with the smallest digest."""
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key().alias("key")).alias("name")
    found = simhash.near_duplicates(docs.select(name, "text"), id_col="name").where("name.key = component_id.key")
    first = spare(docs, "first")
    stays = found.select(F.col("name.key").alias(first)).distinct()
    # equal keys are equal texts under one id; one of them stays
    return docs.join(stays, row_key() == F.col(first)).dropDuplicates([first]).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a ten-word window of a benchmark item go."""
    gone = spare(docs, "gone")
    hit = decontaminate.scan(docs.select("text", row_key().alias(gone)), table(spark, sf_dir, "benchmark"), id_col=gone)
    return without(docs, hit.where("n_hit > 0"), gone)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return bpe.encode(docs, RANKS, PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: bit codes, fingerprints and merges have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
