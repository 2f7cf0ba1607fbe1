"""The training-data pipeline over ``documents``: five stages, each one operator of ``chalkline.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import langid, linededup, mixing, neardup, packing
from chalkline.session import ensure_checkpoint_dir
from chalkline.sources.tables import read_table

#: Least posterior of a document's language.
LEAST_SCORE = 0.5
SHINGLE_WORDS, RADIUS = 3, 2
#: Target weights: as much of the domain as there is (None), or its share of all tokens. With no document used twice this
#: is the largest total there can be, so what is clearly of a wanted domain is kept once and the shares of ``high`` and
#: ``low`` are the corpus's own; the toxic total ends as near to nothing as the other two targets allow.
WEIGHTS: dict[str, float | None] = {"high": None, "low": None, "toxic": 0.0}
MOST_USES = 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; learned from the two folds of op2's training."""
    model = langid.train(docs.filter(langid.fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang"))
    return langid.keep_known(docs, model, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that lost all its words with them goes."""
    found = linededup.dedup_lines(docs, linededup.THRESHOLD, "__lines", "__removed")
    emptied = (F.col("__removed") > 0) & ~F.col("text").rlike(r"[^ \t\r\f\x0B\n]")
    return (found.filter(~F.coalesce(emptied, F.lit(False)))
            .withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.keep_first(docs, SHINGLE_WORDS, RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates, of one use at most, that come nearest to the target weights."""
    rates = mixing.mix(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"), WEIGHTS, most=MOST_USES)
    return mixing.resample(docs, rates, MOST_USES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("mix_sources", mix_sources), ("pack", pack)]

#: Language models, 64-bit hashes and vocabularies have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they keep is written to the shared checkpoint folder on the way."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
