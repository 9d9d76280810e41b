"""The corpus pipeline: five stages, each on all that the one before it kept.

Every stage reads the columns of documents by name and returns them alone: other columns
go, whatever their names.  Stages take nulls in any column, empty and very long texts and
repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import contamination, jaccard, language_id, mixing, sharding
from larkspur.llm._store import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language can be told, or none with this probability.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told go on; if no language could be learned, all documents with a letter do.

    A null text, and one without a letter, is rejected.  Labels are only learned from: a
    null lang is no reason to go.  Equal texts, and so repeated rows, share their fate.
    """
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    out = language_id.identify(docs.select(*COLUMNS), model)
    return out.where((F.col("__lang_pred") != language_id.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id, of several such rows the one whose text has the smallest hash.

    Of repeated rows one stays; of a group in which all ids are null, or one id stands on
    several texts, one stays as well, the same in every run.  Null and empty texts, and
    texts without words, are linked with nothing and all stay.
    """
    found = jaccard.near_duplicates(docs)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("c")
    chosen = stage(found.where("n_shingles > 0").groupBy("component_key").agg(best).select("c.id", "c.k1", "c.k2"), "chosen")
    whole = F.coalesce("text", F.lit(""))
    keyed = docs.select(*COLUMNS, F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"))
    same = F.col("d.doc_id").eqNullSafe(F.col("c.id")) & (F.col("d.k1") == F.col("c.k1")) & (F.col("d.k2") == F.col("c.k2"))
    kept = keyed.alias("d").join(chosen.alias("c"), same, "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    # texts without words are linked with nothing
    wordless = keyed.where(~whole.rlike("[^\\x20\\x09-\\x0D]"))
    return kept.unionByName(wordless).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark passages go, with all their copies.  Null and empty texts have no words and stay."""
    hits = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = hits.where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("text").alias("sha"), F.length("text").alias("m")).distinct()
    bad = stage(bad, "contaminated")
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return docs.select(*COLUMNS, sha.alias("sha"), F.lit(32).alias("m")).join(bad, ["sha", "m"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most twice.  A null source is a source; documents without words go with their block; of repeated rows as many are taken as the quota asks for."""
    return mixing.mix(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; null texts count as empty, equal texts stand in one shard, repeated rows all stay."""
    return sharding.shard(docs.select(*COLUMNS))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: the first stage applies a trained network, the last two draw and divide by hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
