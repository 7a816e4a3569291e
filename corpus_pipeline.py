"""Documents to training shards: toxicity, near-duplicates, benchmark leaks, source mix, shards."""
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import colloquy
from colloquy.llm import decontam, mixing, sharding, simhash, toxicity
from colloquy.llm.common import saved, table
from colloquy.llm.queries import taught_labels

cloudpickle.register_pickle_by_value(colloquy)  # worker functions travel with the job

SHARDS = 40
#: Learned weights, fingerprints and alignments are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    lexicon = toxicity.learn(docs, "doc_id", "text", taught_labels(spark, sf_dir), "doc_id", "toxic")
    return toxicity.filtered(docs, "text", lexicon, below=0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return simhash.without_near_duplicates(docs, "doc_id", "text")


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.without_leaks(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the source mix, repeated or cut as it takes them."""
    return mixing.mixed_documents(docs, "doc_id", "text", "source", "n_chars")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and their slot in it."""
    return sharding.shard(docs, "doc_id", "text", SHARDS)


STAGES = [("toxicity", harmless), ("near_duplicates", distinct), ("benchmark_leaks", unleaked), ("source_mix", mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again, since the next reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
