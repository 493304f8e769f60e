"""From raw documents to encoded training text: five stages, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe_codec, mixing, quality, simhash_groups, toxicity
from plumbline.llm._common import materialize, release, table


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. Nulls, repeated rows, an empty table and other columns: see ``toxicity.keep_harmless``."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer takes for good text. Nulls, repeated rows, an empty table and other columns: see ``quality.keep_good``."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies. Nulls, repeated rows, an empty table and other columns: see ``simhash_groups.keep_first``."""
    return simhash_groups.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of sources below their target come again, of those above it some go. Nulls, repeated rows, an empty table and other columns: see ``mixing.mix``."""
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.rows_of_mix(mixing.mix(docs, shards=shards), shards)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to. Nulls, repeated rows, an empty table and other columns: see ``bpe_codec.encode_decode``."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), held=HELD, group=GROUP).withColumnRenamed("id", "doc_id")


#: Words that an encoding worker keeps, and code points whose words it looks at together: less than by itself, as executors come from the other stages with their memory touched.
HELD, GROUP = 30_000, 1 << 20


STAGES = [("toxicity", harmless), ("quality", good), ("simhash_near_dedup", distinct), ("mixing", mixed), ("bpe_codec", encoded)]

#: Fitted scores, hashes and tokens are nothing that SQL can express; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. Each stage gives nulls, repeated rows and an empty table the result that its docstring names; none fails on them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)  # the table itself isn't one of those
    return docs
