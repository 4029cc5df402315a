"""From raw documents to packed training sequences.

``run(spark, sf_dir)`` reads ``documents`` and applies the stages in order.
Each stage's result is written as a Parquet table in the shared checkpoint
folder and read again as the next one's input, so a lost executor costs a part
of one stage.  All stages but the last return the columns of ``documents``:

1. quality rules: rejected documents go;
2. line dedup: boilerplate lines of a source go, ``n_chars`` follows;
3. SimHash near-dedup: of each group of near copies one document stays;
4. mixing: sources are brought to their target weights, documents repeat or
   are left out, at most one document of a source is cut;
5. packing: pieces of fixed-length sequences.

ORACLE_SQL is None: fingerprints and token ids have no SQL form; a brute-force
version of all stages is in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsdrift.llm import line_dedup, mixing, packing, quality_rules, simhash
from tsdrift.llm.common import table
from tsdrift.session import materialize

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(docs).drop("dropped_lines")
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("source_mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
