"""The corpus pipeline: each stage takes what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import mixing, sentencepiece, simhash, suffixes, toxicity
from docquarry.llm.common import shared_dir, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; labels are those of the input folder."""
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 3 or fewer differing fingerprint bits."""
    return simhash.keep_one(spark, docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur elsewhere; every document stays."""
    return suffixes.keep_rest(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot, and row in it, of an interleaving of the sources with equal target weights."""
    return mixing.with_slots(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with its slot and row in the mix."""
    return sentencepiece.encode_documents(docs, sentencepiece.load_pieces(sentencepiece.MODEL_PATH), ["slot", "row"])


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("mixing", mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/docquarry/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning, rounds of label spreading and the codec aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str | None] = {}
