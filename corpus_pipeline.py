"""The corpus pipeline: from raw documents to encoded ones, in stages that are each written and read again.

Every stage works on all that the one before kept. The columns of documents go through unchanged up to the last stage, which gives the
encoded documents: the columns of documents but for text, with n_tokens, token_ids and decoded (the text decoded again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm.common import Shelf, read, tokenizer_file
from spectrel.llm.decontam import clean
from spectrel.llm.piecebpe import encode_decode
from spectrel.llm.quality import resample
from spectrel.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws. Nulls, empty texts and repeated rows are as resample() defines them."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    return resample(rows, read(spark, sf_dir, "labels"), keep=["row", "doc_id"]).where("keep").select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group (five words, similarity 0.8). Nulls, empty texts and repeated rows are as near_dedup() defines them."""
    return near_dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the benchmark. Nulls, empty texts and repeated rows are as decontaminate() defines them."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens. Nulls, empty texts and repeated rows are as encode_decode() defines them."""
    out = encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), keep=[c for c in docs.columns if c != "text"])
    return out.drop("ids_text")


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminated", decontaminated), ("encoded", encoded)]
#: The learned weights and the tokenizer can't be stated in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again. Edge cases are as the stages define them; an empty table gives an empty one."""
    shelf, docs = Shelf(spark, "pipeline"), read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return docs
