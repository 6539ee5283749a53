"""From raw documents to an encoded training mixture, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wearline.llm.common import delete, scratch
from wearline.llm.jaccard import one_of_each
from wearline.llm.mixture import in_mixture_order, mix_sources
from wearline.llm.pieces import default_model, encode_documents
from wearline.llm.quality import judge_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return judge_quality(docs, COLUMNS, store=False).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return one_of_each(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the Pfair schedule deals their sources."""
    return in_mixture_order(mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece ids of the best segmentation, scores of the four best, and the row's slot and place in the mixture.

    Written tables keep no order of rows, and the stages between pass on the columns
    of ``documents`` only.  The schedule depends on nothing but the rows, so it is
    found again here: in order of (slot, place) the rows are the mixture.
    """
    mixed = mix_sources(docs.select("doc_id", "text", "source")).drop("source_block", "due")
    out = encode_documents(mixed, default_model(), carried=("slot", "place"))
    return out.select("doc_id", "source", "n_ids", "ids_crc32", "score", "scores", "round_trip", "ids", "slot", "place")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", encoding),
]

#: EM, min-hashing and segmentation have no SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written in the shared folder and read again."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            delete(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
