"""A corpus pipeline: toxicity, language, near copies, benchmark passages, pieces.

Near-dedup names candidates by variants of segments of SimHash fingerprints and links them by the exact similarity of their
five-word shingles.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Defined cases are those of the operators: null and empty texts pass toxicity like any clean text and go at
language identification, which finds no letter in them; a repeated row stays once after near-dedup; an
empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import drop_path, recorded, shielded, written
from tidelog.llm.decontamination import decontaminated
from tidelog.llm.language_id import UNKNOWN, held_out, train, with_language
from tidelog.llm.piece_sampling import with_pieces
from tidelog.llm.queries import PIECES, vocabulary
from tidelog.llm.simhash import without_near_copies
from tidelog.llm.toxicity import train as train_toxicity
from tidelog.llm.toxicity import with_toxicity

#: A document goes at this score or above.
TOXIC = 0.5
#: A document goes if its language is less sure than this.
LEAST_SURE = 0.2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC``."""
    model = train_toxicity(docs.where(~held_out("doc_id")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, back = shielded(docs, ["toxicity"])
    return with_toxicity(inner, model).where(F.col("toxicity") < TOXIC).select(*back)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and one language that is sure enough."""
    model = train(docs.where(~held_out("doc_id")))
    inner, back = shielded(docs, ["lang_pred", "lang_score"])
    labelled = with_language(inner, model, spans=False)
    return labelled.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_SURE)).select(*back)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, found by SimHash fingerprints and verified."""
    return without_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that a benchmark contaminates; shorter passages are cut from the others."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``piece_ids``, a sampled segmentation that decodes to the text."""
    return with_pieces(docs, vocabulary(PIECES))


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL expresses neither the models nor the fingerprints; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage read or made is deleted once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        for path in {*before, *made[:-1]}:
            drop_path(spark, path)
        before = made[-1:]
    return docs
