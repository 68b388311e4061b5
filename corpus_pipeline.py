"""A corpus pipeline of five training-data operators, each stage written and read again.

Columns that the stages don't know pass through. A column with the name of one that a stage
adds (`lang_pred`, `hit_spans`, `taken`, ...) is refused with a ValueError. An empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontaminate, language, mixing, secrets, simhash_near
from gaugeworks.llm._common import lean, shared_path, table
from gaugeworks.storage import mark, release


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no letters, null texts too; texts that mix languages stay, whatever the share of the leading one.

    Needs the columns text and lang; lang only fits the model. Repeated rows are judged alike.
    """
    lean(spark)
    model = language.fit(docs.select("text", "lang"))
    return language.predict(docs, model).filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near-duplicates: Jaccard 0.8 or more on five words.

    Texts without words are one class. Null doc_ids come last; of rows that tie or repeat one stays.
    """
    lean(spark)
    return simhash_near.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark; null and empty texts hold none and stay."""
    lean(spark)
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every row stays, nulls and repeated ones too."""
    lean(spark)
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of repetitions; texts without words take nothing and go.

    A null source is a source. Repeated rows are documents of their own.
    """
    lean(spark)
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("secret_scans", redacted),
    ("mixing", mixed),
]

#: Language models and fingerprints have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has written is dropped once the next one's input stands."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        out = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        release(spark, since, keep=out)
    return docs
