"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import alignment, chat, decontaminate, embeddings, infill, language, licenses, mixing, secrets, simhash, suffixes, urls, warc
from gaugeworks.llm._common import table
from gaugeworks.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.verdicts(decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


#: Rules that label a part of a template's urls, so that the tree decides on the others.
PARTIAL_RULES = (*(("block", f"{host}/en/{d}") for host in ("com", "net") for d in range(1, 8)), *(("allow", f"org/en/{d}") for d in range(1, 6)), ("block", "org/de/"))


def urls_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 under other rules, under which most verdicts are the tree's."""
    rules = tuple(urls.Rule(*r) for r in PARTIAL_RULES)
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


#: A conversation that says control strings, in another layout than the table's.
CONTROL = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.range(1).select((F.col("id") - 1).alias("conv_id"), F.lit(CONTROL).alias("record"))
    extra = chat.turns_of_records(records).select("conv_id", F.inline("turns"))
    turns = chat.turns_of_rows(table(spark, sf_dir, "conversations")).unionByName(extra)
    return chat.digest(chat.formatted(turns))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: A cosine that vectors of the table reach without being copies, so that the search has links to find.
NEAR_COSINE = 0.42


def embeddings_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 at a lower cosine, where few probes lose links: all lists within reach are searched."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), NEAR_COSINE, probes=None)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.filter(~held).select("text", "lang"))
    return language.predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep_text=False)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can express."""
    return op9_secrets(spark, sf_dir).drop("spans")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_decontamination, op2_mixing, op3_simhash, op4_urls, op5_chat, op6_embeddings, op7_language, op8_warc, op9_secrets, op10_suffixes, op11_licenses, op12_alignment, op13_infill, embeddings_near, secrets_base, urls_by_template)
}
