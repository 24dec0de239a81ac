"""One thin query for each operator, over its whole table, and its DuckDB oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, infilling, media, mixing, packing, pii, prefix_trie, quality, repeats, sharding, simhash, urls, warc
from ._shared import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


@query("op4_cost_balanced_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_cost"
    )


@query("op6_source_mixing", mixing.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).drop("copies")


@query("op10_url_cascade", urls.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages")).drop("listed")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


@query("op8_candidate_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == pii.BASE.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query("op5_warc_archive", warc.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


@query("op7_balanced_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


@query("op9_line_crf_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


@query("op3_progressive_jpeg")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.decode_media(media.store_texts(read_table(spark, sf_dir, "documents")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "height", "width", F.lit("3")), F.transform("features", lambda x: F.format_number(x, 4))).alias("feature"),
        F.sha2("rgb", 256).alias("rgb_sha256"),
    )


@query("op11_fill_in_middle", infilling.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.restore_texts(infilling.fill_in_middle(read_table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


@query("op12_conversation_trie", prefix_trie.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


@query("op13_suffix_repeats", repeats.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
