"""Registered queries of this subpackage: ``QUERIES`` (name -> f(spark, sf_dir)) and
``ORACLES`` (name -> DuckDB SQL).  Each query applies one operator with production
parameters to its whole table and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockspark.llm import oracles
from shockspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The url rules (host, path, verdict) of the registered query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Key of the registered query; a user passes a secret of their own.
PII_KEY = "registered-query"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


@query("op4_sharding", oracles.sharding(SHARDS))
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    from shockspark.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


@query("op6_url_filters", oracles.url_filters())
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    from shockspark.llm.urlfilter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures and verdict of every document."""
    from shockspark.llm.quality import quality_rules as judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op1_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the ids decoded again, as digests."""
    import public_tokenizers

    from shockspark.llm.bpe import decode, encode

    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), _ranks(), public_tokenizers.PATTERN).drop("text")
    back = decode(ids, _ranks())
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from shockspark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_packing", oracles.packing())
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every sequence of the documents (byte tokens)."""
    from shockspark.llm.packing import byte_length, pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_length())


@query("op3_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    from shockspark.llm.syncmers import anchors, as_text, likeness, replace_tail, with_next

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs).withColumn("edited", replace_tail(F.col("text"), F.col("next_text")))
    marked = anchors(anchors(anchors(pairs, "text", "own"), "edited", "changed"), "next_text", "next")
    return marked.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
                         likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                         likeness(F.col("own"), F.col("next")).alias("near_next"))


@query("op8_pii")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    from shockspark.llm.surrogates import replace_personal_data

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_personal_data(docs, PII_KEY, counted="n_replaced").select("doc_id", "n_replaced", "text")


@query("op9_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    from shockspark.llm.toxicity import held_out, scores, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from shockspark.llm.html import extract_text

    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_hard_negatives", oracles.hard_negatives())
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor's positives."""
    from shockspark.llm.hardneg import mine

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


@query("op12_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every (damaged) conversation."""
    from shockspark.llm.repair import damaged, digests, repair, reports

    rows = table(spark, sf_dir, "conversations")
    repaired, turns = repair(damaged(rows))
    found = reports(repaired, turns).withColumnRenamed("conv_id", "c")
    hashes = digests(repaired).withColumnRenamed("conv_id", "d")
    every = rows.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op13_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes the template, as budgeted windows, read back."""
    import public_tokenizers

    from shockspark.llm.chat import byte_pair_tokens, read_back, windows

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(quoting).alias("text"))
    return read_back(windows(rows.unionByName(added), byte_pair_tokens(_ranks(), public_tokenizers.PATTERN), budget=2048, history_turns=2, history_tokens=256))
