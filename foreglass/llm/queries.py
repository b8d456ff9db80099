"""The dealt operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foreglass.llm import (
    bloom_lm,
    decontaminate,
    exact_dedup,
    filter_audit,
    langid,
    mixing,
    near_dedup,
    periodic_runs,
    quality,
    sharding,
    tiled_cosine,
    toxicity,
    warc,
)
from foreglass.llm.sampling import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards 0 to 39 of near equal bytes; equal texts stay together."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document so that sources meet their weights."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    found = quality.score(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles are at least 80 % the same."""
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4, share=(80, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from six sevenths of them."""
    docs = _table(spark, sf_dir, "documents")
    model, counts = bloom_lm.train(docs, fold("doc_id", 7) != 2)
    found = bloom_lm.score(docs, model, counts)
    return found.select(
        F.col("id").alias("doc_id"), (fold("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to a content-addressed archive and read back."""
    records = warc.archived(_table(spark, sf_dir, "pages"), least_bytes=1000)
    found = F.sha1("payload")
    digest = F.when(found == F.col("payload_digest"), found).otherwise(F.raise_error(F.lit("a payload is not what its header says")))
    return records.select(
        F.col("page").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal without blanks, and the row of each that stays."""
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label whose cosine is 0.98 or more."""
    found = tiled_cosine.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in each of their 120 orders."""
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: from a place on, about a tenth of the texts repeat the words that stand there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    split = chosen.withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    at = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("rest", F.col("n") - F.col("a"))
    period = at.withColumn("p", 1 + F.floor(F.col("rest") / (3 + F.col("g") % 8)))
    times = F.ceil(F.col("rest") / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int")), times))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), F.col("rest").cast("int"))), " ")
    return period.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every text."""
    found = periodic_runs.periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    listed = found.withColumn("best", best).withColumn("lines", F.array_join(F.transform("runs", line), ""))
    return listed.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


NUMBERED = (
    op1_decontaminate,
    op2_shards,
    op3_language,
    op4_mix,
    op5_quality,
    op6_near_dedup,
    op7_toxicity,
    op8_language_model,
    op9_warc,
    op10_exact_dedup,
    op11_embedding_dedup,
    op12_filter_audit,
    op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in NUMBERED}
