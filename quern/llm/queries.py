"""The queries of this package: thin calls of its operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, funnel, katz, langid, lexical, linededup, minhash, packing, pii, recompress, shards, urlfilter
from .common import read, scratch


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time made from the id; the tables have none."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return read(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched_at"))


def _entries(captures: DataFrame) -> DataFrame:
    """Dated entries made from the hosts' digests: a third of the hosts is listed, half of these for a time, some again, and some by a path."""
    hosts = captures.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    x = F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("int")
    change = lambda key, action, day: F.struct(F.lit("hosts").alias("list"), key.alias("key"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("at"))
    host, first = F.col("host"), F.col("x") % 200
    made = F.array(
        F.when(F.col("x") % 3 == 0, change(host, "add", first)),
        F.when((F.col("x") % 3 == 0) & (F.col("x") % 2 == 0), change(host, "remove", first + 60)),
        F.when((F.col("x") % 3 == 0) & (F.col("x") % 5 == 0), change(host, "add", first + 120)),
        F.when(F.col("x") % 7 == 0, change(F.concat(host, F.lit("/en")), "add", first)),
    )
    return hosts.withColumn("x", x).select(F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("e.*")


def op1_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    found = urlfilter.as_of(captures, _entries(captures))
    return found.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "blocked", "matched_key", F.date_format("listed_since", "yyyy-MM-dd").alias("listed_on"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.learn(docs, train=~held)
    tagged = langid.tag(docs.select("doc_id", "text"), model)
    return tagged.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits_per_byte"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key="a key for these tables")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/shards-{uuid.uuid4().hex}"
    rows = shards.materialise(read(spark, sf_dir, "documents"), key=20240101)
    shards.write_shards(rows, path)
    return shards.read_back(spark, path)


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = katz.score(docs, train=~katz.held_out(F.col("doc_id")))
    return scored.select("doc_id", katz.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines", "removed_words")


def op10_scaled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(fingerprint.fingerprints(read(spark, sf_dir, "documents")))


FUNNELS = [
    funnel.Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    funnel.Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    funnel.Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
]


def op11_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnels(read(spark, sf_dir, "clicks"), FUNNELS)


def op12_recompressed_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompress.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(read(spark, sf_dir, "documents"))
    found = lexical.search(index, read(spark, sf_dir, "benchmark"))
    index.discard()
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_temporal_url_filter": op1_temporal_url_filter,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_spaced_seed_decontamination": op3_spaced_seed_decontamination,
    "op4_ppm_language_id": op4_ppm_language_id,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_training_order": op7_training_order,
    "op8_katz_backoff": op8_katz_backoff,
    "op9_winnowed_line_dedup": op9_winnowed_line_dedup,
    "op10_scaled_fingerprint": op10_scaled_fingerprint,
    "op11_ordered_funnels": op11_ordered_funnels,
    "op12_recompressed_substrings": op12_recompressed_substrings,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}
