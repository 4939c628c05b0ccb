"""The contract queries ``opN_<name>``: thin digests of the operators' outputs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import scaled_round
from . import language_id, oracles, quality_boost
from .common import id_fold, materialise, table, word_count
from .decontaminate import contamination
from .fill_middle import fill_middle, restored
from .jaccard_join import jaccard_components
from .license_scan import scan_licenses
from .mixing import mix_sources
from .page_text import extract_text
from .quality_rules import judge_quality
from .secret_scan import scan_secrets
from .sharding import ring_shards
from .turn_repair import damaged, repair_turns, turn_digests
from .url_filter import Rule, filter_urls


#: The contract's URL rules.
URL_RULES = [
    Rule.parse("block", "com/en/"),
    Rule.parse("allow", "example.com/en/7"),
    Rule.parse("allow", "net/de/"),
    Rule.parse("block", "example.net/de/8"),
    Rule.parse("block", "org/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; off the rules the models' verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "margin")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base phrases and the method's labels. Null texts have no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "matches")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted once and written; the operator reads ids, sources and sizes."""
    docs = table(spark, sf_dir, "documents")
    thin = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    return mix_sources(thin, text_col="words", size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans as a digest, and all spans. Null texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("secrets", lambda x: x["kind"] != "format"))
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op5_quality_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by trees that learned from two folds of three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    trees = quality_boost.train(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return quality_boost.score_quality(docs, trees).select("doc_id", "held_out", "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base verdict and verdict by divergence. Null texts fail."""
    return judge_quality(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the smallest id that links reach."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items. Null texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the documents of three folds of four, but for a sixteenth of all, which only sets the rejection limits."""
    learn = docs.where(id_fold(F.col("doc_id"), 4) != 2)
    held = id_fold(F.col("doc_id"), 16) == 5
    return language_id.calibrate(language_id.train(learn.where(~held)), learn.where(held))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by models that learned from three folds of four."""
    docs = table(spark, sf_dir, "documents")
    model = language_model(docs)
    rows = docs.select("doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return language_id.predict(rows, model).drop("text")


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of equal bytes; copies of a text share a shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    placed = ring_shards(docs, n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, by wrappers of all its host's pages. Null pages have none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the contract's damage, the cheapest audit and a digest of what it repairs to. Conversations that lost all turns have zeros."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = repair_turns(damaged(rows))
    every = rows.select("conv_id").distinct()
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    found = every.join(repair.summary.withColumnRenamed("conv_id", "__conv"), same, "left").drop("__conv")
    found = found.join(turn_digests(repair.turns).withColumnRenamed("conv_id", "__conv"), same, "left").drop("__conv")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle form, with digests of the output and of what is rebuilt from it alone. Null texts are empty."""
    docs = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    digest = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_license_scan": op2_license_scan,
        "op3_mix_sources": op3_mix_sources,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality_boost": op5_quality_boost,
        "op6_quality_rules": op6_quality_rules,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_decontaminate": op8_decontaminate,
        "op9_language_id": op9_language_id,
        "op10_ring_shards": op10_ring_shards,
        "op11_page_text": op11_page_text,
        "op12_turn_repair": op12_turn_repair,
        "op13_fill_middle": op13_fill_middle,
        **fields(),
    }


def url_rule_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled")
    return op1_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", ruled)


def license_base_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mix_target_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", scaled_round("target", 3).alias("target"))


def quality_count_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def fields() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Of queries whose method SQL cannot state, the fields that it can, read from the same operators."""
    return {f.__name__: f for f in (url_rule_fields, license_base_fields, mix_target_fields, quality_count_fields)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_jaccard_join": oracles.JACCARD,
        "op8_decontaminate": oracles.OP8_SQL,
        "op11_page_text": oracles.PAGE_TEXT,
        "op12_turn_repair": oracles.TURN_REPAIR,
        "op13_fill_middle": oracles.FILL_MIDDLE,
        "url_rule_fields": oracles.URL_RULES,
        "license_base_fields": oracles.LICENSE_BASE,
        "mix_target_fields": oracles.MIX_TARGETS,
        "quality_count_fields": oracles.QUALITY_COUNTS,
    }
