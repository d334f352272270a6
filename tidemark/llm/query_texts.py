"""Queries on texts (problems 8 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.leakage import leaks
from tidemark.llm.packing import pack
from tidemark.llm.toxicity import scores, train, verdict_shares
from tidemark.session import durable, table


# --- 8: filling windows ---
def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), "doc_id", "text", "source").withColumnRenamed("doc", "doc_id")


def p8_windows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, piece, start, tokens, window): every text in windows of 2,048 tokens."""
    return _packed(spark, sf).select("doc_id", "piece", "start", "tokens", "window")


def _windows(w: DataFrame) -> DataFrame:
    return w.groupBy("window").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"), F.count_distinct("source_h").alias("s"), F.count_distinct("cluster").alias("c"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, pieces, tokens, share of the windows' room that is used, and windows with two pieces of one source."""
    return _windows(_packed(spark, sf)).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count(F.lit(1)) * 2048), 4).alias("fill"), F.count_if(F.expr("p > s")).alias("source_conflicts")
    )


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed, and what must not be: overfull windows, copies in one window, texts cut though they fit,
    texts with a gap between their pieces, source conflicts in more than a twentieth of the windows, fill under 0.98
    (without the last window)."""
    w = durable(_packed(spark, sf))
    per = _windows(w).agg(F.count_if(F.expr("t > 2048")).alias("overfull"), F.count_if(F.expr("p > c")).alias("copies_together"), (F.count_if(F.expr("p > s")) * 20 > F.count(F.lit(1))).alias("many_conflicts"), (F.sum("t") < 0.98 * 2048 * (F.count(F.lit(1)) - 1)).alias("loose"))
    doc = w.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"), F.max(F.col("start") + F.col("tokens")).alias("end"))
    doc = doc.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("p > 1 and t <= 2048")).alias("cut_short"), F.count_if(F.expr("end <> t")).alias("gaps"))
    return doc.join(per)


P8_SQL = {
    "p8_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS cut_short, 0::BIGINT AS gaps, 0::BIGINT AS overfull, 0::BIGINT AS copies_together, FALSE AS many_conflicts, FALSE AS loose FROM documents WHERE length(trim(text)) > 0"
}


# --- 9: leaking evaluation texts ---
def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, item_id): documents with at least twelve words in a row of the item's own wording."""
    return _leaks(spark, sf).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks with the number of windows found and the longest run of words."""
    return _leaks(spark, sf).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows", "longest")


# --- 10: abuse, hate, sexual content ---
def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: score, toxic passages, scores by class, flag."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "review_labels")
    model = train(docs, "doc_id", "text", labels, "doc_id", "verdict")
    return scores(docs, "doc_id", "text", "source", model, verdict_shares(labels, "doc_id", "verdict")).withColumnRenamed("doc", "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id): documents with abuse of persons, hate against groups or sexual content."""
    return p10_scores(spark, sf).where("flagged").select("doc_id")


def p10_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, flagged documents and their share per source, with the class of the strongest passage."""
    s = p10_scores(spark, sf)
    top = F.greatest("abuse", "hate", "sexual")
    return s.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(F.col("flagged") & (F.col("abuse") == top)).alias("abuse"),
        F.count_if(F.col("flagged") & (F.col("hate") == top)).alias("hate"),
        F.count_if(F.col("flagged") & (F.col("sexual") == top)).alias("sexual"),
        F.round(F.count_if("flagged") / F.count(F.lit(1)), 6).alias("rate"),
    )


QUERIES = {
    "p8_windows": p8_windows,
    "p8_fill": p8_fill,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_source_rates": p10_source_rates,
}
SQL: dict = P8_SQL
