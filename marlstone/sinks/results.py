"""Result files as frames of text: extraction results, reconciliation results, metrics. Any of them can be written by ``DataFrame.write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config.methods import PROFILES
from ..functions.fuzzy import ratio
from ..functions.text import normalize_label
from ..operators.mapping import auto_map
from ..operators.methods import gate


def combined_result(documents: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, json of methods that keep page texts and tables apart. documents: doc_id, seconds; pages: doc_id, chars, used_ocr, success; tables: doc_id, rows."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if("used_ocr").alias("pages_with_ocr"), F.count_if("success").alias("successful_pages"), F.sum("chars").alias("total_characters"))
    t = tables.groupBy("doc_id").agg(F.count("*").alias("tables_found"), F.sum("rows").alias("total_rows"))
    j = documents.join(p, "doc_id", "left").join(t, "doc_id", "left").fillna(0)
    text = F.struct("total_pages", "pages_with_ocr", "successful_pages", "total_characters")
    body = F.struct(F.struct(F.col("doc_id").alias("name"), F.col("seconds").alias("processing_time_seconds")).alias("pdf_info"), text.alias("text_extraction"), F.struct("tables_found", "total_rows").alias("table_extraction"))
    return j.select("doc_id", F.to_json(body).alias("json"))


def layout_result(blocks: DataFrame) -> DataFrame:
    """doc_id, json of methods that find blocks on pages: pages in order with their blocks in order, and counts by type. A document's blocks are
    gathered page by page."""
    block = F.struct("ord", "block_id", F.col("block_type").alias("type"), "confidence", F.col("content.text").alias("content"))
    pages = blocks.groupBy("doc_id", F.coalesce("page_number", F.lit(1)).alias("page_number")).agg(F.array_sort(F.collect_list(block)).alias("detected_blocks"))
    pages = pages.withColumn("n", F.size("detected_blocks")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "detected_blocks"))).alias("pages"), F.sum("n").alias("total_blocks"))
    kinds = blocks.groupBy("doc_id", "block_type").count().groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "count")))).alias("blocks_by_type"))
    j = pages.join(kinds, "doc_id")
    return j.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("pdf_name"), "pages", F.struct("total_blocks", "blocks_by_type").alias("extraction_summary"))).alias("json"))


def results_json(recon: DataFrame, by: str, shown: list[str]) -> DataFrame:
    """by, json: a filing's reconciliation with its summary and its rows by status, each list sorted by the columns ``shown``."""
    rows = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct(*shown))))
    n = lambda s: F.count_if(F.col("status") == s)
    m, d = n("match"), n("discrepancy")
    summary = F.struct(m.alias("total_matches"), d.alias("total_discrepancies"), n("pdf_only").alias("pdf_only_count"), n("xbrl_only").alias("xbrl_only_count"), (m / F.greatest(F.lit(1), m + d)).alias("match_rate"))
    g = recon.groupBy(by).agg(summary.alias("summary"), *[rows(s).alias(a) for s, a in (("match", "matches"), ("discrepancy", "discrepancies"), ("pdf_only", "pdf_only"), ("xbrl_only", "xbrl_only"))])
    return g.select(by, F.to_json(F.struct("summary", "matches", "discrepancies", "pdf_only", "xbrl_only")).alias("json"))


def automap_rows(labels: DataFrame, catalog: list[str] | None = None) -> DataFrame:
    """pdf_label, mapped_concept, confidence_hint (likeness of both when normalised; null without a concept)."""
    m = auto_map(labels, catalog).withColumns({"_a": normalize_label(F.col("label")), "_b": normalize_label(F.col("concept"))})
    return m.select(F.col("label").alias("pdf_label"), F.col("concept").alias("mapped_concept"), F.when(F.col("concept").isNotNull(), ratio("_a", F.coalesce("_b", F.lit("")))).alias("confidence_hint"))


def csv_table(df: DataFrame, path: str) -> None:
    """CSV with a header, replaced whole (metrics, automap rows, batch summaries, comparisons, drift)."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def metrics_json(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row, json: figures of each method and whether it passes. One entry per method."""
    g = gate(metrics, bounds)
    entry = F.struct(F.struct("wer").alias("text_extraction"), F.struct("precision", "recall").alias("table_extraction"))
    sorted_map = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("method"), v.alias("v")))))
    one = g.agg(sorted_map(entry).alias("methods"), sorted_map(F.struct("passed", "failures")).alias("validation"))
    return one.select(F.to_json(F.struct("methods", "validation"), {"ignoreNullFields": "false"}).alias("json"))


def validation_text(gated: DataFrame) -> DataFrame:
    """One row, text: the gate's outcome as it is printed, methods by name."""
    lines = F.when(F.col("passed"), F.lit("  ✅ All thresholds met")).otherwise(F.array_join(F.transform("failures", lambda f: F.concat(F.lit("  ❌ "), f)), "\n"))
    part = F.concat(F.lit("\n"), F.upper("method"), F.when(F.col("passed"), ": PASS\n").otherwise(": FAIL\n"), lines)
    one = gated.agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("parts"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_ok"))
    rule = "=" * 50
    end = F.concat(F.lit(f"\n\n{rule}\nOVERALL: "), F.when(F.col("all_ok"), "ALL TESTS PASSED").otherwise("SOME TESTS FAILED"), F.lit(f"\n{rule}"))
    return one.select(F.concat(F.lit(f"\n{rule}\nMETRICS VALIDATION RESULTS\n{rule}\n"), "parts", end).alias("text"), "all_ok")


def method_configs() -> dict[str, dict]:
    """Settings of each method as they are known to the library: organisation, formats, capabilities."""
    from ..config.keywords import CONFIDENCE, HAS

    return {m: {"organization": p["organization"], "output_formats": p["formats"], "capabilities": HAS[m], "confidence": {"_".join(k): v for k, v in CONFIDENCE.items()}} for m, p in PROFILES.items()}
