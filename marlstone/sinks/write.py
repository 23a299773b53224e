"""Writers. Each takes a frame and a path; Spark's committers make them safe against lost tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config.keywords import TYPE_ORDER
from ..operators.blocks import reading_order, type_place
from ..operators.recon import summary


def jsonl(blocks: DataFrame, path: str, by_doc: bool = True) -> None:
    """One folder per method and document, or (for very many documents) per method; the key columns stay in the rows."""
    keyed = blocks.withColumns({"_method": F.col("extraction_method")} | ({"_doc": F.col("doc_id")} if by_doc else {}))
    keyed.write.mode("overwrite").partitionBy("_method", *(["_doc"] if by_doc else [])).json(path)


def registry(documents: DataFrame, path: str) -> None:
    """Documents that were processed with success."""
    documents.where("processing_status = 'success'").write.mode("overwrite").json(path)


def export_json(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document one JSON text: document, blocks in order, counts and averages."""
    b = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "block_type", "page_number", "confidence", F.col("content.text").alias("text")))).alias("blocks"), F.count("*").alias("total_blocks"), F.avg("confidence").alias("avg_confidence"), F.array_sort(F.collect_set("extraction_method")).alias("methods"))
    j = documents.join(b, "doc_id", "left")
    s = F.struct(F.coalesce("total_blocks", F.lit(0)).alias("total_blocks"), "avg_confidence", "methods")
    return j.select("doc_id", F.to_json(F.struct(F.struct(*documents.columns).alias("document"), "blocks", s.alias("summary"))).alias("json"))


def render(blocks: DataFrame, line: Column, by: list[str], *order: Column, head: Column | None = None, end: str = "\n\n") -> DataFrame:
    """Text per group from one line per block, in order; the one renderer of all Markdown and text exports."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda r: r["_line"]), end)
    out = blocks.withColumn("_line", line).where("_line <> ''").withColumn("_n", n).groupBy(*by).agg(body.alias("text"))
    return out if head is None else out.withColumn("text", F.concat_ws(end, head, "text"))


def markdown(blocks: DataFrame) -> DataFrame:
    """Markdown with provenance: pages in order, types in their fixed order; other types are left out."""
    comment = F.format_string("<!-- %s p%d %.2f -->", "extraction_method", F.coalesce("page_number", F.lit(1)), "confidence")
    text = F.coalesce("content.text", F.lit(""))
    shown = F.when(F.col("block_type") == "title", F.concat(F.lit("## "), text)).when(F.col("block_type") == "formula", F.concat(F.lit("$$"), text, F.lit("$$"))).otherwise(text)
    some = blocks.where(F.col("block_type").isin(TYPE_ORDER) & (text != ""))
    return render(some, F.concat_ws("\n", comment, shown), ["doc_id"], F.col("page_number"), type_place(F.col("block_type")), F.col("ord"), head=F.format_string("# %s", "doc_id"))


def plain(blocks: DataFrame) -> DataFrame:
    """Text in reading order."""
    return render(blocks, F.coalesce("content.text", F.lit("")), ["doc_id"], *reading_order(), end="\n")


def sections_report(blocks: DataFrame, label: Column) -> DataFrame:
    """Blocks reassembled by a label: one text per document and label."""
    return render(blocks.withColumn("label", label), F.format_string("[p%d %s] %s", F.coalesce("page_number", F.lit(1)), "block_type", F.coalesce("content.text", F.lit(""))), ["doc_id", "label"], F.col("page_number"), F.col("ord"), end="\n")


FORMS = ["markdown", "json", "text"]


def exports(documents: DataFrame, blocks: DataFrame, method: str, form: str) -> DataFrame:
    """doc_id, method, form, text: one method's blocks of each document in one of FORMS. A method without blocks gives no rows."""
    mine = blocks.where(F.col("extraction_method") == method)
    if form == "json":
        out = export_json(documents.join(mine.select("doc_id").distinct(), "doc_id", "left_semi"), mine).withColumnRenamed("json", "text")
    else:
        out = {"markdown": markdown, "text": plain}[form](mine)
    return out.select("doc_id", F.lit(method).alias("method"), F.lit(form).alias("form"), "text")


def processing_summary(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row on a run: documents by status, blocks, pages, methods."""
    d = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("processing_status") == "success").alias("succeeded"))
    b = blocks.agg(F.count("*").alias("blocks"), F.count_distinct("doc_id").alias("documents_with_blocks"), F.array_join(F.array_sort(F.collect_set("extraction_method")), ",").alias("methods"))
    return d.crossJoin(b)  # one row and one row


def drift_markdown(drift: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown text with a table of the drift summary, from its rows."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    rows = drift.agg(F.array_join(F.array_sort(F.collect_list(cells)), "\n").alias("rows"))  # one row per method
    head = "# Drift\n\n| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return rows.select(F.concat(F.lit(head), "rows").alias("text"))


def banner(title: Column, body: Column, tables: Column) -> Column:
    """Clean-text frame: title, body and, if there are any, tables."""
    rule = F.lit("=" * 60)
    return F.concat_ws("\n", rule, title, rule, body, F.when(tables != "", F.concat(F.lit("TABLES\n"), tables)))


def recon_csv(recon: DataFrame, path: str) -> list[str]:
    """One CSV per status that occurs; returns the statuses written. Those that don't occur are removed by the overwrite of ``path``."""
    recon.withColumn("_status", F.col("status")).write.mode("overwrite").partitionBy("_status").option("header", "true").csv(path)
    return sorted(r[0] for r in recon.select("status").distinct().collect())


def manifest(recon: DataFrame, tables: int, tolerance: float, rounding: float) -> DataFrame:
    """One row on a run, for JSON."""
    return summary(recon).select("*", F.lit(tables).alias("tables"), F.lit(tolerance).alias("tolerance"), F.lit(rounding).alias("rounding_tolerance"))


def csv_lines(cells: DataFrame) -> DataFrame:
    """table_id, row_idx, line: each row's cells as a CSV line. Cells with commas, quotes or line feeds are quoted, and a row's only cell if it is empty."""

    def quoted(v: Column) -> Column:
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit("")))

    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda c: quoted(c["value"])), ",")
    return cells.groupBy("table_id", "row_idx").agg(line.alias("line")).withColumn("line", F.when(F.col("line") == "", '""').otherwise(F.col("line")))


def tables_csv(cells: DataFrame, path: str, by_table: bool = True) -> None:
    """Rows as CSV lines in order: a folder per table, or (for very many tables) one set of files with table_id, row_idx and line."""
    rows = csv_lines(cells).repartition("table_id").sortWithinPartitions("table_id", "row_idx")
    if by_table:
        rows.select("table_id", "line").write.mode("overwrite").partitionBy("table_id").text(path)
    else:
        rows.write.mode("overwrite").json(path)


def boxes_json(blocks: DataFrame, path: str) -> None:
    blocks.select("doc_id", "page_number", "block_id", "block_type", "bounding_box.*").write.mode("overwrite").json(path)


def schemas() -> dict[str, dict]:
    """JSON form of the library's schemas, by name."""
    import json

    from pyspark.sql.types import StructType

    from .. import schemas as S

    return {n.lower(): json.loads(StructType.fromDDL(getattr(S, n)).json()) for n in ("DOCUMENT", "BLOCK", "PAGE", "WORD", "CELL", "FACT", "METRIC")}
