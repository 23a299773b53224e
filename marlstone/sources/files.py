"""Scans of documents, blocks, page texts, tables, words, results, reports and settings. Paths may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_number, percent, strip
from ..schemas import BLOCK, WORD


def documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files of a folder, not its subfolders: name, path, size, SHA-256; the bytes come along as ``content``."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)
    return f.select(name("path").alias("doc_name"), F.col("path").alias("doc_path"), F.col("length").alias("file_size_bytes"), F.coalesce(F.sha2("content", 256), F.lit("unknown_checksum")).alias("checksum"), "content")


def name(path: str):
    return F.element_at(F.split(path, "/"), -1)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of JSON lines; blank lines give no row."""
    return spark.read.schema(BLOCK).option("mode", "DROPMALFORMED").json(path)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole page_*.txt files: page_number, text, file."""
    f = spark.read.option("pathGlobFilter", "page_*.txt").text(path, wholetext=True)
    return f.select(page_number(name("_metadata.file_path")).alias("page_number"), F.col("value").alias("text"), name("_metadata.file_path").alias("file"))


def table_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Cells of CSV files whose headers differ: table_id (file name), row_idx, col_idx, value. No inference, no merged schema.

    Files are read whole; quoted cells may hold commas, quotes and line feeds; unreadable files give no rows.
    """
    f = spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    return csv_cells(f.select(F.regexp_replace(name("_metadata.file_path"), r"\.csv$", "").alias("table_id"), "value"), "value")


_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def csv_cells(texts: DataFrame, text: str) -> DataFrame:
    """Cells of whole CSV texts, beside their other columns: row_idx (blank lines count, but give no cells), col_idx, value. Quotes come off."""
    keep = [c for c in texts.columns if c != text]
    lines = F.regexp_extract_all(text, F.lit(rf'((?:[^"\r\n]++|{_QUOTED}|")*+)(?:\r?\n|$)'), F.lit(1))
    rows = texts.select(*keep, F.posexplode(lines).alias("row_idx", "line")).where("line <> ''")
    cells = F.regexp_extract_all("line", F.lit(rf"(?:^|,)({_QUOTED}|[^,]*)"), F.lit(1))
    clean = F.transform(cells, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return rows.select(*keep, "row_idx", F.posexplode(clean).alias("col_idx", "value"))


def filings(spark: SparkSession, root: str) -> DataFrame:
    """Cells of all */tables/*.csv under a root, in one job: doc_id is the folder's name."""
    f = spark.read.option("ignoreCorruptFiles", "true").text(f"{root}/*/tables/*.csv", wholetext=True)
    path = F.split("_metadata.file_path", "/")
    return csv_cells(f.select(F.element_at(path, -3).alias("doc_id"), F.regexp_replace(F.element_at(path, -1), r"\.csv$", "").alias("table_id"), "value"), "value")


RESERVED = ["comparison", "logs", "reports", "tmp"]


def processed(outputs: DataFrame, reserved: list[str] = RESERVED) -> DataFrame:
    """Names of the documents that have an output folder (column ``folder``), without the reserved ones."""
    return outputs.select(F.lower("folder").alias("folder")).where(F.col("folder").isNotNull() & ~F.col("folder").isin(reserved)).distinct()


def file_stats(files: DataFrame, by: list[str]) -> DataFrame:
    """Table files of each group (column ``file``): how many are CSV, and which formats there are."""
    kind = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    g = files.withColumn("_k", kind).groupBy(*by)
    return g.agg(F.count_if(F.col("_k") == "csv").alias("csv_files"), F.array_sort(F.collect_set(F.when(F.col("_k") != "", F.col("_k")))).alias("formats"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """Word boxes of JSON files, arrays of pages with words."""
    w = "struct<text:string,x0:double,x1:double,top:double,bottom:double,fontname:string,size:double>"
    pages = spark.read.schema(f"doc_id string, page_number int, words array<{w}>").option("multiLine", "true").json(path)
    return explode_words(pages)


def explode_words(pages: DataFrame) -> DataFrame:
    """WORD rows of pages with an array ``words``."""
    each = pages.select("doc_id", "page_number", F.posexplode("words").alias("ord", "w"))
    return each.select("doc_id", "page_number", F.col("ord").cast("long"), "w.*").to(spark_schema(pages.sparkSession, WORD))


def spark_schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def first_source(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first frame that has any for the key."""
    from functools import reduce

    tagged = reduce(DataFrame.unionByName, [f.withColumn("_p", F.lit(k)) for k, f in enumerate(frames)])
    best = tagged.groupBy(key).agg(F.min("_p").alias("_b"))
    return tagged.join(best, key).where("_p = _b").drop("_p", "_b")


def report_table(text: DataFrame) -> DataFrame:
    """Rows of the pipe tables of Markdown reports (column ``text``): method, wer, precision, recall; what isn't there is null."""
    line = text.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^[|\-:\s]+$"))
    c = line.select(F.transform(F.slice(F.split("line", r"\|"), 2, 4), strip).alias("c")).where("size(c) = 4")
    key = F.regexp_replace(F.regexp_replace(F.lower(F.get("c", F.lit(0))), r" \+ | \(", "_"), r"[^\w]", "_")
    out = c.select(F.regexp_replace(key, "^_+|_+$", "").alias("method"), percent(F.get("c", F.lit(1))).alias("wer"), percent(F.get("c", F.lit(2))).alias("precision"), percent(F.get("c", F.lit(3))).alias("recall"))
    return out.where("wer IS NOT NULL OR precision IS NOT NULL OR recall IS NOT NULL")


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """method, wer, precision, recall of a metrics file."""
    m = "struct<text_extraction:struct<wer:double>,table_extraction:struct<precision:double,recall:double>>"
    f = spark.read.schema(f"methods map<string,{m}>").option("multiLine", "true").json(path)
    return f.select(F.explode("methods").alias("method", "m")).select("method", F.col("m.text_extraction.wer").alias("wer"), F.col("m.table_extraction.precision").alias("precision"), F.col("m.table_extraction.recall").alias("recall"))


def settings(path: str, default: dict) -> dict:
    """A YAML file of the driver, over the defaults; the defaults alone if it isn't there. Needs the yaml package."""
    import os

    import yaml

    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return default | (yaml.safe_load(f) or {})


def report_methods(texts: DataFrame, by: list[str]) -> DataFrame:
    """by, method, wer, precision, recall of whole Markdown reports (column ``text``) by each method's patterns; a range counts as its middle."""
    from ..config.methods import REPORT_DEFAULTS, REPORT_PATTERNS, REPORT_SECTIONS

    def value(text, pattern, default):
        if pattern is None:
            return F.lit(default).cast("double")
        got = F.regexp_extract(text, pattern, 1)
        return F.when(got != "", F.aggregate(F.split(got, "-"), F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(F.split(got, "-")) / 100).otherwise(F.lit(default).cast("double"))

    rows = []
    for m, (wer, precision, recall) in REPORT_PATTERNS.items():
        whole = F.coalesce(F.col("text"), F.lit(""))
        part = F.regexp_extract(whole, REPORT_SECTIONS[m], 1) if m in REPORT_SECTIONS else whole
        d = REPORT_DEFAULTS[m]
        rows.append(F.struct(F.lit(m).alias("method"), value(whole, wer, d[0]).alias("wer"), value(part, precision, d[1]).alias("precision"), value(part, recall, d[2]).alias("recall")))
    return texts.select(*by, F.inline(F.array(*rows)))


def result_files(spark: SparkSession, root: str) -> DataFrame:
    """JSON files of each document's folder under a root: folder, file, text; for ``operators.comparison.result_figures``."""
    f = spark.read.option("ignoreCorruptFiles", "true").text(f"{root}/*/*.json", wholetext=True)
    path = F.split("_metadata.file_path", "/")
    return f.select(F.element_at(path, -2).alias("folder"), F.element_at(path, -1).alias("file"), F.col("value").alias("text"))


def lint(path: str) -> list[str]:
    """Problems of a YAML file of the driver: missing, empty, not readable. Without the yaml package, lines are checked for unpaired quotes alone."""
    import os

    if not os.path.exists(path):
        return [f"{path}: not found"]
    with open(path, encoding="utf-8") as f:
        text = f.read()
    lines = [(n, s.strip()) for n, s in enumerate(text.split("\n"), 1)]
    lines = [(n, s) for n, s in lines if s and not s.startswith("#")]
    if not lines:
        return [f"{path}: empty"]
    try:
        import yaml
    except ModuleNotFoundError:
        odd = lambda s: s.count('"') % 2 or s.count("'") % 2
        return [f"{path}:{n}: unpaired quote" for n, s in lines if ":" not in s and not s.startswith("-") and odd(s)]
    try:
        return [] if yaml.safe_load(text) is not None else [f"{path}: empty"]
    except yaml.YAMLError as e:
        return [f"{path}: {e}"]
