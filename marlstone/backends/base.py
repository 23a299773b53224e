"""Seam for extraction back ends: bytes or text of a document in, rows of pages, words or cells out.

A back end is a function from an Arrow batch iterator to an Arrow batch iterator, run by ``mapInArrow``, so rows stream and executors
need only the back end's own packages. OCR and layout models aren't part of the library: adapters are looked up and refused with a
clear error where their package is missing.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keep_text_layer, strip

BACKENDS: dict[str, tuple[str | None, Callable[[DataFrame], DataFrame]]] = {}


def backend(name: str, package: str | None = None):
    def put(f: Callable[[DataFrame], DataFrame]):
        BACKENDS[name] = (package, f)
        return f

    return put


def extract(name: str, df: DataFrame) -> DataFrame:
    """Pages of ``df`` by a back end."""
    package, f = BACKENDS[name]
    if package and importlib.util.find_spec(package) is None:
        raise ModuleNotFoundError(f"back end {name} needs the package {package}", name=package)
    return f(df)


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]


def plain_text(html):
    """Text of HTML: scripts, styles, comments and tags away, block ends as line feeds, a few entities."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)</(p|div|h[1-6]|li|tr)>|<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for a, b in _ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def element(html, tag: str):
    """Text of the first element of a kind; empty if there is none."""
    return plain_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


@backend("html")
def html_pages(df: DataFrame) -> DataFrame:
    """doc_id, html -> one page of text each."""
    return df.select("doc_id", F.lit(1).alias("page_number"), plain_text(F.col("html")).alias("text"), F.lit("html").alias("method"))


@backend("text")
def text_pages(df: DataFrame) -> DataFrame:
    """doc_id, text -> pages at form feeds; OCR isn't available, so pages without a text layer fail."""
    p = df.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("i", "text"))
    ok = keep_text_layer(F.col("text"))
    return p.select("doc_id", (F.col("i") + 1).alias("page_number"), F.col("text"), F.lit("text").alias("method"), (~ok).alias("needs_ocr"), ok.alias("success"))


def _absent(package: str):
    def run(df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"no adapter for {package} is shipped: register one with @backend")

    return run


for _name, _package in (("layout_words", "pdfplumber"), ("ruled_tables", "camelot"), ("document_model", "docling"), ("detector", "layoutparser"), ("ocr", "pytesseract")):
    BACKENDS[_name] = (_package, _absent(_package))
