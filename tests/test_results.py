"""Comparisons, result files, reports and page layouts against brute force and on edge cases."""

import difflib
import json

from pyspark.sql import functions as F

from marlstone.functions import fuzzy
from marlstone.operators import comparison, layout, methods
from marlstone.plans import recon as plans
from marlstone.sinks import results
from marlstone.sources import files

FOUND = "doc_id string, method string, text_files int, chars long, csv_files int, box_folder boolean, seconds double, pages int"
WORDS = "doc_id string, page_number long, ord long, text string, x0 double, x1 double, top double, bottom double, fontname string, size double"


def test_comparison_report(spark):
    rows = comparison.method_rows(spark.createDataFrame([("d", "traditional", 2, 100, 1, None, 4.0, 2), ("d", "docling", 1, 100, 9, True, 0.0, 2), ("e", "layout_parser", 0, 0, 0, False, 0.0, 0)], FOUND))
    got = dict(comparison.comparison_report(rows, F.lit("now")).collect())
    assert got["d"].split("\n")[4:] == [
        "Methods Analyzed: traditional, docling", "", "Quality Ranking:", "  1. docling: 98.0/100", "  2. traditional: 35.0/100", "", "Speed Ranking (faster is better):", "  1. traditional: 2.00s per page", "",
        "Recommendations:", "  Overall Best: docling", "  Fastest: traditional", "  Most Accurate: docling",
    ]
    assert "Speed" not in got["e"] and "Fastest" not in got["e"]
    j = {k: json.loads(v) for k, v in comparison.comparison_json(rows).collect()}
    assert [m["method"] for m in j["d"]["extraction_metrics"]] == ["traditional", "docling"] and j["e"]["efficiency_ranking"] == []


def test_automap_rows_are_those_of_difflib(spark, sf):
    got = results.automap_rows(plans._labels(spark, sf)).collect()
    assert any(r["mapped_concept"] for r in got)
    for r in got:
        if r["mapped_concept"] is None:
            assert r["confidence_hint"] is None
        else:
            want = difflib.SequenceMatcher(None, fuzzy.normal(r["pdf_label"]), fuzzy.normal(r["mapped_concept"])).ratio()
            assert abs(r["confidence_hint"] - want) < 1e-9


def test_simple_page_layout(spark):
    words = [("d", 1, k, t, x, x + 20, y, y + 10, "f", 9.0) for k, (t, x, y) in enumerate([("TOTAL", 0.0, 0.0), ("ASSETS", 30.0, 4.0), ("ab", 0.0, 100.0), ("plain", 0.0, 200.0), ("words", 30.0, 215.0), ("right", 150.0, 300.0)])]
    w = spark.createDataFrame([*words, ("d", 1, 9, None, 0.0, 1.0, 0.0, 1.0, "f", 9.0)], WORDS)
    images = w.where("text = 'right'").select("doc_id", "page_number", "ord", "x0", "top", "x1", "bottom")
    got = {r["block_id"]: (r["block_type"], r["content"], r["confidence"]) for r in layout.simple_page_layout(w, images).collect()}
    assert got == {
        "page_001_text_000": ("title", "TOTAL ASSETS", 0.8), "page_001_text_002": ("text", "plain words", 0.8),
        "page_001_text_003": ("title", "right", 0.8), "page_001_figure_000": ("figure", "Image 1", 0.7),
    }
    assert layout.simple_page_layout(w.limit(0), images.limit(0)).count() == 0


def test_csv_and_json_results(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"", 1.5), (None, 2.0)], "label string, v double")
    results.csv_table(df, str(tmp_path / "c"))
    back = spark.read.option("header", "true").option("escape", '"').schema("label string, v double").csv(str(tmp_path / "c"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    none = spark.createDataFrame([], "method string, wer double, precision double, recall double")
    assert json.loads(results.metrics_json(none, methods.thresholds(spark)).first()["json"]) == {"methods": {}, "validation": {}}
    assert results.validation_text(methods.gate(none, methods.thresholds(spark))).first()["all_ok"] is True
    m = spark.createDataFrame([("docling", None, 0.5, 0.9)], none.schema)
    results.metrics_json(m, methods.thresholds(spark)).write.text(str(tmp_path / "m"))
    assert tuple(files.metrics_json(spark, str(tmp_path / "m")).first()) == ("docling", None, 0.5, 0.9)
    assert "  ❌ precision 0.500 < 0.600" in results.validation_text(methods.gate(m, methods.thresholds(spark))).first()["text"]
    assert set(results.method_configs()) == {"traditional", "layout_parser", "docling"}


def test_result_files_and_reports(spark, tmp_path):
    for f, name, text in (("a", "extraction_summary.json", '{"processing_time_seconds": 2, "total_pages": 3}'), ("b", "docling_extraction_results.json", "{"), ("c", "x.json", "{}")):
        (tmp_path / "out" / f).mkdir(parents=True)
        (tmp_path / "out" / f / name).write_text(text)
    got = {r["folder"]: (r["seconds"], r["pages"]) for r in comparison.result_figures(files.result_files(spark, str(tmp_path / "out"))).collect()}
    assert got == {"a": (2.0, 3), "b": (0.0, 0), "c": (0.0, 0)}
    empty = {r["method"]: (r["wer"], r["precision"], r["recall"]) for r in files.report_methods(spark.createDataFrame([("r", None)], "r string, text string"), ["r"]).collect()}
    assert empty == {"pdfplumber_tesseract": (None, 0.0, 0.0), "hybrid_camelot_pdfplumber": (None, 0.6, 0.6), "layout_parser": (None, 0.6, 0.6), "docling": (0.0, 0.708, 0.816)}


def test_lint(tmp_path):
    for text, problems in (("a: 1\nb:\n  - 2\n", 0), ("# nothing\n", 1), ("\"b\n", 1)):
        (tmp_path / "s.yaml").write_text(text)
        assert len(files.lint(str(tmp_path / "s.yaml"))) == problems, text
    assert len(files.lint(str(tmp_path / "none.yaml"))) == 1
