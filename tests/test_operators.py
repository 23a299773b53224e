"""Goldens and properties of the library's operators."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.backends import base
from marlstone.config.labels import LABELS, WEIGHTY
from marlstone.functions import fuzzy, text, values
from marlstone.operators import blocks, layout, mapping, methods, recon, tables
from marlstone.plans import recon as plans
from marlstone.plans import documents, layouts, registry, scalars  # noqa: F401  the modules register their queries
from marlstone.sinks import write
from marlstone.sources import facts, files
from marlstone.streaming import events

from .compare import duck_rows, spark_rows, tables_of


def one(spark, expr, schema=None, *row):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_fuzzy_scores_of_the_whole_dictionary(spark, tmp_path):
    """Each distinct label against all entries, by difflib; among them labels that are entries and one that is like none."""
    spark.range(1, 40).selectExpr("id AS p_partkey", "'x y z' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "int(id % 50) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    labels = {r["label"] for r in plans._labels(spark, str(tmp_path)).collect()}
    got = {(r["label"], r["pdf_key"]): (r["score"], r["ratio"]) for r in plans.fuzzy(spark, str(tmp_path)).collect()}
    assert set(got) == {(a, b) for a in labels for b, _ in LABELS}

    def brute(a, b):
        x, y = fuzzy.normal(a).lower(), fuzzy.normal(b).lower()
        p, q = set(x.split()), set(y.split())
        overlap = len(p & q) / max(len(p | q), 1) + 0.2 * len(p & q & set(WEIGHTY)) / len(WEIGHTY)
        score = 0.6 * overlap + 0.4 * difflib.SequenceMatcher(None, x, y).ratio()
        return 1.0 if x and x == y else score if p and q else 0.0

    for (a, b), (score, ratio) in got.items():
        assert score == pytest.approx(brute(a, b), abs=1e-6)
        assert ratio == pytest.approx(difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), abs=1e-6)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@given(st.text("abé🙂", max_size=60), st.text("abé🙂", max_size=60))
@settings(max_examples=300, deadline=None)
def test_edit_distance(a, b):
    assert fuzzy.edit_distance(a, b) == brute_distance(a, b)
    for x, y in ((a * 5, a * 4 + b), ("z" + a + "y" * 80, a + "y" * 79 + b)):
        assert fuzzy.edit_distance(x, y) == brute_distance(x, y)


def test_edit_distance_looks_where_the_texts_can_meet(monkeypatch):
    """126 edits in 12,000 characters: far fewer runs of equal characters are followed than there are pairs of diagonal and edits."""
    a = "".join(chr(97 + k * k % 23) + chr(97 + k % 25) for k in range(5950)) + "rn" * 50
    b = a[:5000].replace("ab", "c", 50) + a[5000:-100] + "m" * 50
    calls, same = [], fuzzy._same
    monkeypatch.setattr(fuzzy, "_same", lambda *x: calls.append(x) or same(*x))
    got = fuzzy.edit_distance(a, b)
    assert got == 2 * a[:5000].count("ab") + 2 * 50 == 126
    assert len(calls) < got * got / 10


def test_text_error_rate_of_whole_texts(spark, tmp_path):
    late = "plain text " * 40 + "corner barn\nurn"
    rows = [(0, late), (1, late), (2, "née 🙂 born\n" * 100), (3, ""), (4, None), (6, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["cer"] for r in registry.QUERIES["a31_text_error_rate"](spark, str(tmp_path)).collect()}
    for k, t in rows:
        read = t and t.replace("rn", "m").replace("\n", " ") + (" extra" if k % 3 == 0 else "")
        assert got[k] == (pytest.approx(brute_distance(t, read) / len(t), abs=1e-6) if t else None)
    assert got[1] > 0  # all its errors come after 200 characters


def test_unicode_white_space(spark):
    assert one(spark, text.word_count(F.lit("a b  c\n"))) == 3
    assert one(spark, text.strip(F.lit("  a\t"))) == "a"


@pytest.mark.parametrize("raw, want", [("1. Net  revenue (a), $", "Net revenue"), ("R&D %", "RandD"), ("Shareholders' equity", "Shareholders equity")])
def test_normalize_label_matches_python(spark, raw, want):
    assert one(spark, text.normalize_label(F.lit(raw))) == want == fuzzy.normal(raw)


@pytest.mark.parametrize("raw, want", [("$1,234", 1234.0), ("(5.5)", -5.5), ("3 million", 3e6), ("8 months", 8e6), ("2B", 2e9), ("-", None), ("x", None)])
def test_money(spark, raw, want):
    assert one(spark, values.money(F.lit(raw))) == want


def test_money_strict_units(spark):
    assert one(spark, values.money(F.lit("8 months"), strict_units=True)) == 8.0


@pytest.mark.parametrize("a, b, factor, reason", [
    (100.0, 100.0, 1.0, "no_scaling"), (33.818, 32972.0, 1e3, "thousands_to_actual"), (60922.0, 60922e6, 1e6, "millions_to_actual"),
    (5e9, 5.0, 0.000000001, "actual_to_billions"), (0.0, 5.0, 1.0, "zero_value"), (1.0, 77.0, 1.0, "no_scaling_detected"),
])
def test_scale(spark, a, b, factor, reason):
    s = one(spark, values.scale(F.lit(a), F.lit(b)))
    assert (s["factor"], s["reason"]) == (factor, reason)


def test_compare_tiers(spark):
    v = lambda a, b: one(spark, values.compare(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert v(100, 100)["reason"] == "exact_match"
    assert v(100.3, 100)["reason"] == "rounding_match"
    assert v(100.8, 100)["reason"] == "tolerance_match"
    assert (v(110, 100)["reason"], v(110, 100)["match"]) == ("loose_match", False)
    assert v(33.818, 32972)["match"]  # a loose match counts where a scale was found
    assert v(None, 1)["reason"] == "missing_value"
    assert v(1e-11, 1)["reason"] == "magnitude_mismatch"


def test_simple_compare(spark):
    v = lambda a, b: one(spark, values.simple_compare(F.lit(a), F.lit(b)))
    assert v(1.0, 1000.0)["cause"] == "scaling_mismatch" and v(1.0, 1000.0)["scale"] == 1000.0
    assert v(5.0, -5.0)["cause"] == "sign_mismatch" and not v(5.0, -5.0)["match"]


def test_fuzzy_goldens():
    assert fuzzy.score("Net revenue", "net  revenue (x)") == 1.0
    assert fuzzy.score("", "a") == 0.0
    assert round(fuzzy.score("total revenue", "net revenue"), 6) == round(0.6 * (1 / 3 + 0.2 / 12) + 0.4 * (2 * 9 / 24), 6)  # blocks " revenue" and "t"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8))
def test_wer_of_itself_is_zero(words):
    import pandas as pd

    s = pd.Series([" ".join(words)])
    assert fuzzy._wer.func(s, s)[0] == 0.0
    assert fuzzy._wer.func(s, pd.Series([""]))[0] == 1.0


def test_mapping(spark):
    rows = [("Net revenue", "income_statement"), ("Total assets (x)", "balance_sheet"), ("gross profit of all", "income_statement"), ("zzz", "cash_flow"), ("% of net revenue", "income_statement")]
    labels = spark.createDataFrame(rows, "label string, statement_type string")
    got = {r["label"]: (r["concept"], r["mapped"]) for r in mapping.map_or_keep(labels).collect()}
    assert got["Net revenue"] == ("Revenue", True) and got["Total assets (x)"] == ("Total Assets", True)
    assert got["gross profit of all"] == ("Gross Profit", True) and got["zzz"] == ("zzz", False)


def test_series_reconciliation(spark):
    pdf = spark.createDataFrame([("i", "Revenue", "2024-01-28", 100.0), ("i", "Revenue", "year ended.1", 90.0), ("i", "Other", "2024-01-28", 1.0), ("i", "Net Income", "gaming", 3.0)], "statement_type string, concept string, period string, value double")
    xbrl = spark.createDataFrame([("Revenue", "2024-01-28", 100.0), ("Revenue", "2023-01-29", 90e3), ("Net Income", "2024-01-28", 3.0), ("Assets", "2024-01-28", 1.0)], "concept string, period string, value double")
    r = {(x["concept"], x["period"]): x for x in recon.reconcile(pdf, xbrl, fuzzy=False).collect()}
    assert r["Revenue", "2024-01-28"]["status"] == "match" and r["Revenue", "year ended.1"]["scale_factor"] == 1000.0
    assert r["Net Income", "gaming"]["reason"] == "no_period" and r["Net Income", "gaming"]["status"] == "skipped"
    assert r["Other", None]["status"] == "pdf_only" and r["Assets", None]["status"] == "xbrl_only"


def test_fuzzy_periods(spark):
    pairs = spark.createDataFrame([("c", "FY 2023-01", "2023-01-29", 2), ("c", "FY 2023-01", "2024-01-28", 1), ("c", "???", "2024-01-28", 1)], "concept string, period string, xbrl_period string, xord int")
    r = {x["period"]: (x["xbrl_period"], x["alignment_kind"]) for x in recon.align_periods(pairs, ["concept"]).collect()}
    assert r["FY 2023-01"] == ("2023-01-29", "fuzzy") and r["???"] == ("2024-01-28", "default")


def test_consolidation_picks_a_member(spark, sf):
    from marlstone.plans.documents import _blocks

    b = _blocks(spark, sf)
    c = blocks.consolidate(b)
    assert c.join(b.select("doc_id", F.col("content.text").alias("t")), (c.doc_id == b.doc_id) & (F.col("content.text") == F.col("t")), "left_anti").count() == 0
    assert c.columns == b.columns


def test_anchored_blocks(spark):
    rows = [("d", 1, k, "w", 0.0, 1.0, y, y + 5.0, "f", 9.0) for k, y in enumerate([0.0, 4.0, 20.0, 23.0, 60.0])]
    from marlstone.schemas import WORD

    got = layout.anchored_blocks(spark.createDataFrame(rows, WORD)).orderBy("ord").select("block").collect()
    assert [r[0] for r in got] == [0, 0, 0, 0, 1]


def test_ragged_rows(spark):
    rows = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["b", "", "c"])], "table_id int, row_idx int, cells array<string>")
    assert sorted(tuple(r["cells"]) for r in tables.square(rows).collect()) == [("a", "Col_1", "Col_2"), ("b", "", "c")]


@pytest.mark.parametrize("name", ["p03_valid_tables", "a09_table_quality", "p06_financial_tables", "p21_min_text"])
def test_tasks_grow_with_the_table(spark, sf, name, monkeypatch):
    """A query of words or cells takes so many more tasks as its table has more rows, after one shuffle, with the results of its SQL."""
    monkeypatch.setattr(registry, "SHARE", 150)
    df = registry.QUERIES[name](spark, sf)
    assert df.rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 150)
    assert spark_rows(df) == duck_rows(registry.ORACLE[name], tables_of(sf))


def test_shape_counts_no_nulls(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, None), (1, 1, 0, ""), (1, 1, 0, "b"), (2, None, 0, "a"), (None, 5, None, "a")], "table_id int, row_idx long, col_idx int, value string")
    assert {tuple(r) for r in tables.shape(cells).collect()} == {(1, 2, 2), (2, 0, 1), (None, 1, 0)}


def test_facts_csv_and_tables(spark, tmp_path):
    (tmp_path / "facts.csv").write_text('a,b,c,d,,2024-01-28,2023-01-29\n1,1,1,1,Total revenue,"1,000",2\n1,1,1,1,Revenue,7,\n')
    f = facts.read_csv(spark, str(tmp_path / "facts.csv"))
    assert f.where("period = '2024-01-28'").agg(F.sum("value")).first()[0] == 1007.0
    got = {(r["metric"], r["period"]): r["value"] for r in facts.pick_metrics(f).collect()}
    assert got[("Revenue", "2024-01-28")] == 7.0 and got[("Revenue", "2023-01-29")] == 2.0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text('h,"a ""b"", c"\n1,2\n')
    cells = {(r["row_idx"], r["col_idx"]): r["value"] for r in files.table_files(spark, str(tmp_path / "t")).collect()}
    assert cells[(0, 1)] == 'a "b", c' and cells[(1, 0)] == "1"


def test_round_trips(spark, sf, tmp_path):
    from marlstone.plans.documents import _blocks

    b = _blocks(spark, sf)
    write.jsonl(b, str(tmp_path / "b"))
    assert files.blocks(spark, str(tmp_path / "b")).count() == b.count()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "page_003.txt").write_text("x\ny")
    p = files.page_texts(spark, str(tmp_path / "p")).first()
    assert (p["page_number"], p["text"]) == (3, "x\ny")
    assert set(write.schemas()) >= {"block", "word"}


def test_report_scrape(spark):
    t = "| Method | WER | P | R |\n|---|---|---|---|\n| Hybrid + X (a) | 0-10% | ~60% | 45%* |\n"
    r = files.report_table(spark.createDataFrame([(t,)], "text string")).first()
    assert (r["wer"], r["precision"], r["recall"]) == (0.05, 0.6, 0.45)


def test_gate_fails(spark):
    m = spark.createDataFrame([("docling", 0.2, 0.5, 0.9), ("new", 9.0, 0.0, 0.0)], "method string, wer double, precision double, recall double")
    r = {x["method"]: x for x in methods.gate(m, methods.thresholds(spark)).collect()}
    assert len(r["docling"]["failures"]) == 2 and r["new"]["passed"]


def test_backends(spark):
    assert base.extract("html", spark.createDataFrame([(1, "<p>a&amp;b</p><script>x</script>")], "doc_id int, html string")).first()["text"] == "a&b"
    with pytest.raises(ModuleNotFoundError):
        base.extract("ocr", spark.range(1))


def test_stream_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(str(src))
    stream = events.windowed(spark.readStream.schema(table.schema).parquet(str(src)), late="1000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == table.count()
    assert spark.table("w").count() == events.windowed(table).count()


def test_sinks(spark, sf, tmp_path):
    from marlstone.plans.documents import _blocks, _cells
    from marlstone.plans.recon import _recon

    b, r = _blocks(spark, sf), _recon(spark, sf)
    assert write.recon_csv(r, str(tmp_path / "r")) == sorted(x[0] for x in r.select("status").distinct().collect())
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == r.count()
    assert write.manifest(r, 3, 0.01, 0.005).first()["tables"] == 3
    write.boxes_json(b, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == b.count()
    some = _cells(spark, sf).where("table_id < 20")
    write.tables_csv(some, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == some.select("table_id", "row_idx").distinct().count()
    docs = b.select("doc_id").distinct().withColumn("processing_status", F.lit("success"))
    write.registry(docs, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).count() == docs.count()
    assert write.plain(b).count() == docs.count()


def test_scans(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"x")
    d = files.documents(spark, str(tmp_path)).drop("content").collect()
    assert [r["doc_name"] for r in d] == ["a.pdf"] and d[0]["file_size_bytes"] == 4
    for f in ("f1", "f2"):
        (tmp_path / "roots" / f / "tables").mkdir(parents=True)
        (tmp_path / "roots" / f / "tables" / "t.csv").write_text("a,b\n1,2\n")
    got = files.filings(spark, str(tmp_path / "roots"))
    assert got.count() == 8 and sorted(r[0] for r in got.select("doc_id").distinct().collect()) == ["f1", "f2"]
    (tmp_path / "w.json").write_text('[{"doc_id": "d", "page_number": 1, "words": [{"text": "a", "x0": 1, "x1": 2, "top": 3, "bottom": 4}]}]')
    assert files.words(spark, str(tmp_path / "w.json")).first()["x1"] == 2.0
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, files.first_source([one, two], "k").collect())) == [("a", 1), ("b", 3)]
    (tmp_path / "m.json").write_text('{"methods": {"x": {"text_extraction": {"wer": 0.1}, "table_extraction": {"precision": 0.5, "recall": 0.4}}}}')
    assert tuple(files.metrics_json(spark, str(tmp_path / "m.json")).first()) == ("x", 0.1, 0.5, 0.4)
    assert files.settings(str(tmp_path / "none.yaml"), {"a": 1}) == {"a": 1}


def test_stream_sink(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.limit(50).write.parquet(str(tmp_path / "in"))
    q = events.to_table(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
