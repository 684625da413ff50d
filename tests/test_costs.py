"""What a review found to take too long: each text is worked on once, and cheap looks spare costly matches without changing a result."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from orrery.functions import structural, text
from orrery.operators import clones
from orrery.plans import catalog
from orrery.plans import fixtures as fx
from orrery.streaming import reindex as rx

TEXTS = ["", "if a++ += b === c !== d ** e <<>> 2if if_ éif\n", "  x\n\t y\r\n \n/* c */ \"s\" 'u' `v` // w\n# z\n", "export const f = async (a) => { try {} catch (e) {} }\n", '"""doc"""\ndef g(a): return 1.5 if a and a != 2 else 3.\n']


def test_what_a_match_must_have():
    want = {r"\bfunction\s+\w+\s*\(": "function", r"(?:const|let|var)\s+\w+\s*=\s*\(": "=", r"a|bc": "", r"\+\+": "++", r"(?m)//.*$": "//", r"\bmodule\.exports\s*=": "module.exports", r"ab?c+d": "a", r"\?.*:": "?", r"x{0,2}y": "y", r"[^ab]x*": ""}
    assert {p: text.literal(p) for p in want} == want


def test_counts_are_those_of_the_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    patterns = [*structural.FUNCTIONS, *structural.DECISIONS, *structural.SOURCES, *structural.OPERATORS]
    got = rows.select(*[text.count(F.col("t"), p) for p in patterns]).collect()
    plain = rows.select(*[F.regexp_count("t", F.lit(text.java(p))) for p in patterns]).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in plain]
    whole = rows.select(structural.decisions(F.col("t")), sum(F.regexp_count("t", F.lit(text.java(p))) for p in structural.DECISIONS)).collect()
    assert all(a == b for a, b in whole)
    signs = [p for p in structural.OPERATORS if not p.startswith(r"\b")]
    for p in signs:
        plain = re.sub(r"\\(.)", r"\1", p)
        assert all(a == b for a, b in rows.select(text.occurrences(F.col("t"), plain), F.regexp_count("t", F.lit(p))).collect())


def _plans(monkeypatch, module):
    """The optimised plans of the tables that a module writes, by name."""
    plans, write = {}, module.kept
    monkeypatch.setattr(module, "kept", lambda df, name="table": plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name))
    return plans


def test_texts_are_read_into_tokens_and_hashes_once(spark, monkeypatch):
    plans = _plans(monkeypatch, clones)
    clones.fingerprint_sets(spark.createDataFrame([("/a.js", "let a = 1;"), ("/b.js", "// only"), ("/c.js", "x y z w v u")], "file_path string, content string"))
    assert plans["tokens"].count(clones.TOKEN) == 1
    assert plans["fingerprints"].count("md5(cast(array_join(slice(") == 1 or plans["fingerprints"].count("conv(") == 1


def test_imports_are_read_once_for_debt(spark, sf_dir, monkeypatch):
    plans = _plans(monkeypatch, catalog)
    catalog.queries()["debt_of_file"](spark, sf_dir)
    assert "regexp_extract_all" in plans["imports"] and "regexp_extract_all" not in plans["edges"]
    assert "lexical" not in plans["points"]  # debt needs no terms


def test_points_at_one_place_have_tensions(spark, tmp_path):
    spark.createDataFrame([(1, [1.0] * 64, 0), (2, [1.0] * 64, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, 1, "edit", 5.0, datetime(2024, 1, 1))], "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert [r["contract_id"] for r in fx.tensions(spark, str(tmp_path)).collect()] == ["2:1"]


def test_a_batch_reads_each_text_once(spark, tmp_path, monkeypatch):
    rows = [(f"/f{i}.py", f"def run{i}(a):\n    return query(a)\n", "2024-01-01 00:00:00") for i in range(9)]
    files = lambda stamp: spark.createDataFrame(rows, "file_path string, content string, u string").select("file_path", F.concat("content", F.lit(stamp)).alias("content"), F.to_timestamp("u").alias("updated_at"))
    none = spark.createDataFrame([], "id string, caller_id string, callee_id string, baseline_distance double")
    store = rx.Store(spark, str(tmp_path), 4)
    store.apply(files(""), 0, none)
    plans = _plans(monkeypatch, rx)
    store.apply(files("\nclass Login: pass\n"), 1, none)
    assert plans["moved"].count("regexp_replace(content") + plans["moved"].count("sha2(cast(content") <= 2  # one pass over the texts, not one for each side of a join
    assert plans["moved"].count("Window [") == 1
    assert store.read("deltas").count() == 9 and store.points().count() == 9


def test_points_of_the_first_batch_are_those_contracts_are_between(spark, sf_dir, monkeypatch):
    made = []
    points = catalog.index.code_points
    monkeypatch.setattr(catalog.index, "code_points", lambda *a, **k: made.append(1) or points(*a, **k))
    catalog._batches(spark, sf_dir, 1)
    assert len(made) == 2  # a pass over the files for each version, and none for the contracts
