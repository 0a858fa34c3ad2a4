"""Packages, semantic index, tolerant replacement and the small reports."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import context, graph, metrics, rank, report, retrieve, semantic
from quarrystone.session import discard, shared_dir, staged


def walk(rows, budget, sections, skipping, most=64):
    """The same one row at a time."""
    out, used = set(), 0
    for section in sections:
        mine = sorted((r for r in rows if r[0] == section), key=lambda r: r[1])
        for _, ord_, cost in mine[:most] if section in skipping else mine:
            if cost is not None and used + cost <= budget:
                used += cost
                out.add((section, ord_, used))
            elif section not in skipping:
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sections_share_a_budget(spark, seed):
    rng = random.Random(seed)
    rows = [(g, s, i, rng.choice([1, 2, 5, 9, 30, None] if s != "b" else [3])) for g in ("x", "y") for s in ("a", "b", "c") for i in range(rng.randrange(0, 9))]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "g string, section string, ord long, cost long, used string")
    frame = frame.withColumnRenamed("used", "note")
    got = context.admit_in_sections(frame, "g", F.lit(40), ("a", "b", "c"), ("c",)).collect()
    for g in ("x", "y"):
        want = walk([(s, i, c) for gg, s, i, c in rows if gg == g], 40, ("a", "b", "c"), ("c",))
        assert {(r["section"], r["ord"], r["spent"]) for r in got if r["g"] == g} == want
    assert context.admit_in_sections(frame.limit(0), "g", F.lit(40), ("a", "b", "c"), ("c",)).count() == 0


def test_confidence(spark):
    rows = [(60, 3, 1, "explain_flow", False, "high"), (60, 3, 0, "explain_flow", False, "medium"), (41, 1, 0, "code_review", True, "high"), (41, 1, 0, "code_review", False, "medium"), (5, 1, 9, "bug_fix", False, "low"), (5, 2, 0, "bug_fix", False, "medium"), (None, 0, 0, "bug_fix", True, "low")]
    frame = spark.createDataFrame(rows, "s int, f int, y int, t string, d boolean, want string")
    assert frame.where(context.confidence(F.col("s"), F.col("f"), F.col("y"), F.col("t"), F.col("d")) != F.col("want")).count() == 0


def test_reasons_keep_their_order(spark):
    frame = spark.createDataFrame([("a", 2, 4, ["y", "x"]), ("a", 1, 10, ["x", "z"]), ("b", 1, 1, None)], "path string, ord int, score int, reasons array<string>")
    assert {r["path"]: (r["score"], r["reasons"]) for r in context.merged_reasons(frame).collect()} == {"a": (14, ["x", "z", "y"]), "b": (1, [])}


def replace(spark, text, find, by, everywhere=False):
    row = spark.createDataFrame([(text, find, by)], "t string, f string, b string").select(T.tolerant_replace(F.col("t"), F.col("f"), F.col("b"), everywhere).alias("w")).first()["w"]
    return tuple(row) if row else None


def test_tolerant_replacement(spark):
    assert replace(spark, "a $1 b $1", "$1", r"\$2") == (r"a \$2 b $1", 2, "exact")
    assert replace(spark, "a.b a.b axb", "a.b", "$0", True) == ("$0 $0 axb", 2, "exact")
    assert replace(spark, "x\r\ny\r\nz", "x\ny", "p\nq") == ("p\r\nq\r\nz", 1, "normalized-eol")
    assert replace(spark, "if (a) {\n    go();\n}\n", "  if (a) {\ngo();\n}", "stop()") == ("stop()\n", 1, "flexible-whitespace")
    assert replace(spark, "abc", "x", "y") is None and replace(spark, "abc", "", "y") is None and replace(spark, None, "a", "b") is None


def test_stable_json_and_numbers(spark):
    row = spark.range(1).select(T.stable_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("j"), T.short_number(F.lit(1530)).alias("k"), T.short_number(F.lit(2_000_000)).alias("m"), T.short_number(F.lit(7)).alias("n")).first()
    assert (row["j"], row["k"], row["m"], row["n"]) == ('{"a":2,"b":1}', "1.5K", "2.0M", "7")


def test_answers(spark):
    frame = spark.createDataFrame([("See SRC\\App.ts: limit is 20", "src/app.ts", ["LIMIT is \\d+"]), ("none", "src/app.ts", ["x"]), (None, None, None)], "a string, p string, f array<string>")
    place, facts = metrics.answers("a", "p", "f")
    assert [tuple(r) for r in frame.select(place, facts).collect()] == [(True, True), (False, False), (True, True)]


def index(spark, texts):
    files = spark.createDataFrame([(p, None, [], t) for p, t in texts.items()], "path string, module string, decorators array<string>, text string")
    symbols = spark.createDataFrame([("s1", "src/cache.ts", "openCache", "function", 1, 2, "function openCache()", True, None, [], [])], "id string, path string, name string, type string, start_line int, end_line int, signature string, exported boolean, parent_name string, decorators array<string>, tags array<string>")
    imports = spark.createDataFrame([("src/app.ts", 0, "./cache", ["openCache"], False, 1)], "path string, ord int, specifier string, imported_names array<string>, is_type_only boolean, line int")
    edges = spark.createDataFrame([("src/app.ts", "src/cache.ts")], "src string, dst string")
    return retrieve.Index(files, symbols, imports, edges)


TEXTS = {"src/app.ts": "import { openCache } from './cache';\nopenCache();\n", "src/cache.ts": "function openCache() {\n}\n", "src/zebra.ts": "// stripes of the zebra herd\nconst x = 1;\n", "src/cache.test.ts": "openCache();\n", "src/none.ts": None, "src/blank.ts": " \n"}


def test_semantic_index_embeds_only_what_changed(spark):
    known = index(spark, TEXTS)
    made = semantic.chunk_files(known.files, known.symbols, known.imports)
    kinds = {(r["path"], r["kind"]) for r in made.collect()}
    assert ("src/cache.ts", "symbol") in kinds and ("src/cache.ts", "window") not in kinds and ("src/app.ts", "window") in kinds and not any(p == "src/none.ts" for p, _ in kinds)
    first = semantic.refresh(made, None, "hash")
    assert (first.embedded, first.reused, first.pruned) == (first.chunks, 0, 0) and first.rows.count() == first.chunks
    again = semantic.refresh(made, first.rows, "hash")
    assert (again.embedded, again.reused, again.pruned) == (0, first.chunks, 0)
    changed = index(spark, TEXTS | {"src/zebra.ts": "// other\n", "src/app.ts": None})
    third = semantic.refresh(semantic.chunk_files(changed.files, changed.symbols, changed.imports), again.rows, "hash")
    assert third.embedded >= 1 and third.pruned >= 1 and third.chunks == third.embedded + third.reused == third.rows.count()
    assert semantic.refresh(made, first.rows, "another").embedded == first.chunks


def test_hybrid_retrieval_finds_by_meaning_what_keywords_miss(spark):
    known = index(spark, TEXTS)
    stored = semantic.refresh(semantic.chunk_files(known.files, known.symbols, known.imports), None, "hash").rows
    plain = {r["path"] for r in semantic.hybrid(known, None, "where are the stripes of the herd").files.collect()}
    mixed = {r["path"] for r in semantic.hybrid(known, stored, "where are the stripes of the herd").files.collect()}
    assert "src/zebra.ts" in mixed - plain
    asked = spark.createDataFrame([(0, "openCache cache")], "query int, text string")
    from quarrystone.operators import search

    near = semantic.hits(stored, search.hashed_embedding(asked, "query", "text"), k=3, least=0.1)
    shown = semantic.decorated(near, stored, known.files).collect()
    assert shown and all(r["snippet"] is None or r["snippet"].count("\n") < 12 for r in shown)


def test_context_package_of_a_task(spark):
    known = index(spark, TEXTS)
    found = retrieve.retrieve(known, "open the cache")
    full = context.context_package(known, found, "code_review", 5000, diff="+ x").collect()
    assert {r["section"] for r in full} == {"files", "symbols", "flow", "tests", "snippets"}
    assert any("git diff" in r["item"] for r in full) and any("function openCache() {" in r["item"] for r in full)
    small = context.context_package(known, found, "code_review", 60).collect()
    assert sum(r["cost"] for r in small) <= 60 and len(small) < len(full)
    text = context.markdown(context.context_package(known, found, "explain_flow", 5000), "open the cache")
    assert text.startswith("# open the cache") and "## Symbols" in text and "src/app.ts -> src/cache.ts" in text


def test_graph_views(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b")], "src string, dst string")
    degree = graph.degrees(nodes, edges)
    assert {r["path"] for r in report.with_hubs(degree, 1).where("hub").collect()} == {"b"}
    paths = lambda **k: {r["path"] for r in report.matching_nodes(nodes, edges, **k).collect()}
    assert paths(text="A", around=True) == {"a", "b"} and paths(connected=True) == {"a", "b", "c", "d"} and paths(text="f", connected=True) == set()
    rows = report.graph_json(degree, edges, nodes.withColumn("community", F.lit("a"))).collect()
    assert len(rows) == 9 and '{"src":"a","dst":"b"}' in {r["json"] for r in rows}
    assert {r["number"]: r["path"] for r in graph.numbered(nodes.withColumn("community", F.col("path"))).collect()} == dict(enumerate("abcdef"))
    assert report.questions(["a", "b", "c"], ["t"], ["C"]) and len(report.questions(["a", "b"], ["t"], ["C"], 3)) == 3


def test_related_tests_with_many_stems(spark):
    files = spark.createDataFrame([(f"t/f{i}.test.ts",) for i in range(0, 1500, 100)] + [("t/alone.test.ts",)], "path string")
    selected = spark.createDataFrame([(f"src/f{i}.ts",) for i in range(1300)], "path string")
    symbols = spark.createDataFrame([("t/alone.test.ts", "findMe")], "path string, name string")
    got = {r["path"] for r in report.related_tests(files, symbols, selected, ["findme"]).collect()}
    assert got >= {f"t/f{i}.test.ts" for i in range(0, 1300, 100)} | {"t/alone.test.ts"}


def test_discarded_tables_leave_nothing(spark, tmp_path):
    import os

    table = staged(spark.range(5), "gone")
    place = table._staged_at.replace("file:", "")
    assert os.path.isdir(place) and shared_dir(spark) in table._staged_at
    discard(table, spark.range(1))
    assert not os.path.exists(place)


def test_hints_by_similarity(spark):
    similar = spark.createDataFrame([("a", 0.5), ("a", 0.7)], "path string, similarity double")
    assert rank.Hints(active="b", similar=similar).table(spark).where("path = 'a'").first()["similarity"] == 0.7
