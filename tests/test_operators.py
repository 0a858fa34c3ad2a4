import random

from pyspark.sql import functions as F

from quarrystone.operators import budget, chunks, classify, extract, metrics, rank, report, search


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_windows_stop_at_the_first_that_reaches_the_end(spark):
    frame = spark.createDataFrame([("a", "\n".join(f"l{i}" for i in range(130))), ("b", " \n "), ("c", None), ("d", ""), ("e", "x")], "path string, text string")
    assert rows(chunks.line_windows(frame), "path", "start_line", "end_line") == [("a", 1, 60), ("a", 51, 110), ("a", 101, 130), ("e", 1, 1)]
    assert chunks.line_windows(frame.limit(0)).count() == 0


def test_symbol_chunks_leave_out_members_of_indexed_parents(spark):
    files = spark.createDataFrame([("a.ts", "class A {\n m() {}\n}\nfn()")], "path string, text string")
    symbols = spark.createDataFrame([("1", "a.ts", "A", "class", 1, 3, None), ("2", "a.ts", "m", "method", 2, 2, "A"), ("3", "a.ts", "fn", "function", 4, 99, "Gone"), ("3", "a.ts", "fn", "function", 4, 99, "Gone")], "id string, path string, name string, type string, start_line int, end_line int, parent_name string")
    got = chunks.symbol_chunks(files, symbols)
    assert rows(got, "id", "start_line", "end_line") == [("a.ts#symbol:A@1", 1, 3), ("a.ts#symbol:Gone.fn@4", 4, 4)]
    assert [len(r["text"]) for r in chunks.symbol_chunks(files, symbols, most_chars=3).where("symbol = 'A'").collect()] == [len("// a.ts › class A\ncla" + chunks.CUT_MARK)]


def test_upsert_is_idempotent_and_prune_keeps(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    new, gone = spark.createDataFrame([("b", 2), ("d", 2)], "id string, v int"), spark.createDataFrame([("c",)], "id string")
    once = chunks.upsert(old, new, "id", gone)
    assert rows(once, "id", "v") == [("a", 1), ("b", 2), ("d", 2)] == rows(chunks.upsert(once, new, "id", gone), "id", "v")
    assert rows(chunks.prune(once, new, "id"), "id") == [("b",), ("d",)]
    stale = chunks.stale_chunks(spark.createDataFrame([("a", "x"), ("b", "y"), ("n", "z")], "id string, hash string"), spark.createDataFrame([("a", "x"), ("b", "q")], "id string, hash string"))
    assert rows(stale, "id") == [("b",), ("n",)]


def test_budgets(spark):
    frame = spark.createDataFrame([("g", i, c) for i, c in enumerate([3, 9, 4, 1, 2])] + [("h", 0, 50), ("h", 1, 1), ("h", 2, None)], "g string, i int, cost long")
    assert rows(budget.admit_until_full(frame, "cost", F.lit(8), ["g"], [F.col("i")]), "g", "i") == [("g", 0)]
    assert rows(budget.admit_what_fits(frame, "cost", 8, "g", ["i"]), "g", "i", "spent") == [("g", 0, 3), ("g", 2, 7), ("g", 3, 8), ("h", 1, 1)]


def test_fusion_is_exact_and_order_free(spark):
    lists = [["a", "b", "c"], ["b", "a"], ["c", "d"]]
    frames = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(items)], "path string, rank int") for items in lists]
    got = {r["path"]: r["score"] for r in rank.fuse(frames).collect()}
    assert abs(got["a"] - (1 / 61 + 1 / 62)) < 1e-12 and abs(got["c"] - (1 / 63 + 1 / 61)) < 1e-12
    assert got == {r["path"]: r["score"] for r in rank.fuse(frames[::-1]).collect()}


def test_ranks_over_partitions(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(f"p{v:04}", v) for v in values], "path string, v int").repartition(5)
    got = {r["path"]: r["rank"] for r in rank.ranked(frame, [F.desc("v"), F.col("path")]).collect()}
    assert got == {f"p{v:04}": 500 - v for v in values}


def test_scores_hints_and_expansion(spark):
    files = spark.createDataFrame([("src/user.service.ts", ["Injectable"]), ("src/x.ts", []), ("src/user.spec.ts", None)], "path string, decorators array<string>")
    imports = spark.createDataFrame([("src/x.ts", "./user.service", []), ("src/x.ts", None, None)], "path string, specifier string, imported_names array<string>")
    symbols = spark.createDataFrame([("src/user.service.ts", "UserService")], "path string, name string")
    scores = rank.score_files(files, imports, symbols, ["user", "service"])
    assert rows(scores, "path", "score") == [("src/user.service.ts", 32), ("src/user.spec.ts", 10), ("src/x.ts", 8)]
    hints = rank.Hints(active="src/x.ts", opened=["src/x.ts", "gone"], similar=spark.createDataFrame([("src/user.spec.ts", 0.9)], "path string, similarity double")).table(spark)
    assert rows(rank.boost_by_hints(scores, hints), "path", "score") == [("src/user.service.ts", 32), ("src/user.spec.ts", 46), ("src/x.ts", 45)]
    edges = spark.createDataFrame([("src/x.ts", "src/user.service.ts"), ("far", "src/x.ts")], "src string, dst string")
    assert rows(rank.expand(scores, edges), "path", "score") == [("far", 5), ("src/user.service.ts", 32), ("src/user.spec.ts", 10), ("src/x.ts", 29)]
    boosted = rank.boost_by_neighbours(scores, edges, scores.where("score > 20"), True)
    assert rows(boosted, "path", "score") == [("src/user.service.ts", 32), ("src/user.spec.ts", 55), ("src/x.ts", 15)]


def test_top_k_against_numpy(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, [0.0] * 8), (901, None), (902, [1.0] * 3), (903, [])]
    frame = spark.createDataFrame(data, "id long, vector array<float>").repartition(4)
    queries = frame.where("id % 50 = 0").withColumnRenamed("id", "q")
    got = rows(search.top_k(queries, frame, "q", "id", k=4, least=0.2, block=3).select("q", "id"), "q", "id")
    import numpy as np

    x = np.array([v for _, v in data[:300]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q in range(0, 300, 50):
        near = x @ x[q]
        want += [(q, int(i)) for i in sorted(np.flatnonzero(near >= 0.2), key=lambda i: (-near[i], i))[:4]]
    assert got == sorted(want)
    assert rows(search.vector_stats(frame.withColumn("path", F.lit("p"))), "vectors", "paths", "dims") == [(304, 1, 8)]


def test_embedding_is_stable(spark):
    frame = spark.createDataFrame([(1, "the cache"), (2, "The CACHE"), (3, None)], "id long, text string")
    got = {r["id"]: r["vector"] for r in search.hashed_embedding(frame, "id", "text", 16).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] == [0.0] * 16


def test_metrics(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("b", "x", 4), ("c", "y", None)], "q string, kind string, rank int")
    got = {r["kind"]: (r["queries"], r["hit_at_1"], r["hit_at_5"], r["mrr"]) for r in metrics.retrieval_metrics(hits, "kind").collect()}
    assert got == {None: (3, 0.333, 0.667, 0.417), "x": (2, 0.5, 1.0, 0.625), "y": (1, 0.0, 0.0, 0.0)}
    texts = spark.createDataFrame([("a", "cache cache parser"), ("b", "CACHE" * 20), ("c", None)], "id string, text string")
    assert rows(metrics.grep_scores(texts, "id", "text", ["cache", "parser"]), "id", "score") == [("a", 23), ("b", 20)]
    assert rows(metrics.grep_matches(texts, "id", "text", ["cache", "parser"]), "id") == [("a",)]
    assert metrics.grep_terms("How does the cache work after the parser? cache") == ["cache", "work", "parser"]


def test_savings_ties_and_nothing_sent(spark):
    schema = "call_id long, outcome string, prompt_tokens long, prompt_bytes long, baseline_tokens long, baseline_bytes long"
    calls = spark.createDataFrame([(1, "sent", 10, 99, 30, None), (2, "sent", None, 41, None, 121), (3, "sent", 10, None, 30, None), (4, "blocked", 1, 1, 900, 1), (5, "sent", 5, 5, None, None)], schema)
    r = metrics.savings(calls).first()
    assert (r["calls"], r["actual_tokens"], r["baseline_tokens"], r["saved_tokens"], r["best_call"], r["worst_call"], r["saved_percent"], r["average_saved"], r["any_measured"]) == (3, 31, 91, 60, 1, 1, 65.9, 20, True)
    r = metrics.savings(calls.where("call_id = 4")).first()
    assert (r["calls"], r["saved_tokens"], r["best_call"], r["saved_percent"], r["average_saved"]) == (0, 0, None, 0.0, 0)


def test_task_types(spark):
    cases = {"Review the diff": "code_review", "What files are affected?": "impact_analysis", "add tests": "test_generation", "how does it flow": "explain_flow", "fix it": "bug_fix", "a prüfen": "code_review", "contest": "feature_change"}
    cases["a prüfen"] = "code_review"  # words are bounded by ASCII letters only
    frame = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r["got"] == r["want"] for r in frame.select("want", classify.task_type(F.col("t")).alias("got")).collect())


SCRIPT = """import type { A } from './a';
import Base, { useX as useY, B } from "../b";
export * from './c';

@Controller('users')
export class UserController extends Base {
  constructor(private x: A) {}

  @Get(':id')
  async find(id: string): Promise<A> {
    if (id) { return this.x; }
  }
}

export interface Shape { a: number }
export function useThing() { return '} not a brace'; }
export const Card = (p: A) => { return <div>{p}</div>; };
function plain() {
  return 1;
}
"""


def test_script_extraction():
    symbols, imports = extract.extract(SCRIPT, "src/u.tsx")
    got = {(s["name"], s["type"], s["start_line"], s["end_line"], s["exported"], s["parent_name"]) for s in symbols}
    assert got == {
        ("UserController", "controller", 6, 13, True, None), ("find", "routeHandler", 10, 12, False, "UserController"), ("Shape", "interface", 15, 15, True, None),
        ("useThing", "hook", 16, 16, True, None), ("Card", "component", 17, 17, True, None), ("plain", "function", 18, 20, False, None),
    }
    assert [(i["specifier"], i["imported_names"], i["is_type_only"], i["line"]) for i in imports] == [("./a", ["A"], True, 1), ("../b", ["Base", "useY", "B"], False, 2), ("./c", [], False, 3)]


def test_other_languages():
    symbols, imports = extract.extract("import os\nfrom a.b import c\n\nclass A:\n    @staticmethod\n    def m(self):\n        pass\n\ndef _f():\n    pass\n", "x.py")
    assert [(s["name"], s["type"], s["parent_name"], s["exported"]) for s in symbols] == [("A", "class", None, True), ("m", "method", "A", True), ("_f", "function", None, True)]
    assert [i["specifier"] for i in imports] == ["os", "a.b"]
    symbols, imports = extract.extract('import (\n  "fmt"\n  x "a/b"\n)\nfunc (r *R) Do() {}\ntype R struct {}\n', "x.go")
    assert {(s["name"], s["type"], s["parent_name"], s["exported"]) for s in symbols} == {("Do", "method", "R", True), ("R", "class", None, True)} and [i["specifier"] for i in imports] == ["fmt", "a/b"]
    assert extract.extract("class Broken(:\n", "x.py")[0][0]["name"] == "Broken"
    assert extract.extract("", "noext") == ([], [])


def found(text, path):
    symbols, imports = extract.extract(text, path)
    return [(s["name"], s["type"], s["start_line"], s["end_line"], s["parent_name"]) for s in symbols], [i["specifier"] for i in imports]


def test_headers_without_a_word():
    text = 'package a.b;\nimport static c.D.*;\n/* class No {}\n*/\npublic class Foo<T> extends Bar {\n  int x = f(3);\n  Foo(int a) { call(a); }\n  public Map<String, List<T>> go(int a,\n      String b) throws E {\n    return new Q(2).then("class { ");\n  }\n  abstract int sig(int a);\n}\n'
    assert found(text, "a.java") == ([("Foo", "class", 5, 13, None), ("Foo", "method", 7, 7, "Foo"), ("go", "method", 8, 11, "Foo"), ("sig", "method", 12, 12, "Foo")], ["c.D"])
    assert found("using System.Text;\nnamespace X {\n  class C {\n    public int P { get; set; }\n    Task<int> Run(int a) => 3;\n  }\n}\n", "a.cs") == ([("C", "class", 3, 6, None), ("Run", "method", 5, 5, "C")], ["System.Text"])


def test_words_of_each_language():
    symbols, imports = extract.extract("use std::io::{self, Read};\npub struct A { x: u8 }\nimpl<T> Show for A {\n  pub fn new() -> Self { A { x: 1 } }\n  fn own(&self) {}\n}\n", "a.rs")
    assert [(s["name"], s["type"], s["parent_name"], s["exported"]) for s in symbols] == [("A", "class", None, True), ("new", "method", "A", True), ("own", "method", "A", False)] and imports[0]["specifier"] == "std::io"
    assert found("class K(val x: Int) {\n  fun go() = 3\n}\n", "a.kt")[0] == [("K", "class", 1, 3, None), ("go", "method", 2, 2, "K")]
    assert found("foo() {\n echo x\n}\nfunction bar {\n}\n", "a.sh")[0] == [("foo", "function", 1, 3, None), ("bar", "function", 4, 5, None)]
    assert found('module "net" {\n  source = "./net"\n}\n', "a.tf") == ([("net", "function", 1, 1, None)], ["./net"])
    assert found("require 'a/b'\nclass K\n  def ok?\n  end\nend\n", "a.rb") == ([("K", "class", 2, 2, None), ("ok?", "function", 3, 3, None)], ["a/b"])
    assert found("<?php\nuse X\\Y;\nrequire_once('lib/a.php');\n", "a.php")[1] == ["X/Y", "lib/a.php"]
    assert found("#include <a.h>\n#include \"b/c.h\"\n", "a.c")[1] == ["a.h", "b/c.h"]
    assert found("", "a.java") == ([], []) and found("}}}{{{", "a.java") == ([], [])


def test_signatures_end_at_the_body():
    text = "export function f(a: { b: number }, c: Array<{ d: string }>): { e: number } {\n  return g(a);\n}\nclass A extends React.Component<P> {\n  go(x: { y: number }): void {\n  }\n}\n"
    got = {s["name"]: (s["signature"], s["type"], s["end_line"]) for s in extract.extract(text, "a.ts")[0]}
    assert got["f"] == ("export function f(a: { b: number }, c: Array<{ d: string }>): { e: number }", "function", 3)
    assert got["A"] == ("class A extends React.Component<P>", "component", 7) and got["go"] == ("go(x: { y: number }): void", "method", 6)


def test_index_rows(spark):
    files = spark.createDataFrame([("a.ts", SCRIPT, "clash"), ("b.java", "package x.y;\nclass Q {}", "clash"), ("c.ts", None, "c"), (None, "x", "c")], "path string, text string, symbols string")
    indexed = extract.index_files(files)
    assert {r["path"]: r["module"] for r in indexed.collect()} == {"a.ts": None, "b.java": "x.y", "c.ts": None}
    assert extract.symbols_of(indexed).where("path = 'b.java'").first()["id"] == "b.java:Q:2:class"
    assert extract.index_files(files.limit(0)).count() == 0


def test_surprises_and_tests(spark):
    files = spark.createDataFrame([("src/api/a.ts",), ("src/ui/panel.ts",), ("src/api/panel.ts",), ("src/api/a.spec.ts",)], "path string")
    imports = spark.createDataFrame([("src/api/a.ts", "../ui/panel"), ("src/api/a.ts", "panel"), ("src/api/a.ts", None)], "path string, specifier string")
    labels = files.withColumn("label", F.element_at(F.split("path", "/"), 2))
    assert rows(report.surprising(imports, files, labels), "src", "dst") == [("src/api/a.ts", "src/ui/panel.ts")]
    symbols = spark.createDataFrame([("src/api/a.spec.ts", "x")], "path string, name string")
    assert rows(report.related_tests(files, symbols, files.where("path = 'src/api/a.ts'"), []), "path") == [("src/api/a.spec.ts",)]


def test_decorators_count_however_long_their_arguments_are():
    parts = ",\n".join(f"    Part{i}.of((x) => f(g(x), ')'))" for i in range(60))
    text = f"@Global()\n@Module({{\n  imports: [\n{parts}\n  ],\n}})\n// a note\nexport class App {{}}\n\n@ns.Injectable\nclass Plain {{}}\n\ncall(1)\nclass Bare {{}}\n"
    got = {s["name"]: (s["type"], s["decorators"]) for s in extract.script_symbols(text)}
    assert got["App"] == ("module", ["Global", "Module"]) and got["Plain"] == ("service", ["Injectable"]) and got["Bare"] == ("class", [])
