import pytest
from pyspark.sql import functions as F

from quarrystone.operators import resolve


def resolved(spark, files, imports):
    f = spark.createDataFrame([(p, m) for p, m in files], "path string, module string")
    i = spark.createDataFrame([(p, n, s, names, False, n + 1) for p, n, s, names in imports], "path string, ord int, specifier string, imported_names array<string>, is_type_only boolean, line int")
    return resolve.resolve_imports(i, f)


CASES = [
    ("relative", ["src/a.ts", "src/lib/b.ts"], "./lib/b", {"src/lib/b.ts"}),
    ("relative index", ["src/a.ts", "src/lib/index.ts"], "./lib", {"src/lib/index.ts"}),
    ("relative up", ["src/a.ts", "other/b.py"], "../other/b", {"other/b.py"}),
    ("relative only", ["src/a.ts", "lib/b.ts"], "./b", set()),
    ("extension order", ["src/a.ts", "src/b.js", "src/b.ts"], "./b", {"src/b.ts"}),
    ("scoped package", ["src/a.ts", "packages/core/src/index.ts"], "@scope/core", {"packages/core/src/index.ts"}),
    ("scoped entry", ["src/a.ts", "packages/core/src/x.ts", "z/core/x.ts"], "@scope/core/x", {"packages/core/src/x.ts"}),
    ("ambiguous bare package", ["src/a.ts", "one/utils/x.ts", "two/utils/x.ts"], "utils/y", set()),
    ("path end", ["src/a.rb", "lib/net/socket.h"], "net/socket.h", {"lib/net/socket.h"}),
    ("dotted", ["main.py", "foo/bar/baz.py"], "foo.bar.baz", {"foo/bar/baz.py"}),
    ("directory", ["main.go", "internal/billing/api/a.go", "internal/billing/api/b.go"], "host.org/x/internal/billing/api", {"internal/billing/api/a.go", "internal/billing/api/b.go"}),
    ("single segment", ["main.go", "x/context/a.go"], "context", set()),
    ("base name", ["main.go", "x/only.go"], "std:only", {"x/only.go"}),
    ("base name twice", ["main.go", "x/only.go", "y/only.go"], "std:only", set()),
    ("blank", ["main.go"], "  ", set()),
]


@pytest.mark.parametrize("name,paths,spec,want", CASES, ids=[c[0] for c in CASES])
def test_strategies(spark, name, paths, spec, want):
    got = resolved(spark, [(p, None) for p in paths], [(paths[0], 0, spec, [])])
    assert {r["target"] for r in got.collect()} == want


def test_namespaces(spark):
    files = [("a.cs", "App"), ("s/UserService.cs", "App.Services"), ("s/Other.cs", "App.Services")]
    assert {r["target"] for r in resolved(spark, files, [("a.cs", 0, "App.Services", [])]).collect()} == {"s/UserService.cs", "s/Other.cs"}
    assert {r["target"] for r in resolved(spark, files, [("a.cs", 0, "App.Services.UserService", [])]).collect()} == {"s/UserService.cs"}
    assert {r["target"] for r in resolved(spark, files, [("a.cs", 0, "App.Services.Thing", [])]).collect()} == {"s/UserService.cs", "s/Other.cs"}


def test_references_and_usage(spark):
    files = [(p, None) for p in ("a.ts", "b.ts", "user.ts")]
    got = resolved(spark, files, [("a.ts", 0, "./user", ["User", "hidden", "User"]), ("b.ts", 0, "./user", ["User"]), ("b.ts", 0, "./user", ["User"]), ("user.ts", 0, "./user", ["User"])])
    symbols = spark.createDataFrame([("user.ts", "User", True), ("user.ts", "User", True), ("user.ts", "hidden", False)], "path string, name string, exported boolean")
    usage = resolve.usage_counts(resolve.symbol_references(got, symbols)).collect()
    assert [(r["defined_in"], r["symbol_name"], r["referenced_by"]) for r in usage] == [("user.ts", "User", 2)]
    assert {(r["src"], r["dst"]) for r in resolve.file_edges(got).collect()} == {("a.ts", "user.ts"), ("b.ts", "user.ts")}


def test_empty_and_null_rows(spark):
    got = resolved(spark, [("a.ts", None), (None, None)], [(None, 0, "./a", []), ("a.ts", 1, None, None)])
    assert got.count() == 0
    assert resolve.file_edges(got.where(F.lit(False))).count() == 0
