from pyspark.sql import functions as F

from quarrystone.functions import paths as P
from quarrystone.functions import text as T
from quarrystone.functions import vectors as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_terms_and_squash(spark):
    assert one(spark, T.terms(F.lit("Fix the userService, fix USER_id a")), T.squash(F.lit("src/userService.ts"))) == (["fix", "the", "user", "service", "user_id"], "srcuserservicets")


def test_estimates_and_clamp(spark):
    row = one(spark, T.token_estimate(F.lit("12345")), T.token_estimate(F.lit(None).cast("string")), T.budget_clamp(F.lit(6000), F.lit(5000)), T.budget_clamp(F.lit(100), F.lit(5000)), T.budget_clamp(F.lit(77), F.lit(None).cast("int")))
    assert row == (2, 0, 3000, 1000, 77)


def test_lines(spark):
    row = one(spark, F.size(T.lines(F.lit("a\r\nb\rc\nd"))), T.line_at(F.lit("a\nb\nc"), F.lit(4)), T.dominant_line_end(F.lit("a\r\nb\r\nc\n")), T.dominant_line_end(F.lit("a")), T.shortened(F.lit("abcdef"), 4))
    assert row == (4, 3, "crlf", "lf", "abc…")


def test_half_up_and_share(spark):
    assert one(spark, T.half_up(F.lit(-2.5)), T.half_up(F.lit(2.5)), T.share(F.lit(1), F.lit(3)), T.share(F.lit(1), F.lit(0))) == (-2, 3, 33.3, 0.0)


def test_paths(spark):
    cases = {"src/x/../a/./b.ts": "src/a/b.ts", "a//b": "a/b", "./a": "a", "../a": "../a", "a/../../b": "../b"}
    rows = spark.createDataFrame(list(cases.items()), "path string, want string")
    assert all(r["got"] == r["want"] for r in rows.select(P.normalized(F.col("path")).alias("got"), "want").collect())


def test_filters(spark):
    cases = [
        ("src/a.ts", True, False), ("src\\a.py", True, False), ("node_modules/x/a.ts", False, False), ("a/b.min.js", False, False), ("a/pkg_pb2.py", False, False), ("Dockerfile", True, False),
        ("x/package-lock.json", False, False), ("a.exe", False, False), ("src/a.spec.ts", True, True), ("__tests__/a.py", True, True), ("a_test.go", True, False), ("README.md", True, False), ("a.Designer.cs", False, False),
    ]
    rows = spark.createDataFrame(cases, "path string, supported boolean, test boolean")
    for r in rows.select("path", "supported", "test", P.is_supported(F.col("path")).alias("s"), P.is_test(F.col("path")).alias("t")).collect():
        assert (r["s"], r["t"]) == (r["supported"], r["test"]), r


def test_ancestors_and_suffixes(spark):
    assert one(spark, P.ancestors(F.lit("a/b/c.ts")), P.ancestors(F.lit("c.ts")), P.suffixes(F.lit("a/b/c.ts"))) == (["a", "a/b"], [], ["a/b/c.ts", "b/c.ts", "c.ts"])


def test_cosine(spark):
    a, b, zero = (F.array(*[F.lit(float(x)) for x in v]) for v in ((1, 0), (1, 1), (0, 0)))
    row = one(spark, F.round(V.cosine(a, b), 6), V.cosine(a, zero), V.cosine(a, F.array(F.lit(1.0))))
    assert row == (0.707107, None, None)
