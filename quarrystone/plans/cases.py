"""Queries over small tables written out here, in both engines, for rules that the test tables seldom reach; and queries
of packages, answers and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import paths as P
from quarrystone.functions import text as T
from quarrystone.operators import context, graph, metrics, report, resolve, semantic
from quarrystone.plans.queries import _edges, _file_scores, _symbols, query, table
from quarrystone.plans.sql import COSTS, DEGREES, REFS, RESOLVED, SCORES, SQL, is_test
from quarrystone.session import staged

FILES = [
    ("app/main.ts", None), ("app/util/strings.ts", None), ("app/util/index.ts", None), ("app/deep/one/two.tsx", None),
    ("packages/core/src/index.ts", None), ("packages/core/src/store.ts", None), ("packages/shape/lib/area.js", None), ("other/shape/x.ts", None),
    ("srv/go.mod.txt", None), ("srv/internal/cache/lru.go", None), ("srv/internal/cache/ttl.go", None), ("srv/internal/http/server.go", None),
    ("jvm/src/com/acme/Order.java", "com.acme"), ("jvm/src/com/acme/Item.java", "com.acme"), ("jvm/src/com/acme/io/Reader.java", "com.acme.io"),
    ("py/tool/run.py", None), ("py/tool/parse/__init__.py", None), ("py/tool/parse/lexer.py", None), ("net/Billing.cs", "Acme.Billing"), ("net/Ledger.cs", "Acme.Billing"),
    ("web/unique_widget.ts", None), ("a/dup.ts", None), ("b/dup.ts", None), ("rs/src/store/mod.rs", None), ("rs/src/main.rs", None), ("util/solo.ts", None), ("py/tool/Makefile", None),
]
IMPORTS = [
    ("app/main.ts", 0, "./util", ["trim", "pad"]), ("app/main.ts", 1, "./util/strings", ["pad"]), ("app/main.ts", 2, "@acme/core", ["open"]), ("app/main.ts", 3, "core/store", ["Store"]),
    ("app/main.ts", 4, "@x/shape/area", ["area"]), ("app/main.ts", 5, "util/strings", ["trim"]), ("app/main.ts", 6, "@/app/util/strings", ["trim"]), ("app/main.ts", 7, "nowhere", ["x"]), ("app/main.ts", 8, "unique_widget", ["Widget"]),
    ("app/deep/one/two.tsx", 0, "../../util/strings.ts", ["trim"]), ("app/deep/one/two.tsx", 1, "../../../web/unique_widget", ["Widget"]), ("app/deep/one/two.tsx", 2, "dup", ["d"]), ("app/deep/one/two.tsx", 3, "two.tsx", []),
    ("srv/internal/http/server.go", 0, "example.org/srv/internal/cache", ["Get"]), ("srv/internal/http/server.go", 1, "internal/http", []),
    ("jvm/src/com/acme/io/Reader.java", 0, "com.acme", ["Order"]), ("jvm/src/com/acme/io/Reader.java", 1, "com.acme.Order", ["Order"]), ("jvm/src/com/acme/Item.java", 0, "com.acme.io.Missing", ["Reader"]), ("jvm/src/com/acme/Item.java", 1, "src.com.acme.io.Reader", ["Reader"]),
    ("py/tool/run.py", 0, "py.tool.parse", ["lex"]), ("py/tool/run.py", 1, "tool.parse.lexer", ["Lexer"]), ("py/tool/run.py", 2, ".", []), ("py/tool/run.py", 3, "./parse", ["lex"]),
    ("net/Ledger.cs", 0, "Acme.Billing", ["Invoice"]), ("rs/src/main.rs", 0, "crate::store", ["Store"]), ("rs/src/main.rs", 1, "./store", ["Store"]), ("app/main.ts", 11, "util/solo", ["solo"]), ("py/tool/run.py", 4, "tool.Makefile", []), ("app/main.ts", 9, "  ", []), ("app/main.ts", 10, None, []),
]
NAMES = [
    ("app/util/strings.ts", "trim", True), ("app/util/strings.ts", "pad", True), ("app/util/index.ts", "pad", True), ("app/util/index.ts", "trim", False), ("packages/core/src/store.ts", "Store", True), ("packages/core/src/index.ts", "open", True),
    ("packages/shape/lib/area.js", "area", True), ("web/unique_widget.ts", "Widget", True), ("srv/internal/cache/lru.go", "Get", True), ("srv/internal/cache/ttl.go", "Get", True), ("jvm/src/com/acme/Order.java", "Order", True),
    ("jvm/src/com/acme/io/Reader.java", "Reader", True), ("py/tool/parse/lexer.py", "Lexer", True), ("py/tool/parse/__init__.py", "lex", True), ("net/Billing.cs", "Invoice", True), ("rs/src/store/mod.rs", "Store", True), ("b/dup.ts", "d", True),
]
FIND, PUT = "  }\n}\n", "  } // last\n}\n"


def case_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = spark.createDataFrame(FILES, "path string, module string")
    imports = spark.createDataFrame([(p, o, s, n, False, o + 1) for p, o, s, n in IMPORTS], "path string, ord int, specifier string, imported_names array<string>, is_type_only boolean, line int")
    return files, imports, spark.createDataFrame(NAMES, "path string, name string, exported boolean")


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool | int):
        return str(value).lower()
    if isinstance(value, list):
        return "cast([" + ", ".join(map(_literal, value)) + "] as varchar[])"
    return "'" + value.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


CASES = ", ".join([
    _values("files", "path, module", FILES),
    _values("imports", "path, ord, specifier, imported_names, is_type_only, line", [(p, o, s, n, False, o + 1) for p, o, s, n in IMPORTS]),
    _values("symbols", "path, name, exported", NAMES),
])


def _case_references(spark: SparkSession) -> DataFrame:
    files, imports, symbols = case_tables(spark)
    return resolve.symbol_references(resolve.resolve_imports(imports, files), symbols)


@query
def case_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every step by which a specifier may resolve, on paths of several languages."""
    files, imports, _ = case_tables(spark)
    return resolve.resolve_imports(imports, files).select("path", "spec", "target", "prio")


@query
def case_references(spark: SparkSession, folder: str) -> DataFrame:
    return _case_references(spark).drop("ord")


@query
def case_usage(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.usage_counts(_case_references(spark))


@query
def case_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Each imported name with its definitions and the list of files that use it."""
    return _case_references(spark).groupBy("symbol_name").agg(F.count_distinct("to_path").alias("definitions"), F.array_join(F.sort_array(F.collect_set("from_path")), ", ").alias("users"))


@query
def context_packages(spark: SparkSession, folder: str) -> DataFrame:
    """For each repo: matching files, symbols and tests in turn, then snippets, within 1500 tokens."""
    repo = F.split_part("path", F.lit("/"), F.lit(1)).alias("repo")
    part = lambda rows, name, item, order: rows.select("repo", F.lit(name).alias("section"), F.row_number().over(_by("repo", order)).cast("long").alias("ord"), F.col(item).alias("item"))
    files = _file_scores(spark, folder).where("score > 0").select(repo, "path", "score")
    symbols = table(spark, folder, "symbols").select(repo, "id").where("id is not null").distinct()
    tests = table(spark, folder, "files").where(P.is_test(F.col("path"))).select(repo, "path").distinct()
    snippets = table(spark, folder, "code_chunks").where("kind = 'symbol'").select("repo", "id", "text")
    shown = snippets.withColumn("ord", F.row_number().over(_by("repo", ["id"])).cast("long")).where("ord <= 6")
    rows = part(files, "files", "path", [F.desc("score"), "path"]).union(part(symbols, "symbols", "id", ["id"]).where("ord <= 8")).union(part(tests, "tests", "path", ["path"])).withColumn("cost", T.token_estimate(F.col("item")))
    rows = rows.union(shown.select("repo", F.lit("snippets"), "ord", "id", T.token_estimate(F.col("text"))))
    return context.admit_in_sections(rows.where("repo is not null"), "repo", F.lit(1500), ("files", "symbols", "tests", "snippets"))


def _by(key: str, order: list):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


@query
def package_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """By repo, from its best file score and how much matches."""
    repo = F.split_part("path", F.lit("/"), F.lit(1)).alias("repo")
    best = _file_scores(spark, folder).where("score > 0").groupBy(repo).agg(F.max("score").alias("top"), F.count("*").alias("files"))
    symbols = table(spark, folder, "symbols").groupBy(repo).agg(F.count_distinct("id").alias("symbols"))
    joined = best.join(symbols, "repo", "left").na.fill(0, ["symbols"])
    return joined.select("repo", context.confidence(F.col("top"), F.col("files"), F.col("symbols"), F.lit("impact_analysis"), F.col("files") % 2 == 0).alias("confidence"))


@query
def ordered_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between the files that match, in the order of their scores."""
    from quarrystone.operators.rank import ranked

    chosen = ranked(_file_scores(spark, folder).where("score > 0"), [F.desc("score"), F.col("path")])
    return context.flow_lines(chosen.withColumnRenamed("rank", "ord"), _edges(spark, folder))


@query
def ranking_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why files rank: what matched in paths, imports and symbols, in this order."""
    files, imports, symbols = (table(spark, folder, n).where("path is not null") for n in ("files", "imports", "symbols"))
    rows = files.where(F.contains(F.lower("path"), F.lit("session"))).select("path", F.lit(1).alias("ord"), F.lit(10).alias("score"), F.array(F.lit("path has session")).alias("reasons"))
    rows = rows.union(imports.where(F.contains(F.lower("specifier"), F.lit("session"))).select("path", F.lit(2), F.lit(4), F.array(F.lit("import has session"))).distinct())
    rows = rows.union(symbols.where(F.contains(F.lower("name"), F.lit("session"))).select("path", F.lit(3), F.lit(6), F.array(F.lit("symbol has session"), F.lit("path has session"))).distinct())
    return context.merged_reasons(rows).select("path", F.col("score").cast("long").alias("score"), context.reason_text(F.col("reasons")).alias("reason"))


@query
def replaced_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A replacement that forgives line ends and indentation, in every file where it finds something."""
    way = T.tolerant_replace(F.col("text"), F.lit(FIND), F.lit(PUT))
    rows = table(spark, folder, "files").where("path is not null").select("path", way.alias("w")).where("w is not null")
    return rows.select("path", "w.count", "w.strategy", F.md5(F.col("w.updated").cast("binary")).alias("updated"))


@query
def hub_flags(spark: SparkSession, folder: str) -> DataFrame:
    return report.with_hubs(graph.degrees(table(spark, folder, "files"), _edges(spark, folder))).select("path", "degree", "hub")


@query
def nodes_around(spark: SparkSession, folder: str) -> DataFrame:
    """Connected nodes whose path contains a text, with their neighbourhood."""
    return report.matching_nodes(table(spark, folder, "files").where("path is not null"), staged(_edges(spark, folder), "edges"), "session", connected=True, around=True)


@query
def runs_by_arm(spark: SparkSession, folder: str) -> DataFrame:
    """Orders stand for runs of a benchmark; some have no time."""
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("agent"), F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 3 != 0).alias("correct"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("seconds"))
    return metrics.by_arm(rows, ["agent", "arm"], ["seconds"])


@query
def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(T.token_estimate(F.col("text")).alias("used"), F.col("n_chars").alias("naive"), F.col("doc_id").alias("grep"))
    return metrics.token_totals(rows, "used", ["naive", "grep"])


@query
def chunked_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of whole files by kind."""
    made = semantic.chunk_files(table(spark, folder, "files"), _symbols(spark, folder), table(spark, folder, "imports"))
    return made.groupBy("kind").agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files"))


@query
def index_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """What a refresh of the stored vectors by the chunks of today embeds, keeps and drops."""
    made = table(spark, folder, "code_chunks").select("id", "path", "kind", "symbol", "start_line", "end_line", "text", "hash")
    stored = table(spark, folder, "chunks").withColumn("provider", F.lit("p"))
    done = semantic.refresh(made, stored.select(*[x.split()[0] for x in semantic.STORED.split(", ")]), "p")
    return spark.createDataFrame([(done.chunks, done.embedded, done.reused, done.pruned)], "chunks long, embedded long, reused long, pruned long")


_repo = "string_split(path, '/')[1]"
_flexible = r"[ \t]*\}[ \t]*\n[ \t]*\}[ \t]*\n[ \t]*"
SQL |= {
    "case_links": f"with {CASES}, {RESOLVED} select path, spec, target, cast(prio as int) as prio from resolved".replace("with files", "with recursive files", 1),
    "case_references": f"with recursive {CASES}, {RESOLVED}, {REFS} select from_path, to_path, symbol_name, line from refs",
    "case_usage": f"with recursive {CASES}, {RESOLVED}, {REFS} select to_path as defined_in, symbol_name, count(distinct from_path) as referenced_by from refs group by 1, 2",
    "case_definitions": f"with recursive {CASES}, {RESOLVED}, {REFS} select symbol_name, count(distinct to_path) as definitions, string_agg(distinct from_path, ', ' order by from_path) as users from refs group by 1",
    "context_packages": f"""with recursive {SCORES},
files_ as (select {_repo} as repo, path as item, row_number() over (partition by {_repo} order by score desc, path) as ord from scores where score > 0),
symbols_ as (select repo, id as item, row_number() over (partition by repo order by id) as ord from (select distinct {_repo} as repo, id from symbols where id is not null) qualify ord <= 8),
tests_ as (select repo, path as item, row_number() over (partition by repo order by path) as ord from (select distinct {_repo} as repo, path from files where {is_test('path')})),
snips as (select repo, id as item, row_number() over (partition by repo order by id) as ord, cast(ceil(coalesce(length(text), 0) / 4) as bigint) as cost from code_chunks where kind = 'symbol' qualify ord <= 6),
t1 as (select *, sum(cast(ceil(length(item) / 4) as bigint)) over (partition by repo order by ord) as spent, cast(ceil(length(item) / 4) as bigint) as cost from files_),
a1 as (select * from t1 where spent <= 1500), u1 as (select repo, max(spent) as used from a1 group by 1),
t2 as (select s.repo, item, ord, cast(ceil(length(item) / 4) as bigint) as cost, coalesce(used, 0) + sum(cast(ceil(length(item) / 4) as bigint)) over (partition by s.repo order by ord) as spent from symbols_ s left join u1 using (repo)),
a2 as (select * from t2 where spent <= 1500), u2 as (select repo, max(used) as used from (select * from u1 union all select repo, max(spent) from a2 group by 1) group by 1),
t3 as (select s.repo, item, ord, cast(ceil(length(item) / 4) as bigint) as cost, coalesce(used, 0) + sum(cast(ceil(length(item) / 4) as bigint)) over (partition by s.repo order by ord) as spent from tests_ s left join u2 using (repo)),
a3 as (select * from t3 where spent <= 1500), u3 as (select repo, max(used) as used from (select * from u2 union all select repo, max(spent) from a3 group by 1) group by 1),
w as (
  select s.repo, s.ord, item, cost, coalesce(used, 0) + cost <= 1500 as taken, coalesce(used, 0) + case when coalesce(used, 0) + cost <= 1500 then cost else 0 end as spent from snips s left join u3 using (repo) where ord = 1
  union all
  select n.repo, n.ord, n.item, n.cost, w.spent + n.cost <= 1500, w.spent + case when w.spent + n.cost <= 1500 then n.cost else 0 end from w join snips n on n.repo = w.repo and n.ord = w.ord + 1)
select repo, 'files' as section, ord, item, cost, cast(spent as bigint) as spent from a1 union all select repo, 'symbols', ord, item, cost, cast(spent as bigint) from a2
union all select repo, 'tests', ord, item, cost, cast(spent as bigint) from a3 union all select repo, 'snippets', ord, item, cost, cast(spent as bigint) from w where taken""",
    "package_confidence": f"""with {SCORES}, b as (select {_repo} as repo, max(score) as top, count(*) as files from scores where score > 0 group by 1),
s as (select {_repo} as repo, count(distinct id) as symbols from symbols group by 1)
select repo, case when (files % 2 = 0 and top >= 40) or (top >= 50 and coalesce(symbols, 0) >= 1) then 'high' when top >= 20 or files >= 2 then 'medium' else 'low' end as confidence from b left join s using (repo)""",
    "ordered_flow": f"with recursive {SCORES}, {RESOLVED}, c as (select path, row_number() over (order by score desc, path) as ord from scores where score > 0) select cast(a.ord * 1000000 + b.ord as bigint) as ord, src || ' -> ' || dst as item from edges join c a on a.path = src join c b on b.path = dst",
    "ranking_reasons": """with r as (select path, 1 as ord, 10 as score, 'path has session' as reason from files where contains(lower(path), 'session')
union all select distinct path, 2, 4, 'import has session' from imports where path is not null and contains(lower(specifier), 'session')
union all select distinct path, 3, 6, 'symbol has session' from symbols where path is not null and contains(lower(name), 'session')),
p as (select path, sum(score) as score, bool_or(ord = 1) as a, bool_or(ord = 2) as b, bool_or(ord = 3) as c from r group by 1)
select path, cast(score as bigint) as score, concat_ws('; ', case when a then 'path has session' end, case when b then 'import has session' end, case when c then 'symbol has session' end, case when c and not a then 'path has session' end) as reason from p""",
    "replaced_texts": f"""with c as (select path, text, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as lf,
  (length(text) - length(replace(text, chr(13) || chr(10), ''))) / 2 as crlf, length(text) - length(replace(text, chr(10), '')) as nl, {_literal(FIND)} as find, {_literal(PUT)} as put from files where path is not null),
w as (select *, case when contains(text, find) then 'exact' when contains(lf, find) then 'normalized-eol' when regexp_matches(lf, '{_flexible}') then 'flexible-whitespace' end as strategy from c),
u as (select path, strategy, crlf * 2 > nl as back, case strategy when 'exact' then cast((length(text) - length(replace(text, find, ''))) / length(find) as int) when 'normalized-eol' then cast((length(lf) - length(replace(lf, find, ''))) / length(find) as int) else 1 end as count,
  case strategy when 'exact' then substr(text, 1, instr(text, find) - 1) || put || substr(text, instr(text, find) + length(find)) when 'normalized-eol' then substr(lf, 1, instr(lf, find) - 1) || put || substr(lf, instr(lf, find) + length(find))
    else regexp_replace(lf, '{_flexible}', put) end as new from w where strategy is not null)
select path, strategy, count, md5(case when strategy <> 'exact' and back then replace(new, chr(10), chr(13) || chr(10)) else new end) as updated from u""",
    "hub_flags": f"with recursive {RESOLVED}, {DEGREES} select path, degree, degree > 0 and row_number() over (order by degree desc, path) <= 8 as hub from degrees",
    "nodes_around": f"""with recursive {RESOLVED}, m as (select distinct path from files where contains(lower(path), 'session')), e as (select src as path, dst as other from edges union select dst, src from edges),
g as (select path from m union select other from e where path in (select path from m)) select path from g where path in (select path from e)""",
    "runs_by_arm": "select o_orderpriority as agent, o_orderstatus as arm, count(*) as runs, count(*) filter (o_orderkey % 3 <> 0) as correct, round(avg(case when o_orderkey % 3 <> 0 then 1.0 else 0.0 end), 3) as share, round(avg(case when o_orderkey % 5 <> 0 then o_custkey end), 3) as mean_seconds from orders group by 1, 2",
    "token_totals": "with s as (select count(*) as tasks, cast(sum(cast(ceil(coalesce(length(text), 0) / 4) as bigint)) as bigint) as used, cast(sum(n_chars) as bigint) as naive, cast(sum(doc_id) as bigint) as grep from documents) select tasks, used, naive, grep, round((naive - used) * 100.0 / naive, 1) as saved_naive, round((grep - used) * 100.0 / grep, 1) as saved_grep from s",
    "index_refresh": """with c as (select id, hash from code_chunks), s as (select distinct id, hash from chunks),
n as (select count(*) as chunks, count(*) filter (s.id is null or s.hash is null or s.hash <> c.hash) as embedded from c left join s using (id))
select chunks, embedded, chunks - embedded as reused, (select count(*) from s where id not in (select id from c)) as pruned from n""",
}
SQL["chunked_files"] = f"""select 'file-summary' as kind, count(*) as chunks, count(distinct path) as files from files where path is not null and text is not null
union all select 'symbol', count(*), count(distinct path) from ({SQL["symbol_chunks"]})
union all select 'window', count(*), count(distinct path) from ({SQL["line_windows"]}) where path not in (select path from symbols where path is not null)"""
