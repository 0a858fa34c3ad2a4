"""SQL that gives the same rows as the queries of the core, for DuckDB over the same tables."""

from __future__ import annotations

import re

from quarrystone.functions import paths as P
from quarrystone.operators.classify import TASK_WORDS
from quarrystone.operators.metrics import grep_terms
from quarrystone.operators.resolve import ENDINGS, RESOLVED_EXTENSIONS

TASK = "fix the session token cache and schedule the route batch tests"
TERMS = list(dict.fromkeys(t for t in re.split("[^a-z0-9_]+", TASK.lower()) if len(t) >= 2))


def squash(x: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9_]+', '', 'g')"


def terms_of(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9_]+'), lambda w: length(w) >= 2)"


def base(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def stem(x: str) -> str:
    return rf"regexp_replace({base(x)}, '\.[^.]+$', '')"


def folder(x: str) -> str:
    return f"case when contains({x}, '/') then regexp_replace({x}, '/[^/]*$', '') else '.' end"


def ext(x: str) -> str:
    name = f"lower({base(x)})"
    return rf"case when {name} in ('dockerfile', 'containerfile') then '.' || {name} else regexp_extract({name}, '\.[^.]*$') end"


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def is_test(x: str) -> str:
    return rf"regexp_matches({x}, '(__tests__/|\.(spec|test)\.[tj]sx?$)')"


def top(x: str) -> str:
    return f"case when split_part({x}, '/', 1) = 'src' and contains({x}, '/') then split_part({x}, '/', 2) else split_part({x}, '/', 1) end"


def test_stem(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({base(x)}, '\.(spec|test)\.[tj]sx?$', ''), '\.[tj]sx?$', ''))"


SCORES = f"""terms as (select unnest({strings(TERMS)}) as term),
imp as (select path, term from imports, terms where contains(lower(specifier), term) group by all),
sym as (select path, term from symbols, terms where contains({squash('name')}, term) group by all),
scores as (
  select f.path, cast(sum(case when contains({squash('f.path')}, t.term) then 10 else 0 end
    + case when len(list_filter(coalesce(f.decorators, []), lambda d: contains(lower(d), t.term))) > 0 then 8 else 0 end
    + case when i.path is not null then 4 else 0 end + case when s.path is not null then 6 else 0 end) as bigint) as score
  from files f cross join terms t
  left join imp i on i.path = f.path and i.term = t.term left join sym s on s.path = f.path and s.term = t.term
  group by f.path)"""

_exts = "|".join(e.replace(".", r"\.") for e in RESOLVED_EXTENSIONS)
RESOLVED = rf"""imps as (select distinct path, ord, trim(specifier) as spec, imported_names, line from imports where path is not null and length(trim(specifier)) > 0),
f as (select distinct path, module from files),
endings as (select unnest({strings(ENDINGS)}) as e, generate_subscripts({strings(ENDINGS)}, 1) as pos),
rel0 as (select distinct path, spec, {folder('path')} || '/' || spec as joined from imps where spec like '.%'),
rel1 as (select path, spec, list_filter(string_split(joined, '/'), lambda s: s not in ('', '.')) as parts from rel0),
rel2 as (select path, spec, parts, len(list_filter(parts, lambda s: s = '..')) as ups from rel1),
up0 as (select path, spec, array_to_string(parts, '/') as base, ups, 0 as k from rel2),
walk as (
  with recursive w as (
    select path, spec, '/' || base || '/' as base, 0 as k from up0
    union all
    select path, spec, regexp_replace(base, '/[^/]+/\.\./', '/'), k + 1 from w where contains(base, '/../') and k < 60)
  select path, spec, trim(arg_max(base, k), '/') as base from w group by path, spec),
near as (
  select w.path, w.spec, arg_min(f.path, pos) as target from walk w cross join endings join f on f.path = w.base || e group by w.path, w.spec),
specs as (select distinct spec from imps where spec not like '.%'),
p1 as (select spec, 1 as prio, path as target from specs join f on f.module = spec where length(module) > 0),
p2a as (
  select spec, f.path as target, cast({stem('f.path')} = regexp_extract(spec, '[^.]*$') as int) as same
  from specs join f on f.module = regexp_extract(spec, '^(.+)\.[^.]*$', 1) where length(module) > 0),
p2 as (select spec, 2 as prio, target from p2a qualify same = max(same) over (partition by spec)),
dirs as (
  select distinct d from (
    select unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) as d from f)
  where d <> ''),
named as (select d, regexp_extract(d, '[^/]*$') as name, count(*) over (partition by regexp_extract(d, '[^/]*$')) as n from dirs),
pk0 as (select spec, starts_with(spec, '@') as scoped, list_filter(string_split(replace(spec, '\', '/'), '/'), lambda s: s <> '') as parts from specs),
pk as (
  select spec, scoped, parts[case when scoped then 2 else 1 end] as name,
         array_to_string(list_slice(parts, case when scoped then 3 else 2 end, len(parts)), '/') as sub from pk0),
roots as (select unnest(['', '/src', '/lib']) as r, unnest([0, 1, 2]) as rpos),
p3 as (
  select spec, 3 as prio, arg_min(f.path, (len(string_split(d, '/')), d, rpos, pos)) as target
  from pk join named on pk.name = named.name and (scoped or n = 1) cross join roots cross join endings
  join f on f.path = d || r || case when sub <> '' then '/' || sub else '' end || e
  group by spec),
want as (select spec, regexp_replace(regexp_replace(replace(spec, '\', '/'), '^@/', ''), '^/+', '') as want from specs),
dotted as (select spec, replace(want, '.', '/') as want from want where contains(want, '.') and not contains(want, '/')),
p4 as (select spec, 4 as prio, arg_min(f.path, pos) as target from want cross join endings join f on f.path = want || e where want <> '' group by spec),
p5 as (select spec, 5 as prio, min(f.path) as target from want join f on f.path = want or ends_with(f.path, '/' || want) where want <> '' group by spec),
p6 as (select spec, 6 as prio, arg_min(f.path, pos) as target from dotted cross join endings join f on f.path = want || e group by spec),
p7 as (select spec, 7 as prio, min(f.path) as target from dotted join f on f.path = want or ends_with(f.path, '/' || want) group by spec),
dp0 as (select spec, list_filter(string_split(regexp_replace(regexp_replace(replace(spec, '\', '/'), '^/+', ''), '/+$', ''), '/'), lambda s: s <> '') as parts,
        regexp_replace(regexp_replace(replace(spec, '\', '/'), '^/+', ''), '/+$', '') as plain from specs),
dp1 as (select spec, unnest(range(1, len(parts) + 1)) as start, parts from dp0 where contains(plain, '/')),
dp2 as (select spec, start, array_to_string(list_slice(parts, start, len(parts)), '/') as d from dp1),
direct as (select {folder('path')} as d, path from f),
dp3 as (select spec, arg_min(d, start) as d from dp2 where d in (select d from direct where d <> '.') group by spec),
p8 as (select spec, 8 as prio, path as target from dp3 join direct using (d)),
single as (select {stem('path')} as name, min(path) as target from f group by 1 having count(*) = 1 and {stem('any_value(path)')} <> ''),
p9 as (
  select spec, 9 as prio, target from (
    select spec, list_filter(string_split_regex(regexp_replace(spec, '^@', ''), '[.\\/:]'), lambda s: s <> '') as parts from specs) x
  join single on single.name = x.parts[-1]),
found as (select * from p1 union all select * from p2 union all select * from p3 union all select * from p4 union all select * from p5
          union all select * from p6 union all select * from p7 union all select * from p8 union all select * from p9),
best as (select distinct spec, target, prio from found qualify prio = min(prio) over (partition by spec)),
resolved as (
  select i.path, i.ord, i.spec, i.imported_names, i.line, n.target, 0 as prio from imps i join near n on n.path = i.path and n.spec = i.spec
  union all
  select i.path, i.ord, i.spec, i.imported_names, i.line, b.target, b.prio from imps i join best b on b.spec = i.spec),
edges as (select distinct path as src, target as dst from resolved where path <> target)"""

REFS = """refs as (
  select r.path as from_path, r.target as to_path, r.symbol_name, r.line
  from (select path, target, line, ord, unnest(imported_names) as symbol_name from resolved where path <> target) r
  join (select distinct path, name from symbols where exported and name is not null) s on s.path = r.target and s.name = r.symbol_name)"""

DEGREES = """degrees as (
  select f.path, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) as degree
  from (select distinct path from files) f
  left join (select dst as path, count(*) as n from edges group by 1) i using (path)
  left join (select src as path, count(*) as n from edges group by 1) o using (path))"""

TOP = """pairs as (
  select q.vec_id as query, e.vec_id, list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) as similarity
  from embeddings q, embeddings e where q.vec_id % 50 = 0),
found as (
  select query, vec_id, similarity from pairs where similarity >= 0
  qualify row_number() over (partition by query order by similarity desc, vec_id) <= 8)"""

COSTS = "costs as (select repo, doc_id, cast(ceil(coalesce(length(text), 0) / 4) as bigint) as cost from documents where repo is not null)"

LISTED = r"""listed as (
  select snapshot_no, loaded_at, repo, trim(regexp_replace('/' || replace(path, '\', '/') || '/', '/(\.?/)+', '/', 'g'), '/') as path,
         nullif(regexp_replace(lower(trim(content_hash)), '^sha256:', ''), '') as hash
  from file_snapshots where path is not null)"""

LINES = r"string_split_regex(text, '\r\n|\r|\n')"


def pagerank(rounds: int) -> str:
    parts = [
        f"""with {SCORES}, {RESOLVED},
total as (select sum(score) as whole, count(*) as n from scores),
tele as (select path, case when whole > 0 then score / whole else 1.0 / n end as t from scores, total),
steps as (select path, dst, sum(x) as x from (select src as path, dst, 1.0 as x from edges union all select dst, src, 0.5 from edges) group by 1, 2),
outs as (select path, sum(x) as o from steps group by 1),
r0 as (select path, cast(t as double) as r from tele)"""
    ]
    for i in range(rounds):
        parts.append(
            f"""l{i} as materialized (select coalesce(sum(r), 0) as loose from r{i} where path not in (select path from outs)),
g{i} as materialized (select s.dst as path, sum(r * x / o) as got from r{i} join steps s using (path) join outs using (path) group by 1),
r{i + 1} as materialized (select tele.path, 0.85 * (coalesce(got, 0) + loose * t) + 0.15 * t as r from tele left join g{i} using (path), l{i})"""
        )
    return ",\n".join(parts) + f"\nselect path, round(r, 9) as rank from r{rounds}"


def windows(source: str, key: str, size: int, step: int) -> str:
    return f"""with lined as (select {key}, {LINES} as l from {source} where length(trim(text)) > 0),
starts as (select {key}, l, len(l) as n, unnest(range(0, len(l), {step})) as s from lined),
made as (
  select {key}, s + 1 as start_line, least(s + {size}, n) as end_line, array_to_string(list_slice(l, s + 1, s + {size}), chr(10)) as body
  from starts where s = 0 or s - {step} + {size} < n)
"""


_words = f"regexp_replace(lower({TASK!r}), '[^a-z0-9_]+', '', 'g')"
_grep = grep_terms(TASK)
_count = "(length(t) - length(replace(t, '{0}', ''))) // {1}"

SQL: dict[str, str] = {
    "p5_found": rf"""
with {LISTED},
one as (
  select * from listed
  qualify row_number() over (partition by snapshot_no, path order by loaded_at desc, hash desc nulls last) = 1),
held as (
  select snapshot_no, repo, path,
         last_value(hash ignore nulls) over (partition by path order by snapshot_no rows between unbounded preceding and current row) as hash
  from one),
deliveries as (
  select repo, snapshot_no, lag(snapshot_no) over (partition by repo order by snapshot_no) as earlier
  from (select distinct repo, snapshot_no from listed)),
news as (
  select d.snapshot_no, n.path as new_path, n.hash as new_hash from deliveries d join held n using (repo, snapshot_no) where d.earlier is not null),
olds as (
  select d.snapshot_no, o.path as old_path, o.hash as old_hash from deliveries d join held o on o.repo = d.repo and o.snapshot_no = d.earlier)
select coalesce(p.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(new_path, old_path) as path,
       case when old_path is null then 'added' when new_path is null then 'removed' else 'changed' end as change
from news p full join olds o on p.snapshot_no = o.snapshot_no and new_path = old_path
where old_path is null or new_path is null or new_hash <> old_hash
""",
    "lexical_score": f"with {SCORES} select path, score from scores where score > 0",
    "lexical_top": f"with {SCORES} select path, score from scores where score > 0 order by score desc, path limit 16",
    "symbol_score": f"""with {SCORES},
s as (select distinct id, path, name, parent_name, decorators, tags from symbols where id is not null),
ctx as (select path, term from (select path, lower(concat_ws(' ', specifier, array_to_string(imported_names, ' '))) as w from imports) x, terms where contains(w, term) group by all),
q as (
  select s.id, any_value(s.path) as path, any_value({squash("coalesce(s.name, '')")}) as n, any_value(coalesce(sc.score, 0)) as fs,
    sum(case when {squash("coalesce(s.name, '')")} = t.term or {squash("coalesce(s.parent_name, '')")} = t.term then 18
             when contains({squash("coalesce(s.name, '')")}, t.term) or contains({squash("coalesce(s.parent_name, '')")}, t.term) then 9 else 0 end
      + case when contains({squash('s.path')}, t.term) then 6 else 0 end
      + case when len(list_filter(coalesce(s.decorators, []), lambda d: contains(lower(d), t.term))) > 0 then 8 else 0 end
      + case when len(list_filter(coalesce(s.tags, []), lambda d: contains(d, t.term))) > 0 then 4 else 0 end
      + case when c.path is not null then 3 else 0 end) as pts
  from s cross join terms t left join scores sc on sc.path = s.path left join ctx c on c.path = s.path and c.term = t.term group by s.id),
total as (
  select id, least(fs / 4.0, 8.0) + pts + case when n <> '' and contains({_words}, n) then 25 else 0 end
    + case when {is_test('path')} then 18 else 0 end as score from q)
select id, cast(score as double) as score from total where score > 0""",
    "path_flags": f"""select path, {ext('path')} as ext,
  (len(list_intersect(string_split(path, '/'), {strings(P.EXCLUDED_DIRECTORIES)})) = 0 and not regexp_matches(lower(path), '({"|".join(P.GENERATED_NAMES)})')
    and {ext('path')} in ({strings([*P.SCRIPT_EXTENSIONS, *P.OTHER_EXTENSIONS])[1:-1]})) as supported,
  regexp_matches(lower(path), '({"|".join(P.GENERATED_NAMES)})') as generated, {is_test('path')} as test,
  regexp_matches(lower(path), '\\.(ts|tsx|js|jsx)$') as script, {top('path')} as top, {stem('path')} as stem, {folder('path')} as dir,
  {test_stem('path')} as test_stem, cast(len(string_split(path, '/')) - 1 as int) as depth
from files""",
    "normal_paths": f"with {LISTED} select distinct path, hash from listed",
    "file_edges": f"with {RESOLVED} select src, dst from edges",
    "resolution_steps": f"with {RESOLVED} select cast(prio as int) as prio, count(*) as links, count(distinct spec) as specifiers from resolved group by 1",
    "symbol_references": f"with {RESOLVED}, {REFS} select from_path, to_path, symbol_name, line from refs",
    "usage_counts": f"with {RESOLVED}, {REFS} select to_path as defined_in, symbol_name, count(distinct from_path) as referenced_by from refs group by 1, 2",
    "references_by_definition": f"with {RESOLVED}, {REFS} select symbol_name, count(distinct to_path) as definitions, count(distinct from_path) as users, min(from_path) as first_user from refs group by 1",
    "degrees": f"with {RESOLVED}, {DEGREES} select path, in_degree, out_degree, degree from degrees",
    "hotspots": f"with {RESOLVED}, {DEGREES} select path, in_degree, out_degree, degree from degrees order by degree desc, path limit 15",
    "orphans": f"with {RESOLVED}, {DEGREES} select path from degrees where degree = 0",
    "impact": f"""with recursive {RESOLVED},
seeds as (select path as seed from files where file_id % 50 = 0),
reach as (
  select seed, src as path, 1 as distance from seeds join edges on dst = seed
  union
  select seed, src, distance + 1 from reach join edges on dst = path where distance < 3)
select seed, path, cast(min(distance) as int) as distance from reach group by 1, 2""",
    "hop_counts": f"""with recursive {RESOLVED},
both_ways as (select src, dst from edges union select dst, src from edges),
start as (select min(src) as path from edges),
walk2 as (
  select path, 0 as hops from start where path is not null
  union
  select dst, hops + 1 from walk2 join both_ways on src = path where hops < 50),
least as (select path, min(hops) as hops from walk2 group by 1)
select l.path, cast(l.hops as int) as hops, min(p.path) as parent
from least l left join both_ways b on b.dst = l.path left join least p on p.path = b.src and p.hops = l.hops - 1 group by 1, 2""",
    "pagerank": pagerank(30),
    "repo_communities": """select repo as community, count(*) as size, array_to_string(list_slice(list_sort(list(path)), 1, 3), ' ') as members from files group by 1""",
    "connected_parts": f"""with recursive {RESOLVED},
both_ways as (select src, dst from edges union select dst, src from edges),
walk2 as (
  select distinct src as node, src as seen from both_ways
  union
  select node, dst from walk2 join both_ways on src = seen)
select node, min(seen) as component from walk2 group by 1""",
    "merged_hints": f"""with {SCORES}
select path, cast(score + case when path in (select path from documents where path is not null) then 1 else 0 end as bigint) as score from scores
where score + case when path in (select path from documents where path is not null) then 1 else 0 end > 0""",
    "hint_boosts": f"""with {SCORES},
h as (select path, bool_or(source = 'issue') as active, bool_or(source = 'chat') as opened, bool_or(source = 'commit') as changed,
             max(case when source = 'readme' then (length(text) % 100) / 100 end) as similarity from documents where path is not null group by 1)
select path, cast(score + case when active then 25 else 0 end + case when opened then 12 else 0 end + case when changed then 30 else 0 end
  + coalesce(floor(similarity * 40 + 0.5), 0) as bigint) as score from scores left join h using (path)""",
    "neighbour_boosts": f"""with {SCORES}, {RESOLVED}, m as (select path from scores where score >= 10)
select path, cast(score + case when path in (select src from edges where dst in (select path from m)) then 7 else 0 end
  + case when path in (select dst from edges where src in (select path from m)) then 7 else 0 end + case when {is_test('path')} then 45 else 0 end as bigint) as score from scores""",
    "expand_one_hop": f"""with {SCORES}, {RESOLVED}, p as (select * from scores where score > 0),
o as (select b.dst as path, greatest(1, max(score) - 3) as offer from p join (select src, dst from edges union all select dst, src from edges) b on b.src = p.path group by 1)
select coalesce(p.path, o.path) as path, cast(greatest(coalesce(score, offer), coalesce(offer, score)) as bigint) as score from p full join o on p.path = o.path""",
    "fused_documents": f"""with d as (select doc_id, length(text) as size, len(list_distinct({terms_of('text')})) as words from documents),
r as (select doc_id, row_number() over (order by size desc, doc_id) as a, row_number() over (order by words desc, doc_id) as b from d),
s as (select doc_id, 1.0 / (60 + a) + 1.0 / (60 + b) as score from r)
select doc_id, round(score / max(score) over (), 9) as score from s""",
    "line_windows": windows("files", "path", 60, 50) + r"select path, cast(start_line as int) as start_line, cast(end_line as int) as end_line, substr(sha256(body), 1, 16) as hash from made where regexp_matches(body, '\S')",
    "small_windows": windows("documents", "doc_id", 4, 3) + r"select doc_id, cast(start_line as int) as start_line, cast(end_line as int) as end_line, cast(length(body) as int) as size from made where regexp_matches(body, '\S')",
    "symbol_chunks": f"""with s as (select distinct on (id) * from symbols where path is not null order by id),
free as (select * from s where parent_name is null or not exists (select 1 from symbols o where o.path = s.path and o.name = s.parent_name)),
kept as (select * from free qualify row_number() over (partition by path order by start_line, id) <= 200),
lined as (select path, {LINES} as l from files where text is not null),
r as (
  select k.*, l, least(greatest(1, coalesce(start_line, 1)), greatest(len(l), 1)) as a from kept k join lined using (path)),
r2 as (select *, greatest(a, least(coalesce(end_line, 1), len(l))) as b, concat_ws('.', parent_name, name) as full_name from r),
t as (select *, array_to_string(list_slice(l, a, b), chr(10)) as body from r2),
u as (select *, '// ' || concat_ws(' › ', path, concat_ws(' ', type, full_name)) || chr(10)
         || case when length(body) <= 1500 then body else substr(body, 1, 1500) || chr(10) || '… (truncated)' end as made from t)
select path || '#symbol:' || full_name || '@' || start_line as id, path, name as symbol, cast(a as int) as start_line, cast(b as int) as end_line, substr(sha256(made), 1, 16) as hash from u""",
    "file_summaries": """with s as (select path, string_agg(concat_ws(' ', type, name), chr(10) order by start_line, id) as s from (
    select * from (select distinct on (id) * from symbols order by id) qualify row_number() over (partition by path order by start_line, id) <= 30) group by 1),
i as (select path, string_agg(specifier, ', ' order by ord, specifier) as i from (
    select distinct path, ord, specifier from imports where specifier is not null qualify row_number() over (partition by path order by ord, specifier) <= 20) group by 1),
d as (
  select path, concat_ws(chr(10), 'file: ' || path, case when length(module) > 0 then 'module: ' || module end,
    case when len(decorators) > 0 then 'decorators: ' || array_to_string(decorators, ', ') end, s, 'imports: ' || i) as doc
  from files left join s using (path) left join i using (path))
select path, substr(sha256(doc), 1, 16) as hash from d""",
    "stale_chunks": "select c.id, c.hash from code_chunks c left join chunks s on s.id = c.id where s.hash is null or s.hash <> c.hash",
    "upserted_index": f"""with {LISTED},
one as (select * from listed qualify row_number() over (partition by snapshot_no, path order by loaded_at desc, hash desc nulls last) = 1)
select path, hash from one where snapshot_no = 2
union all
select path, hash from one o where snapshot_no = 1 and path not in (select path from one where snapshot_no = 2)
  and path not in (select path from (select * from listed where snapshot_no = 3 qualify row_number() over (partition by path order by loaded_at desc) = 1) where hash is null)""",
    "pruned_index": "select id, hash from chunks where id in (select id from code_chunks)",
    "first_by_text": "select min(doc_id) as doc_id, sha256(lower(trim(text, ' '))) as hash from documents group by 2",
    "vector_top_k": f"with {TOP} select query, vec_id, round(similarity, 6) as similarity from found",
    "vector_pool": f"with {TOP} select query, label, round(max(similarity), 6) as similarity from found join embeddings using (vec_id) group by 1, 2",
    "vector_stats": """select count(*) as vectors, count(distinct path) as paths,
  (select cast(n as int) from (select len(vector) as n, count(*) as c from chunks where len(vector) > 0 group by 1) order by c desc, n desc limit 1) as dims from chunks""",
    "retrieval_metrics": f"""with {TOP},
r as (select query, vec_id, row_number() over (partition by query order by round(similarity, 6) desc, vec_id) as rank from found where query <> vec_id),
truth as (select q.vec_id as query, e.vec_id from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 50 = 0),
h as (select t.query, min(rank) as rank from truth t left join r on r.query = t.query and r.vec_id = t.vec_id group by 1),
k as (select *, case when query % 100 = 0 then 'even' else 'odd' end as kind from h)
select kind, count(*) as queries, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 3) as hit_at_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 3) as hit_at_5,
  round(avg(coalesce(1.0 / rank, 0.0)), 3) as mrr from k group by rollup (kind)""",
    "budget_prefix": f"with {COSTS} select repo, doc_id, cost, cast(sum(cost) over (partition by repo order by doc_id) as bigint) as spent from costs qualify sum(cost) over (partition by repo order by doc_id) <= 6000",
    "budget_skip": f"""with recursive {COSTS},
n as (select *, row_number() over (partition by repo order by doc_id) as k from costs),
w as (
  select repo, k, doc_id, cost, cost <= 2000 as taken, case when cost <= 2000 then cost else 0 end as spent from n where k = 1
  union all
  select n.repo, n.k, n.doc_id, n.cost, w.spent + n.cost <= 2000, case when w.spent + n.cost <= 2000 then w.spent + n.cost else w.spent end
  from w join n on n.repo = w.repo and n.k = w.k + 1)
select repo, doc_id, cost, cast(spent as bigint) as spent from w where taken""",
    "history_budget": f"with {COSTS} select repo, doc_id, cost, cast(sum(cost) over (partition by repo order by doc_id desc) as bigint) as spent from costs qualify sum(cost) over (partition by repo order by doc_id desc) <= 4000",
    "savings": """with l as (select l_orderkey as call_id, sum(cast(trunc(l_quantity) as bigint)) as bt, sum(cast(trunc(l_extendedprice) as bigint)) as bb from lineitem group by 1),
c as (select o_orderkey as call_id, o_orderstatus = 'F' as sent, case when o_orderkey % 3 = 0 then floor(o_totalprice / 1000) end as pt, floor(o_totalprice) as pb,
             case when o_orderkey % 2 = 0 then bt end as bt, bb from orders left join l on l.call_id = o_orderkey),
r as (select call_id, cast(coalesce(pt, ceil(pb / 4)) as bigint) as actual, cast(coalesce(bt, ceil(bb / 4)) as bigint) as baseline, pt is not null as measured
      from c where sent and (bt is not null or bb is not null)),
s as (select *, baseline - actual as saved from r)
select count(*) as calls, cast(coalesce(sum(actual), 0) as bigint) as actual_tokens, cast(coalesce(sum(baseline), 0) as bigint) as baseline_tokens,
  cast(coalesce(sum(saved), 0) as bigint) as saved_tokens, coalesce(bool_or(measured), false) as any_measured,
  (select call_id from s where saved > 0 order by saved desc, call_id limit 1) as best_call, (select call_id from s order by saved, call_id limit 1) as worst_call,
  coalesce(round(sum(saved) * 100.0 / nullif(sum(baseline), 0), 1), 0.0) as saved_percent, cast(coalesce(floor(sum(saved) / nullif(count(*), 0) + 0.5), 0) as bigint) as average_saved
from s""",
    "naive_baseline": f"with {RESOLVED} select src as call_id, cast(sum(coalesce(strlen(text), 0)) + 600 as bigint) as bytes from edges left join files on path = dst group by 1",
    "grep_scores": "with d as (select doc_id, lower(coalesce(text, '')) as t from documents), s as (select doc_id, cast("
    + " + ".join(f"case when contains(t, '{w}') then 10 + least(10, {_count.format(w, len(w))}) else 0 end" for w in _grep)
    + " as bigint) as score from d) select doc_id, score from s where score > 0",
    "grep_matches": "with d as (select doc_id, lower(coalesce(text, '')) as t from documents) select doc_id from d where "
    + " + ".join(f"cast(contains(t, '{w}') as int)" for w in _grep)
    + f" >= {min(2, len(_grep))}",
    "answer_scores": """with a as (select *, concat_ws(' ', text, case when item_id % 2 = 0 then expected_path end, array_to_string(expected_facts, ', ')) as answer from eval_items)
select item_id, coalesce(contains(replace(lower(answer), chr(92), '/'), lower(expected_path)), true) as file_hit,
  len(list_filter(coalesce(expected_facts, []), lambda f: not regexp_matches(answer, f, 'i'))) = 0 as fact_hit from a""",
    "task_types": "select doc_id, case "
    + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '\\b({words})\\b') then '{name}'".replace("what's", "what''s") for name, words in TASK_WORDS)
    + " else 'feature_change' end as task_type from documents",
    "text_measures": rf"""select doc_id, cast(len(list_distinct({terms_of('text')})) as int) as terms, cast(length({squash('text')}) as int) as squashed,
  cast(ceil(coalesce(length(text), 0) / 4) as bigint) as tokens,
  case when length(text) - length(replace(text, chr(10), '')) > 0
        and (length(text) - length(replace(text, chr(13) || chr(10), ''))) > (length(text) - length(replace(text, chr(10), ''))) then 'crlf' else 'lf' end as line_end,
  cast(len({LINES}) as int) as lines, cast(length(regexp_replace(substr(text, 1, 200), '[^\n]', '', 'g')) + 1 as int) as line_at_200,
  cast(least(length(text), 80) as int) as shortened, sha256(regexp_replace(lower(trim(text, ' ')), '\s+', ' ', 'g')) as query_hash,
  cast(case when n_chars is null then length(text) else greatest(1000, least(length(text), floor(n_chars * 0.6))) end as bigint) as clamped
from documents""",
    "last_events": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "applied_changes": f"""with {LISTED},
stored as (select path, hash from listed where snapshot_no = 1 qualify row_number() over (partition by path order by loaded_at desc, hash desc nulls last) = 1),
l as (select path, hash from listed where snapshot_no > 1 qualify row_number() over (partition by path order by snapshot_no desc, loaded_at desc, coalesce(hash, '') desc) = 1)
select coalesce(l.path, s.path) as path, case when l.path is null then s.hash else l.hash end as content_hash
from stored s full join l on l.path = s.path where l.path is null or l.hash is not null""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2",
    "modules": rf"""with w as (
  select path, text, case {ext('path')} when '.cs' then 'namespace' when '.java' then 'package' when '.kt' then 'package' when '.scala' then 'package' when '.php' then 'namespace' end as word from files),
m as (select path, regexp_extract(list_filter(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: split_part(ltrim(x), ' ', 1) = word)[1], '^\s*\w+\s+([\w.\\]+)', 1) as m from w where word is not null)
select path, trim(replace(m, chr(92), '.'), '.') as module from m where trim(replace(m, chr(92), '.'), '.') <> ''""",
    "surprising": f"""with p as (select distinct i.path as src, f.path as dst from (select distinct path, specifier from imports where specifier like '.%') i
  join (select distinct path from files) f on {stem('f.path')} <> '' and contains(i.specifier, {stem('f.path')}) and f.path <> i.path),
l as (select path, concat_ws(':', repo, {ext('path')}) as label from files)
select src, dst, {top('src')} as src_top, {top('dst')} as dst_top from p join l a on a.path = src join l b on b.path = dst where {top('src')} <> {top('dst')} and a.label <> b.label""",
    "related_tests": f"""with {SCORES}, sel as (select path from scores where score > 0 order by score desc, path limit 16),
st as (select distinct {test_stem('path')} as s from sel where {test_stem('path')} <> '' union select term from terms),
hit as (select distinct path from symbols, terms where contains({squash('name')}, term))
select distinct path from files where {is_test('path')} and (path in (select path from hit) or exists (select 1 from st where contains(lower(path), s)))""",
    "dependency_flow": f"with {SCORES}, {RESOLVED}, p as (select path from scores where score > 0) select src, dst from edges where src in (select path from p) and dst in (select path from p)",
    "viewer_graph": f"""with {RESOLVED}, n as (select path from files where contains(path, 'session')), e as (select * from edges where src in (select path from n) and dst in (select path from n)),
s as (select path, count(distinct id) as symbols from symbols group by 1)
select path, coalesce((select count(*) from e where dst = path), 0) as in_degree, coalesce((select count(*) from e where src = path), 0) as out_degree,
  (select count(*) from e where dst = path or src = path) as degree, coalesce(symbols, 0) as symbols from n left join s using (path)""",
    "index_summary": f"with {RESOLVED} select (select count(distinct path) from files) as files, (select count(distinct id) from symbols) as symbols, (select count(*) from edges) as edges",
    "top_orders": "select o_custkey, o_orderkey, o_totalprice, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as place from orders qualify place <= 3",
}

_changes = SQL["p5_found"].replace("as change\nfrom", "as change, old_hash, new_hash\nfrom")
SQL["p5_counts"] = f"select snapshot_no, change, count(*) as files, count(old_hash) as old_hashes, count(case when change <> 'removed' then new_hash end) as new_hashes from ({_changes}) group by 1, 2"
