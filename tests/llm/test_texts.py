import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import leaks, mixing, provenance, splitting, truncation
from quarrystone.llm.splitting import cut, line_ends

ITEM = "Explain why the shared cursor of the window is handed to the parser and not to the export list while only the nested branch of the planner writes the record back before the merge begins and the lease ends"


def brute(item, doc, part=0.5, budget=8):
    """Whether some run of at least half of the item is within its budget of some run of the document."""
    least = max(1, -int(-len(item) * part // 1))
    for length in range(least, len(item) + 1):
        for s in range(len(item) - length + 1):
            row = [0] * (len(doc) + 1)
            for i, w in enumerate(item[s : s + length], 1):
                fresh = [i]
                for j, d in enumerate(doc, 1):
                    fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (w != d)))
                row = fresh
            if min(row) <= length // budget:
                return True
    return False


def test_words_ignore_layout_markup_and_prefixes():
    plain = leaks.words("Look at `a_b` in src/x.ts, then go.")
    for other in ("> look AT **a_b** in\n> src/x.ts then go", "// Look at <code>a_b</code> in\n// src/x.ts,\n// then go.", "Look at &quot;a\\_b&quot; in src\\/x.ts,\\nthen go", "* Look at [a_b](http://x.y/z) in\n* src/x.ts then go"):
        assert leaks.words(other) == plain, other


def test_myers_against_the_table():
    rng = random.Random(5)
    for _ in range(200):
        pattern, text = [rng.choice("abc") for _ in range(rng.randrange(1, 12))], [rng.choice("abc") for _ in range(rng.randrange(0, 20))]
        row = [0] * (len(text) + 1)
        for i, w in enumerate(pattern, 1):
            fresh = [i]
            for j, d in enumerate(text, 1):
                fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (w != d)))
            row = fresh
        for k in range(4):
            assert leaks.within(pattern, text, k) == (min(row) <= k)


def test_search_against_brute_force():
    rng, ready = random.Random(2), leaks.Items([(1, ITEM)], leaks.LeakParams())
    item = leaks.words(ITEM)
    for _ in range(120):
        a = rng.randrange(0, len(item) - 10)
        passage = item[a : a + rng.randrange(8, len(item))]
        for _ in range(rng.randrange(0, 6)):
            passage[rng.randrange(len(passage))] = "other"
        doc = ["x"] * rng.randrange(20) + passage + ["y"] * rng.randrange(20)
        assert bool(ready.found(" ".join(doc))) == brute(item, doc)


def test_search_tries_every_length_of_a_passage():
    def whole(item, doc):
        """Whether a run of any length from half of the item to all of it is within its budget of some run of the document."""
        n = len(item)
        for s in range(n // 2 + 1):
            row = [0] * (len(doc) + 1)
            for length, w in enumerate(item[s:], 1):
                fresh = [length]
                for j, d in enumerate(doc, 1):
                    fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (w != d)))
                row = fresh
                if length >= -(-n // 2) and min(row) <= length // 8:
                    return True
        return False

    item = [f"w{i}" for i in range(40)]
    passage = item[8:32]
    passage[11:14] = ["other"] * 3
    ready = leaks.Items([(1, " ".join(item))], leaks.LeakParams())
    assert ready.found(" ".join(["x"] * 30 + passage + ["y"] * 30)) == [1]
    rng = random.Random(3)
    for n in (17, 40, 48, 70):
        item = [f"w{i}" for i in range(n)]
        ready = leaks.Items([(1, " ".join(item))], leaks.LeakParams())
        for _ in range(60):
            size = rng.randrange(n // 2 - 2, n + 1)
            a = rng.randrange(n - size + 1)
            passage = item[a : a + size]
            for at in rng.sample(range(size), size // 8 + rng.randrange(2)):
                passage[at] = rng.choice(["other", "", "more words"])
            doc = " ".join(["x"] * rng.randrange(20) + passage + ["y"] * rng.randrange(20)).split()
            assert bool(ready.found(" ".join(doc))) == whole(item, doc)


def test_leaks_rows(spark):
    docs = spark.createDataFrame([(1, "before " + ITEM.upper(), "x"), (1, ITEM, None), (2, "nothing", "x"), (3, None, "x"), (4, "", "x"), (None, ITEM, "x"), (5, ITEM + " pad" * 50_000, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, "a"), (7, ITEM, "b"), (8, None, "a"), (9, "", "a"), (10, "!!", "a")], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == {(1, 7), (5, 7)}
    assert {tuple(r) for r in leaks.leaks(docs, items, params=leaks.LeakParams(block=1)).collect()} == {(1, 7), (5, 7)}
    assert {tuple(r) for r in leaks.leak_report(leaks.leaks(docs, items), items).collect()} == {(7, 2)}
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def joined(text, pieces):
    return "".join(text[core:end] for _, core, end in pieces)


@pytest.mark.parametrize("seed", range(8))
def test_pieces_give_the_text_back_within_the_limit(seed):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n", "\r"])
    text = end.join(" " * rng.choice([0, 0, 4, 8]) + "w" * rng.randrange(0, 60) + rng.choice(["", ";", " é😀 x"]) for _ in range(rng.randrange(1, 200)))
    if seed % 3 == 0:
        text += "z" * 3000
    most, overlap = rng.choice([40, 200, 900]), rng.choice([0, 3, 12])
    pieces = cut(text, most, overlap)
    assert joined(text, pieces) == text
    assert all(0 < e - s <= most for s, _, e in pieces)
    starts = {0, *line_ends(text)[0]}
    assert all(s in starts for s, c, _ in pieces if s != c)
    if max(map(len, text.splitlines() or [""])) < most // 3:
        assert all(e in starts for _, _, e in pieces[:-1])


def test_an_edit_alters_only_near_pieces():
    rng = random.Random(9)
    lines = [f"line {i} " + "".join(rng.choice("abcdef ") for _ in range(40)) for i in range(600)]
    before = [s for s in splitted("\n".join(lines))]
    lines.insert(5, "an added line that moves all the others")
    after = [s for s in splitted("\n".join(lines))]
    assert len(set(before) & set(after)) >= 0.9 * len(before)


def splitted(text):
    return [text[s:e] for s, _, e in cut(text, 1500, 5)]


def test_piece_rows(spark):
    options = spark.createDataFrame([(0, 50, 2), (1, None, None), (2, 30, None)], "options_id int, max_chunk_chars int, window_overlap int")
    body = "\n".join(f"row {i}" for i in range(20))
    rows = [("a", "symbol", "head\n" + body, 5, 24, None), ("b", "window", "head\n" + body[:30], 1, 5, 2), ("c", "file-summary", body, 1, 99, 1), ("d", "symbol", None, 1, 1, 0), ("e", "symbol", "x" * 400, 1, 1, 0), ("f", None, "", 1, 1, 77)]
    chunks = spark.createDataFrame([(*r, "clash") for r in rows], "id string, kind string, text string, start_line int, end_line int, options_id int, most string")
    got = splitting.pieces(chunks, options).collect()
    assert {r["id"] for r in got} == {"a", "c"} == {r["id"] for r in splitting.oversized(chunks, options).collect()}
    mine = sorted((r for r in got if r["id"] == "a"), key=lambda r: r["piece"])
    assert mine[0]["start_line"] == 5 and mine[-1]["end_line"] == 24 and all(len(r["text"]) <= 50 for r in mine)
    for left, right in zip(mine, mine[1:]):
        assert right["overlap_lines"] == 2 and right["start_line"] == left["end_line"] - 1
    for r in mine:
        assert r["text"].splitlines() == body.splitlines()[r["start_line"] - 5 : r["end_line"] - 4]
    assert {(r["start_line"], r["end_line"]) for r in got if r["id"] == "c"} == {(1, 99)}
    assert splitting.pieces(chunks.limit(0), options).count() == 0 and splitting.pieces(chunks, options.limit(0)).count() == 0


def test_pivot_keeps_the_sum_and_the_chances():
    total = [0.0] * 30
    rows = [(i, 0.1 + 0.8 * ((i * 7) % 10) / 10, 1.0 + i % 5) for i in range(30)]
    whole = sum(p * w for _, p, w in rows)
    for seed in range(800):
        done, held = mixing.pivot(rows, random.Random(seed))
        assert len(done) == 30 - (held is not None)
        kept = sum(w for k, _, w in rows if done.get(k)) + (held[1] * held[2] if held else 0)
        assert abs(kept - whole) < 1e-6
        for k, x in done.items():
            total[k] += x
        if held:
            total[held[0]] += held[1]
    assert all(abs(t / 800 - p) < 0.07 for t, (_, p, _) in zip(total, rows))


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["word"] * rng.randrange(5, 60)), rng.choice(["Big", "big ", "BIG", "small-one"] if i % 9 == 0 else ["big"])) for i in range(900)] + [(5000, None, "big"), (None, "text", "big"), (5001, "", None)]
    documents = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("m", "big", 0.7, 1), ("m", "small_one", 0.2, 3), ("m", "absent", 0.1, 2), ("n", "big", 1.0, None), (None, "big", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    params = mixing.MixParams(group=50, fan=4)
    shares = {(r["mix"], r["source"]): r for r in mixing.mix_shares(documents, targets, params=params).collect()}
    assert abs(shares["m", "big"]["share"] - 7 / 9) < 0.01 and abs(shares["m", "small_one"]["share"] - 2 / 9) < 0.01 and shares["m", "absent"]["share"] == 0
    rows = mixing.select_mix(documents, targets, params=params).collect()
    assert max(r["copies"] for r in rows if r["source"] == "small_one") == 3 and max(r["copies"] for r in rows if r["source"] == "big") == 1
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.select_mix(documents.repartition(7), targets, params=params).collect()}
    assert sum(1 for r in rows if r["mix"] == "n") == shares["n", "big"]["documents"] == sum(1 for d in docs if d[0] is not None and d[1] and d[2] and d[2].strip().lower() == "big")
    assert mixing.select_mix(documents.limit(0), targets, params=params).count() == 0 and mixing.select_mix(documents, targets.limit(0), params=params).count() == 0


@pytest.mark.parametrize("small", [0, 100_000])
def test_no_task_gets_a_whole_source(spark, small):
    rows = spark.range(2000).select(F.lit("m").alias("mix"), F.lit("hot").alias("source"), "id")
    plan = spark.createDataFrame([("m", "hot", 20)], "mix string, source string, groups long")
    joined = rows.drop("mix").join(F.broadcast(plan) if small else plan.hint("merge"), "source").withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups")))
    sizes = mixing.grouped(joined).applyInPandas(lambda g: pd.DataFrame({"part": g["part"].iloc[:1], "n": [len(g)]}), "part long, n long")
    text = sizes._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(mix" in text and "part" in text.split("hashpartitioning(mix", 1)[1].split(")", 1)[0]
    assert sizes.count() == 20 and max(r["n"] for r in sizes.collect()) < 200


def test_truncated_texts(spark):
    rng = random.Random(8)
    nouns, verbs = ["cache", "parser", "index", "window", "planner", "ledger"], ["keeps", "drops", "reads", "merges"]
    say = lambda: rng.choice([f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} before the merge", f"One {rng.choice(nouns)} per package is enough because the old key was not stable", f"Call `run{rng.choice(nouns).title()}` before the {rng.choice(nouns)} starts"])
    rows, cut_ids = [], set()
    for i in range(1500):
        text = ". ".join(say() for _ in range(rng.randrange(1, 14))) + rng.choice([".", ".", ".", "", "!"])
        if len(text) > 400:
            text = text[:400]
            if not text.endswith((".", "!", "merge", "stable", "starts")):
                cut_ids.add(i)
        elif i % 25 == 0 and len(text) > 60:
            text = text[: len(text) * 2 // 3].rstrip(" .`") + rng.choice(["", "…", " [truncated]"])
            if text.rstrip("…").removesuffix(" [truncated]").endswith(("merge", "stable", "starts")):
                text = "The cache keeps the wind"
            cut_ids.add(i)
        rows.append((i, text, rng.choice(["wiki", "WIKI"]), "clash"))
    rows += [(9001, None, "wiki", ""), (9002, "", None, ""), (9003, "```\nx = 1\n```", "wiki", ""), (9004, "| a | b |", "wiki", ""), (None, "The cache ke", "wiki", "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, n string")
    got = {r["id"] for r in truncation.truncated(documents).collect()}
    assert len(got & cut_ids) >= 0.95 * len(cut_ids) and len(got - cut_ids) <= 0.03 * len(cut_ids) + 2
    rates = truncation.truncation_rates(documents).collect()
    assert {r["source"] for r in rates} == {"wiki", ""} and sum(r["truncated"] for r in rates) == len(got)
    assert truncation.truncated(documents.limit(0)).count() == 0


CODE = "import {{ {0} }} from './x';\n\n// Keeps what {0} needs.\nexport function {0}(a: string) {{\n  const {1} = load{2}(a);\n  if (!{1}) return null;\n  return {1}.map((x) => x + {3});\n}}\n"


def test_not_hand_written(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 11)))
    own = lambda n: "".join(CODE.format(name(), name(), name().title(), rng.randrange(99)) for _ in range(n))
    accessors = lambda: "".join(f"export function get{name().title()}{i}(m: Msg) {{\n  return m.fields[{i}];\n}}\n" for i in range(60))
    small = lambda: ";".join(f"var {rng.choice('abcdef')}=function({rng.choice('xyz')}){{return {rng.choice('xyz')}+{i}}}" for i in range(120))
    library = own(8)
    rows = [(f"r/src/{name()}.ts", own(rng.randrange(3, 9))) for _ in range(150)]
    hand = {p for p, _ in rows} | {"r/docs/a.md", "r/conf.json", "r/src/tool.ts", "r/build/step.ts"}
    rows += [("r/docs/a.md", "long " * 900), ("r/conf.json", '{"a": 1}'), ("r/src/tool.ts", own(3) + 'const B = "Code generated by x. DO NOT EDIT.";\n'), ("r/build/step.ts", "// The parts that used to be generated live elsewhere.\n" + own(4))]
    rows += [(f"r/src/{name()}.gen.ts", accessors()) for _ in range(12)] + [(f"r/src/{name()}.min.js", small()) for _ in range(12)]
    rows += [("r/src/plain.ts", accessors()), ("r/src/tight.js", small()), ("r/src/data.ts", "export const x = [\n" + "".join(f"  {rng.random()},\n" for _ in range(200)) + "];\n"), ("r/src/noted.ts", "// Code generated by toolx. DO NOT EDIT.\n" + own(4)), ("r/lib/copy.ts", "// here\n" + library), ("r/vendor/pack/a.ts", own(4)), ("r/pnpm-lock.yaml", None)]
    found = {p for p, _ in rows} - hand
    files = spark.createDataFrame([(p, t, "clash", "clash") for p, t in [*rows, (None, "x"), ("r/src/empty.ts", ""), rows[0]]], "path string, text string, label string, features string")
    upstream = spark.createDataFrame([(library,), (None,), ("",)], "text string")
    got = provenance.not_hand_written(files, upstream).collect()
    assert {r["path"] for r in got} == found and len(got) == len(found)
    reasons = {r["path"]: r["reason"] for r in got}
    assert reasons["r/src/plain.ts"] == reasons["r/src/tight.js"] == "forest" and reasons["r/lib/copy.ts"] == "upstream"
    assert provenance.not_hand_written(files.limit(0), upstream).count() == 0 and provenance.not_hand_written(files, upstream.limit(0)).count() == len(found) - 1


@pytest.mark.parametrize("lines", [5, 59, 61, 400])
def test_notices_and_licences_count_whatever_the_length_of_the_file(lines):
    code = [f"const a{i} = {i};" for i in range(lines)]
    assert provenance.notice_lines([*code, "// @generated by stubwright v2.14"]) == [lines]
    assert provenance.notice_lines([*code, "const B = 'Code generated by x. DO NOT EDIT.';"]) == []
    header = "/*\n" + "".join(f" Part {i} of the notes\n" for i in range(lines))
    assert provenance.third_party_place("r/vendor/a.ts", header + " Licensed under the X licence\n*/\n" + "\n".join(code))
    assert not provenance.third_party_place("r/vendor/a.ts", header + "*/\n" + "\n".join(code))


def test_limits_of_any_length_and_before_signs_of_any_length(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"The {rng.choice(['cache', 'parser', 'index'])} {rng.choice(['keeps', 'drops', 'reads'])} the old key." for _ in range(n))
    block = "```\n" + "x" * 98_000 + "\n```\n\n"
    rows = [(i, say(rng.randrange(4, 60)), rng.choice(["long", "sign"])) for i in range(400)]
    rows += [(1000 + i, (block + say(90))[:99_997] + " ke", "long") for i in range(12)]
    signs = ["…", "...", " …", " ...", "[…]", "[...]", " [truncated]", "… [truncated]", " (truncated)", " [cut off]", " <truncated>", " [snip]"]
    rows += [(2000 + i, say(30)[:700] + "ke" + sign, "sign") for i, sign in enumerate(signs)]
    got = {r["id"]: r["at_limit"] for r in truncation.scored(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(len(text) == 100_000 for i, text, _ in rows if 1000 <= i < 2000)
    assert {i for i, at in got.items() if at} >= {1000 + i for i in range(12)} | {2000 + i for i in range(len(signs))}
    assert sum(got.values()) <= 30


def test_copies_of_third_parties_count_by_all_different_shingles():
    theirs = [f"t{i}" for i in range(60)]
    patched = theirs[:]
    patched[0], patched[30] = "own", "own"
    padded = [*theirs, *["// same line of my own"] * 200]
    short = theirs[:14]
    short[0] = short[13] = "own"
    rows = {"whole": theirs, "patched": patched, "padded": padded, "short": short, "tiny": ["only", "six", "words", "of", "a", "file"], "own": theirs[:20] + [f"m{i}" for i in range(40)], "empty": []}
    batch = pa.RecordBatch.from_pydict({"path": list(rows), "text": pa.array([" ".join(w) for w in rows.values()], pa.string())})
    run = provenance._copied([" ".join(theirs), "only six words of a file"], provenance.ProvenanceParams())
    assert {p for b in run(iter([batch])) for p in b.column(0).to_pylist()} == {"whole", "patched", "padded", "short", "tiny"}
