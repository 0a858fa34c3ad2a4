"""Texts cut off by a field limit or on their way.

Two kinds of evidence meet in one posterior. Lengths: per source, a log-normal length distribution, right-censored at
candidate limits (lengths at which far more texts pile up than the distribution has), is fitted by maximum likelihood;
the share of a pile that the distribution doesn't explain is the censoring posterior of the texts in it. Endings: how
often the corpus ends a sentence, heading or item after such words, counted over all documents, and what is left open,
weighed by a logistic model. It is fitted to texts cut at random, to texts that stop after a complete unit, and by
expectation maximisation to documents as they are, of which an unknown share is cut.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrystone.session import staged


@dataclass(frozen=True)
class TruncationParams:
    """prior: share of cut texts among those at no limit, to begin with. pile: texts a limit has at least. excess: by how
    much they outnumber what the fitted distribution expects. sample: rows the ending model is fitted to at most (the
    counts it uses cover all documents). rounds: of expectation maximisation."""

    prior: float = 0.04
    pile: int = 8
    excess: float = 5.0
    sample: int = 24_000
    rounds: int = 6
    seed: int = 7


SIGN = re.compile(r"(?:\s*(?://|#|--|/\*|<!--)?\s*[\[(<{]?\s*(?:…|\.{3,})?\s*(?:text |output |message |content )?(?:truncated|cut off|more|continued|snip(?:ped)?|abridged)\s*(?:…|\.{3,})?[\])>}]?\s*(?:\*/|-->)?|\s*[\[(]?(?:…|\.{3,})[\])]?|�+)\s*$", re.I)
SIGN_END = re.compile(r"(?:truncated|cut off|more|continued|snip|snipped|abridged|…|\.{3}|�)[\s\])>}*/.…-]*$", re.I)
TOKEN = re.compile(r"`[^`\n]*`?|[\w.\-]*+/(?:[\w./\-]*[\w/\-])?|\w++(?:['’]\w+)*|[.!?。]+[\"'”’)\]]*\s+|[^\w\s]")
MARK = re.compile(r"^\s*(?:[-*+>]|#+|//+|--|\d+[.)]|\w+:(?=\s))\s+")
WORD = re.compile(r"^[^\W\d_]+(?:['’][^\W\d_]+)*$")
START = re.compile(r"\s*(?:(#{2,}\s)|([-*+]\s|\d+[.)]\s)|(\|)|((?:#|//+|--|>)\s))")
PARAGRAPH = re.compile(r"\n\s*\n")

PROSE, HEADING, ITEM, TABLE = range(4)


def token_class(token: str) -> str:
    """Words stay as they are, in lower case; names, paths and numbers are one class each; "" ends a sentence."""
    if token[-1].isspace():
        return ""
    if token[0] == "`":
        return "`path" if "/" in token else "`name"
    if "/" in token and len(token) > 1:
        return "/path" if re.search(r"\.\w{1,5}$", token) else "/part"
    if token[0].isdigit():
        return "0"
    if "_" in token or (not token.islower() and not token.isupper() and not token.istitle() and WORD.match(token)):
        return "name"
    return token.lower()


def blocks_of_lines(paragraph: str) -> list[tuple[int, str]]:
    """The lines of a paragraph by kind; lines that go on, also after the mark of a comment or quote, are one."""
    out: list[tuple[int, str]] = []
    mark = None
    for line in paragraph.splitlines():
        start = START.match(line)
        if start is None:
            if out and out[-1][0] in (PROSE, ITEM) and mark != "heading":
                out[-1] = (out[-1][0], out[-1][1] + " " + line)
            else:
                out.append((PROSE, line))
                mark = None
        elif start[4]:
            own = start[4].strip()
            if mark == own:
                out[-1] = (PROSE, out[-1][1] + " " + line[start.end() :])
            else:
                out.append((PROSE, line))
                mark = own
        else:
            out.append((HEADING if start[1] else ITEM if start[2] else TABLE, line))
            mark = "heading" if start[1] else None
    return out


def blocks(text: str) -> list[tuple[int, str]]:
    """Paragraphs, headings, items and rows outside code, by kind."""
    out = []
    for part in text.split("```")[::2]:
        for paragraph in PARAGRAPH.split(part):
            out.extend(blocks_of_lines(paragraph))
    return out


def tokens_of(block: str) -> list[str]:
    return TOKEN.findall(MARK.sub("", block) + "\n")


def units_of(kind: int, block: str) -> list[tuple[int, list[str], bool]]:
    """The sentences of a block: its kind, tokens, and whether a full stop or the like ends it."""
    out: list[tuple[int, list[str], bool]] = []
    unit: list[str] = []
    for token in tokens_of(block):
        if not token[-1].isspace():
            unit.append(token)
        elif unit:
            out.append((kind, unit, True))
            unit = []
    if unit:
        out.append((kind, unit, False))
    return out


KINDS = 7
OPEN = {",", ";", ":", "(", "[", "{", "|", "-", "–", "—", "=", "+", "'", '"', "«", "“"}
FLAGS = 8


class Hashes(dict):
    """64-bit hashes of token classes, remembered; 0 ends a sentence."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        name = token_class(token)
        value = self[token] = (xxhash.xxh64_intdigest(name) | 1) if name else 0
        return value


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def contexts(hashes: np.ndarray, starts: np.ndarray, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What the chance of an end is looked up by, for the tokens at ``place`` as if each were the last of its unit, which
    starts at ``starts``: a row of KINDS numbers, multiples of 4. They stand for the last one, two and three tokens; the
    first two with the number of tokens; the first two with the last; the number of tokens, and that with the last."""
    kind, index = kind.astype(np.uint64), place - starts
    count = np.minimum(index, 60).astype(np.uint64)
    last = hashes[place]
    before = np.where(index > 0, hashes[np.maximum(place - 1, 0)], np.uint64(1))
    third = np.where(index > 1, hashes[np.maximum(place - 2, 0)], np.uint64(2))
    first = _mixed(hashes[starts], np.where(index > 0, hashes[np.minimum(starts + 1, len(hashes) - 1)], np.uint64(3)))
    one = _mixed(last, kind + np.uint64(11))
    two = _mixed(before, one)
    out = np.empty((len(place), KINDS), np.uint64)
    out[:, 0] = one
    out[:, 1] = _mixed(two, 15)
    out[:, 2] = _mixed(_mixed(third, two), 16)
    out[:, 3] = _mixed(_mixed(first, count), kind + np.uint64(17))
    out[:, 4] = _mixed(_mixed(first, last), kind + np.uint64(21))
    out[:, 5] = _mixed(count, kind + np.uint64(25))
    out[:, 6] = _mixed(_mixed(last, count), kind + np.uint64(29))
    return (out & np.uint64(0xFFFFFFFFFFFFFFFC)).view(np.int64)


def tail(body: str) -> str:
    """The last paragraph of a text outside code, in which its last unit is."""
    at = body.rfind("\n\n")
    last = body[at:] if at >= 0 else body
    return last if "```" not in last and last.strip() else body


def without_sign(text: str) -> tuple[str, bool, bool]:
    """A text without the sign of a cut, whether it had one, and whether it ends in a broken character."""
    body, signed = text.rstrip(), False
    lost = body.endswith("�")
    while body and SIGN_END.search(body, max(0, len(body) - 60)):
        line = max(body.rfind("\n") + 1, 0)
        sign = SIGN.search(body, line)
        if not sign:
            break
        cut = body[: sign.start()].rstrip()
        if not cut or cut == body:
            break
        body, signed = cut, True
    return body, signed, lost


def last_unit(body: str) -> dict:
    """How a text without a sign ends: kind and tokens of its last unit (none if it is known to end), whether it is
    ``whole`` for sure, and flags for what is left open."""
    fence = body.count("```") % 2 == 1
    line = body[body.rfind("\n") + 1 :]
    paragraph = body[body.rfind("\n\n") + 1 :]
    quote = line.replace("```", "").count("`") % 2 == 1
    bracket = paragraph.count("(") - len(re.findall(r"(?<![:;])\)", paragraph)) > 0
    closed = body.endswith("```") and not fence
    found = [] if fence or closed else [x for x in blocks(tail(body)) if x[1].strip()]
    kind, tokens, known = (units_of(*found[-1]) or [(PROSE, [], True)])[-1] if found else (PROSE, [], True)
    if kind == TABLE:
        known = line.rstrip().endswith("|") and len(line.strip()) > 1
    if known or closed:
        tokens = []
    word = tokens[-1] if tokens else ""
    flags = [fence, quote, bracket, kind == TABLE and not known, word in OPEN, token_class(word) == "/part" if word else False, kind == HEADING, kind == ITEM]
    return {"kind": kind, "tokens": tokens, "whole": not tokens and not fence, "flags": flags}


NOTHING = {"kind": PROSE, "tokens": [], "whole": True, "flags": [False] * FLAGS}


def _tally(flat: list[int], sizes: list[int], kinds: list[int], final: list[bool]) -> pa.RecordBatch:
    """Counts of the contexts of some blocks of tokens; where a ``final`` one stops is left out."""
    hashes, size = np.array(flat, np.uint64), np.array(sizes, np.int64)
    block = np.repeat(np.arange(len(size)), size)
    opens = np.zeros(len(hashes), bool)
    opens[np.cumsum(size) - size] = True
    stop = hashes == 0
    opens[1:] |= stop[:-1]
    starts = np.maximum.accumulate(np.where(opens, np.arange(len(hashes)), 0))
    place = np.flatnonzero(~stop)
    following = np.append(block[1:] != block[:-1], True)  # the last of its block
    state = np.where(np.append(stop[1:], False) & ~following, 1, np.where(following, np.where(np.array(final)[block], 2, 1), 0))
    found = contexts(hashes, starts[place], np.array(kinds)[block[place]], place) | state[place, None]
    keys = np.sort(found.ravel())  # what they are in the upper bits, whether they end in the lower two
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n, keys = np.diff(np.append(first, len(keys))), keys[first]
    what = keys & 3
    n, keys, what = n[what < 2], keys[what < 2], what[what < 2]
    return pa.RecordBatch.from_pydict({"context": pa.array(keys & ~3), "n": pa.array(n), "ends": pa.array(np.where(what == 1, n, 0))})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(context, n, ends)``: occurrences, but where a text stops without a full stop or the like, and ends among them."""
    of = Hashes().__getitem__
    flat: list[int] = []
    sizes: list[int] = []
    kinds: list[int] = []
    final: list[bool] = []
    for batch in batches:
        for text in batch.column(0).to_pylist():
            body = without_sign(text)[0] if text else ""
            known = body.endswith("```")
            for kind, block in blocks(body):
                hashes = list(map(of, tokens_of(block)))
                if hashes:
                    flat.extend(hashes)
                    sizes.append(len(hashes))
                    kinds.append(kind)
                    final.append(False)
            if final and not known and body:
                final[-1] = True
            if len(flat) > 400_000:
                yield _tally(flat, sizes, kinds, final)
                for x in (flat, sizes, kinds, final):
                    x.clear()
    if flat:
        yield _tally(flat, sizes, kinds, final)


def _lasts(seed: int, share: float, key_type: pa.DataType):
    """How every document ends (made 0) and, for a share of them, how it would if it stopped after a complete unit (1)
    and where it is cut at random (2)."""
    threshold = int(share * 2**32)
    types = [key_type, pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int64())]
    names = ["id", "row", "source", "made", "chosen", "base", "total", "signed", "lost", "whole", "own", "flags", "contexts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hashes().__getitem__
        for batch in batches:
            rows: list[tuple] = []
            flat: list[int] = []
            sizes: list[int] = []
            kinds: list[int] = []

            def add(head: tuple, last: dict) -> None:
                flat.extend(map(of, last["tokens"]))
                sizes.append(len(last["tokens"]))
                kinds.append(last["kind"])
                rows.append((*head, [float(x) for x in last["flags"]]))

            for ident, row, text, source in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    add((ident, row, source, 0, False, 0, 0, False, False, True, False), NOTHING)
                    continue
                chance = random.Random(f"{seed} {row}")
                chosen = chance.getrandbits(32) < threshold
                body, signed, lost = without_sign(text)
                last = last_unit(body)
                add((ident, row, source, 0, chosen, len(body), len(text), signed, lost, last["whole"], False), last)
                if not chosen:
                    continue
                found = blocks(body)
                if found:
                    kind, block = chance.choices(found, [len(x) for _, x in found])[0]
                    inner = [tokens for _, tokens, known in units_of(kind, block) if len(tokens) > 1 and (known or block is not found[-1][1])]
                    if inner and kind != TABLE:
                        tokens = chance.choice(inner)
                        add((ident, row, source, 1, True, 0, 0, False, False, False, True), {"kind": kind, "tokens": tokens, "flags": [*[False] * 6, kind == HEADING, kind == ITEM]})
                if len(body) > 40:
                    at = chance.randrange(20, len(body))
                    cut = last_unit(body[:at].rstrip())
                    if not cut["whole"]:
                        full = not (body[at].isalnum() and body[at - 1].isalnum())
                        add((ident, row, source, 2, True, 0, 0, False, False, False, full), cut)
            size = np.array(sizes, np.int64)
            some, to = size > 0, np.cumsum(size)
            found = contexts(np.array(flat, np.uint64), (to - size)[some], np.array(kinds)[some], to[some] - 1) if flat else np.zeros((0, KINDS), np.int64)
            looked = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some) * KINDS), pa.int32()), pa.array(found.ravel()))
            columns = list(zip(*rows)) or [[]] * (len(types) - 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), looked], names=names)

    return run


def feature_matrix(counts: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Columns for the logistic model. counts: rows x KINDS x (n, ends, lasts).

    The chance of an end after rare contexts is filled up from that after more common ones they contain.
    """
    ends = counts[..., 1] + counts[..., 2]  # most texts are whole, and cuts seldom stop after the same words
    n = counts[..., 0] + counts[..., 2]
    some = (n.sum(axis=1) > 0).astype(float)

    def chance(i: int, before: np.ndarray) -> np.ndarray:
        return (ends[:, i] + before) / (n[:, i] + 1)

    size = chance(5, np.full(len(n), 0.1))
    last = chance(0, size)
    run = chance(2, chance(1, last))
    counted = chance(6, last)
    opening, both = chance(3, size), chance(4, counted)
    odds = [np.log(p / (1 - p)) for p in (np.clip(x, 1e-4, 1 - 1e-4) for x in (size, last, run, counted, opening, both))]
    return np.column_stack([*odds, (n[:, 0] == 0) * some, np.log1p(n[:, 0]), some, flags]).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by Newton's method, with the mean and scale of each column; labels may lie between 0 and 1."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + offset, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def linear(x: np.ndarray, weights: tuple) -> np.ndarray:
    w, mean, scale = weights
    return w[0] + ((x - mean) / scale) @ w[1:]


def fit_endings(x: np.ndarray, made: np.ndarray, params: TruncationParams) -> tuple[tuple, float]:
    """Weights and the share of cut texts, from texts that were made whole (1) or cut (2) and from real ones (0) of which
    each is cut with a chance that is estimated in turn with the weights."""
    y = (made == 2).astype(float)
    real = made == 0
    # artificial rows weigh in with their own odds
    odds = np.log(max((made == 2).sum(), 1) / max((made == 1).sum(), 1))
    prior, weights = params.prior, fit_logistic(x[~real], y[~real], odds)
    for _ in range(params.rounds if real.any() else 0):
        y[real] = 1 / (1 + np.exp(-np.clip(linear(x[real], weights) + np.log(prior / (1 - prior)), -30, 30)))
        prior = float(np.clip(y[real].mean(), 1e-3, 0.5))
        weights = fit_logistic(x, y, np.where(real, np.log(prior / (1 - prior)), odds))
    return weights, prior


def log_normal_tail(z: np.ndarray) -> np.ndarray:
    """log P(Z > z) of the standard normal."""
    from math import erfc

    return np.log(np.maximum(np.vectorize(erfc, otypes=[float])(z / 2**0.5) / 2, 1e-300))


def fit_censored(lengths: np.ndarray, n: np.ndarray, limits: list[int]) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood, where lengths in ``limits`` are only known to be at least
    that long (expectation maximisation with the moments of the truncated normal)."""
    x, w = np.log(np.maximum(lengths, 1).astype(float)), n.astype(float)
    censored = np.isin(lengths, limits)
    mu, sigma = np.average(x, weights=w), max(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)), 0.05)
    for _ in range(200):
        a = (x[censored] - mu) / sigma
        hazard = np.exp(-(a**2) / 2 - 0.5 * np.log(2 * np.pi) - log_normal_tail(a)) if len(a) else a
        first, second = x.copy(), x**2
        first[censored] = mu + sigma * hazard
        second[censored] = mu**2 + sigma**2 + sigma * (x[censored] + mu) * hazard
        new = np.average(first, weights=w)
        spread = max(np.sqrt(max(np.average(second, weights=w) - new**2, 1e-6)), 0.05)
        moved, mu, sigma = abs(new - mu) + abs(spread - sigma), new, spread
        if moved < 1e-7:
            break
    return mu, sigma


def source_limits(hist: pd.DataFrame, params: TruncationParams) -> pd.DataFrame:
    """``(key, limit, posterior)`` of one source from its ``(total, before, n)``: piles that the fitted distribution can't
    explain. A text is in the pile of its length and, if it has the sign of a cut, in that of its length before it too."""
    key = hist["key"].iloc[0]
    total, before, texts = (hist[c].to_numpy() for c in ("total", "before", "n"))
    signed = before != total
    lengths, place = np.unique(np.concatenate([total, before[signed]]), return_inverse=True)
    n = np.bincount(place, np.concatenate([texts, texts[signed]]))
    limits, posterior = [], {}
    for _ in range(4):
        mu, sigma = fit_censored(np.where(np.isin(before, limits), before, total), texts, limits)
        x = np.log(np.maximum(lengths, 1).astype(float))
        expected = texts.sum() * np.exp(-((x - mu) ** 2) / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi)) / np.maximum(lengths, 1)
        near = np.array([n[(np.abs(lengths - v) <= 25) & (lengths != v)].sum() / 50 for v in lengths[n >= params.pile]])
        heavy = lengths[n >= params.pile]
        usual = np.maximum(expected[n >= params.pile], near)
        chosen = n[n >= params.pile] > params.excess * usual + 3
        posterior = {int(v): float(1 - u / m) for v, u, m in zip(heavy[chosen], usual[chosen], n[n >= params.pile][chosen])}
        if sorted(posterior) == sorted(limits):
            break
        limits = sorted(posterior)
    return pd.DataFrame({"key": pd.Series([key] * len(posterior), dtype=object), "limit": np.array(list(posterior), np.int64), "posterior": np.array(list(posterior.values()), float)})


def source_key(column) -> F.Column:
    """Spellings of a source that differ in case, spaces and dashes are one source."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def scored(documents: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", params: TruncationParams = TruncationParams()) -> DataFrame:
    """``(id, key, posterior, signed, at_limit)`` of every document with an id.

    A null or empty text is whole (posterior 0). A null source is the source "". Equal rows are judged alike and each
    have a row. Other columns are not read.
    """
    rows = documents.select(F.col(ident).alias("id"), F.xxhash64(ident, text, source).alias("row"), F.col(text).alias("text"), F.coalesce(source_key(F.col(source)), F.lit("")).alias("source")).where("id is not null")
    total = rows.count()
    kind = rows.schema["id"].dataType
    shape = f"id {kind.simpleString()}, row long, source string, made int, chosen boolean, base long, total long, signed boolean, lost boolean, whole boolean, own boolean, flags array<double>, contexts array<long>"
    share = min(1.0, params.sample / 3 / max(total, 1))
    lasts = staged(rows.mapInArrow(_lasts(params.seed, share, to_arrow_type(kind)), shape), "lasts")
    real = lasts.where("made = 0")
    # limits: piles at the length of the text or of what is before the sign of a cut
    before = F.when(F.col("signed"), F.col("base")).otherwise(F.col("total"))
    hist = real.groupBy(F.col("source").alias("key"), "total", before.alias("before")).agg(F.count("*").alias("n"))
    limits = staged(hist.groupBy("key").applyInPandas(lambda h: source_limits(h, params), "key string, limit long, posterior double"), "limits")
    near = real.select("row", F.col("source").alias("key"), F.explode(F.array_distinct(F.array("base", "total"))).alias("limit"))
    piled = near.join(limits, ["key", "limit"]).groupBy("row").agg(F.max("posterior").alias("piled"))
    # evidence of the endings that are not whole for sure; contexts are counted over all documents, those where a text
    # stops apart, and only of texts with neither the sign nor the length of a cut
    ends = lasts.where("not whole and not lost").dropDuplicates(["row", "made"]).join(piled, "row", "left").withColumn("own", F.when(F.col("made") == 0, ~F.col("signed") & F.col("piled").isNull()).otherwise(F.col("own")))
    looked = ends.select("row", "made", "own", F.posexplode("contexts").alias("pos", "context"))
    stops = looked.where("made = 0 and own").select("context", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("ends"), F.lit(1).cast("long").alias("lasts"))
    passed = rows.select("text").mapInArrow(_counts, "context long, n long, ends long").select("context", "n", "ends", F.lit(0).cast("long").alias("lasts"))
    counted = passed.union(stops).groupBy("context").agg(*(F.sum(c).alias(c) for c in ("n", "ends", "lasts")))
    count = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ends", "lasts")))
    found = looked.join(counted, "context", "left").groupBy("row", "made").agg(*(F.max(F.when(F.col("pos") == i, count)).alias(f"c{i}") for i in range(KINDS)))
    evidence = staged(ends.select("row", "made", "chosen", "signed", "own", "piled", "flags").join(found, ["row", "made"], "left"), "evidence")
    flat = [F.coalesce(F.col(f"c{i}")[c], F.lit(0)).cast("double") for i in range(KINDS) for c in ("n", "ends", "lasts")]
    columns = evidence.select("row", "made", "chosen", "signed", "own", "piled", "flags", F.array(*flat).alias("counts"))
    sample = columns.where("chosen and not signed and (made > 0 or piled is null)").orderBy(F.xxhash64("row"), "made").limit(params.sample).select("made", "own", "flags", "counts").toPandas()
    weights, prior = None, params.prior
    made = sample["made"].to_numpy()
    if (made == 1).any() and (made == 2).any():
        weights, prior = fit_endings(features(sample["counts"], sample["flags"], made, sample["own"].to_numpy(bool)), made, params)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if weights is not None and batch.num_rows:
                score = linear(features(batch.column(1).to_pylist(), batch.column(2).to_pylist(), np.zeros(batch.num_rows, int), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    judged = columns.where("made = 0").select("row", "counts", "flags", "own").mapInArrow(judge, "row long, score double")
    joined = real.join(judged, "row", "left").join(piled, "row", "left")
    likely = F.greatest(F.coalesce("piled", F.lit(0.0)), F.lit(prior))
    likely = F.least(F.when(F.col("signed"), F.greatest(likely, F.lit(0.5))).otherwise(likely), F.lit(0.98))
    ending = F.when(F.col("lost"), F.lit(12.0)).when(F.col("whole"), F.lit(-12.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    return joined.select("id", F.col("source").alias("key"), (1 / (1 + F.exp(-(ending + F.log(likely / (1 - likely)))))).alias("posterior"), "signed", F.col("piled").isNotNull().alias("at_limit"))


def features(counts, flags, made: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The matrix of some rows, each without what it adds to the counts itself."""
    c = np.array(list(counts), float).reshape(len(made), KINDS, 3)
    c[(made == 0) & own, :, 2] = np.maximum(c[(made == 0) & own, :, 2] - 1, 0)
    c[(made > 0) & own, :, 0] = np.maximum(c[(made > 0) & own, :, 0] - 1, 0)
    c[made == 1, :, 1] = np.maximum(c[made == 1, :, 1] - 1, 0)
    c[..., 1] = np.minimum(c[..., 1], c[..., 0])
    return feature_matrix(c, np.array(list(flags), float).reshape(len(made), FLAGS))


def truncated(documents: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", params: TruncationParams = TruncationParams()) -> DataFrame:
    """``id`` of the documents that were more likely cut than not, once each."""
    return scored(documents, ident, text, source, params).where("posterior > 0.5").select("id").distinct()


def truncation_rates(documents: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", params: TruncationParams = TruncationParams()) -> DataFrame:
    """``(source, documents, truncated, rate, at_limit)`` of each source, whatever its spelling."""
    found = scored(documents, ident, text, source, params)
    cut = (F.col("posterior") > 0.5).cast("long")
    return found.groupBy(F.col("key").alias("source")).agg(F.count("*").alias("documents"), F.sum(cut).alias("truncated"), F.round(F.avg(cut), 6).alias("rate"), F.sum(F.col("at_limit").cast("long")).alias("at_limit"))
