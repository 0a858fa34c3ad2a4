"""Evaluation texts that leaked into documents: pigeonhole search for pieces, verified by bit-parallel edit distance.

Texts are compared as sequences of words without case, punctuation, markup, escapes and line prefixes. A passage counts
if it has at least half of an item's words, in order, with at most one word in eight altered. A passage of L words with
at most L / 8 alterations, cut into pieces, has a piece without any: items are cut into pieces so short that every such
passage contains more whole pieces than alterations. Documents are searched for all pieces at once, and what lies
around a hit is verified by Myers' bit-parallel distance over words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LeakParams:
    """part: least share of an item's words in a passage. budget: one altered word in so many. block: items that are
    searched for in one pass over the documents; more take more passes."""

    part: float = 0.5
    budget: int = 8
    block: int = 20_000


PREFIX = re.compile(r"^[ \t]*(?:(?:>|//+|/?\*+(?!\*)|#+|--+|;+|%+|\||[-+•](?=\s)|\d{1,6}[.):|](?=\s)|\d{1,6}\t|\d{1,2}:\d{2}(?::\d{2})?(?=\s)|@@|\w{1,12}:(?=\s))[ \t]*)+", re.M)
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--|-->")
LINK = re.compile(r"\]\((?:[^()\s]{1,300})\)")
BREAK = re.compile(r"[^\w./\\:'’`*_~@$#%&+\-]+|:(?=\W|$)|[\s:]+(?=$)")
GAP = re.compile(r"[\s|,;()\"“”„«»‘!?<>=\[\]{}—–…]+")
KEEP = re.compile(r"[^\w]|_")


def words(text: str) -> list[str]:
    """The words of a text; what has neither letters nor digits is none."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
        text = re.sub(r"\\[nrt](?![a-z]*[/\\])", "\n", text)
    if "%" in text:
        text = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "ignore"), text)
    text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    text = LINK.sub("]", TAG.sub(" ", PREFIX.sub("", text)))
    return [w for part in GAP.split(text.lower()) if (w := KEEP.sub("", part))]


def piece_length(n: int, params: LeakParams) -> int:
    """Words of a piece for an item of n words: so that the shortest passage that counts contains more whole pieces
    than it may have alterations, wherever it starts."""
    least = max(1, -(-n * params.part // 1).__int__())
    m = 1
    for size in range(2, least + 1):
        # a passage of L >= least words contains at least (L - size + 1) // size whole pieces
        if all((length - size + 1) // size > length // params.budget for length in range(least, n + 1)):
            m = size
    return m


def within(pattern: list[str], text: list[str], k: int) -> bool:
    """Whether a part of ``text`` is at most k insertions, deletions and replacements of words away from ``pattern``."""
    m = len(pattern)
    if m <= k:
        return True
    places: dict[str, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for w in text:
        eq = places.get(w, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | ~(d | plus) & full, plus & d
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        if score <= k:
            return True
        up, down = (up << 1) & full, (down << 1) & full  # a match may start anywhere: no one is shifted in
        plus, minus = down | ~(x | up) & full, up & x
    return False


class Items:
    """Items ready to be searched for in many documents."""

    def __init__(self, items: list[tuple[int, str]], params: LeakParams):
        import ahocorasick

        self.params, self.words = params, {}
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            self.words[item] = w
            size = piece_length(len(w), params)
            for i in range(0, len(w) - size + 1, size):
                pieces.setdefault(" " + " ".join(w[i : i + size]) + " ", []).append((item, i, size))
        self.finder = ahocorasick.Automaton() if pieces else None
        if pieces:
            for piece, owners in pieces.items():
                self.finder.add_word(piece, (piece.count(" ") - 1, owners))
            self.finder.make_automaton()

    def found(self, text: str) -> list[int]:
        """The items that a text has a passage of."""
        doc = words(text) if self.finder is not None else []
        if not doc:
            return []
        joined = " " + " ".join(doc) + " "
        hits: dict[int, set[int]] = {}
        starts, count, at = None, 0, 0
        for end, (size, owners) in self.finder.iter(joined):
            count += joined.count(" ", at, end)  # spaces before this one: the number of the word after the hit
            at = end
            for item, i, _ in owners:
                hits.setdefault(item, set()).add(count - size - i)  # where the item would start in the document
        return [item for item, places in hits.items() if self.verify(self.words[item], doc, sorted(places))]

    def verify(self, item: list[str], doc: list[str], places: list[int]) -> bool:
        n, p = len(item), self.params
        least = max(1, -int(-n * p.part // 1))
        done = None
        for place in places:
            if done is not None and place - done <= 2:
                continue  # the last region covers this one
            done = place
            slack = n // p.budget + 3
            low, high = max(0, place - slack), min(len(doc), place + n + slack)
            region = doc[low:high]
            if len(region) < least - least // p.budget:
                continue
            pool: dict[str, int] = {}
            for w in region:
                pool[w] = pool.get(w, 0) + 1
            here = [pool.get(w, 0) > 0 for w in item]
            ahead = [0]
            for x in here:
                ahead.append(ahead[-1] + x)
            # a passage within its budget has shorter ones within the same: the least length of each budget finds them all
            for length in (least, *range((least // p.budget + 1) * p.budget, n + 1, p.budget)):
                k = length // p.budget
                for s in range(n - length + 1):
                    if ahead[s + length] - ahead[s] >= length - k and within(item[s : s + length], region, k):
                        return True
        return False


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", params: LeakParams = LeakParams()) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds a passage of an item.

    Items are taken in blocks of at most ``block``, so that what is sent to the executors has a bound whatever their
    number; documents are never shuffled. Null and empty texts and null ids hold and give away nothing; a repeated
    document or item row gives its pair once. Other columns are not read.
    """
    named = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    docs = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and length(text) > 0")
    blocks = -(-named.count() // params.block)
    id_types = docs.schema["doc_id"].dataType.simpleString(), named.schema["item_id"].dataType.simpleString()
    result = None
    for number in range(max(blocks, 1)):
        part = named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number) if blocks > 1 else named
        rows = [(r["item_id"], r["text"]) for r in part.collect()]
        held = documents.sparkSession.sparkContext.broadcast(rows)  # at most ``block`` items, once for each executor
        found = docs.mapInArrow(_search(held, params), f"doc_id {id_types[0]}, item_id {id_types[1]}")
        result = found if result is None else result.union(found)
    return result.distinct()


_READY: dict[int, Items] = {}


def _search(held, params: LeakParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        ready = ready_items(rows, params)
        kind = pa.array([r[0] for r in rows]).type if rows else pa.int64()
        for batch in batches:
            docs, items = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item in ready.found(text):
                    docs.append(doc)
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(items, kind)], names=["doc_id", "item_id"])

    return run


def ready_items(rows: list[tuple], params: LeakParams) -> Items:
    """The automaton of some items, built once in a worker; only the last block's is kept."""
    key = hash((params, tuple(rows)))
    if key not in _READY:
        _READY.clear()
        _READY[key] = Items(rows, params)
    return _READY[key]


def leak_report(found: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """``(item_id, documents)`` of every item that leaked."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select(F.col(item).alias("item_id")).distinct().join(counts, "item_id").select("item_id", "documents")
