"""Files that nobody wrote by hand: output of programs, minified code, third-party copies, and data saved as code.

A random forest judges the body of each file by its compression ratio, token entropy, identifier lengths, comment
density and the like. It learns from labels that its features don't contain: notices in comments, names that
build tools give, and bodies that are literals throughout; the notices are cut out before features are taken. What a
notice, a name, a third party's folder or a third party's text says for itself counts beside the forest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import staged


@dataclass(frozen=True)
class ProvenanceParams:
    """doubt: unlabelled code files to which a first forest gives this probability are no negatives for the second one,
    as many of them only lack a label. threshold: of the second forest's probability. sample: labelled rows the forest is fitted to at most. similarity: share of a file's five-word shingles that a
    third party's file has. literal: share of a code file's characters in literals from which it consists of data.
    block: third-party files that are compared in one pass."""

    doubt: float = 0.12
    threshold: float = 0.7
    sample: int = 12_000
    trees: int = 40
    depth: int = 7
    similarity: float = 0.8
    words: int = 5
    literal: float = 0.9
    block: int = 2_000
    seed: int = 5


# File suffixes by kind of content.
CODE = frozenset("ts tsx js jsx mjs cjs py go rs java kt kts scala groovy cs vb php rb swift lua c cc cpp cxx h hpp".split())
SETTINGS = frozenset("json yaml yml toml xml ini lock sum".split())
# Names that tools write, and folders for others' code.
BUILT_NAME = re.compile(r"(?:\.(?:min|bundle|chunk|gen|generated|g|designer|pb|[0-9a-f]{8,20})\.\w{1,5}|_pb2(?:_grpc)?\.pyi?|_pb\.[jt]s|-all\.js|OuterClass\.java|_(?:gen|generated|string|deepcopy)\.go|\.g\.dart|\.map)$", re.I)
BUILT_START = re.compile(r"^zz_")
LOCK_NAME = re.compile(r"^(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.ya?ml|yarn\.lock|bun\.lockb?|cargo\.lock|poetry\.lock|pipfile\.lock|uv\.lock|gemfile\.lock|composer\.lock|go\.sum|flake\.lock)$", re.I)
OTHERS = frozenset("vendor vendored third_party third-party thirdparty 3rdparty deps external externals node_modules pods bower_components".split())

COMMENT = re.compile(r"^\s*(?://+|#+(?!!)|/\*+|\*+/?|<!--|--|;+|\"\"\"|''')\s?(.*?)\s*(?:\*/|-->)?\s*$")
NOTICE = re.compile(
    r"@generated\b(?! ids)|<auto-?generated|auto-?generated(?: file|\b[,:. ]|$)|\b(?:code|file|source|module) (?:is |was )?(?:automatically |auto-?)?generated (?:by|from|with|using)|"
    r"\b(?:automatically|machine)[ -](?:created|written|generated|produced|made)\b|\b(?:produced|generated|built|emitted|compiled|rendered) (?:by|with) \S+ (?:from|out of)\b|do not (?:modify|edit)(?: by hand| this file|\W*$|:)|"
    r"\b(?:changes|edits) (?:are|will be) (?:overwritten|lost)|automatisch (?:von|mit|durch|erzeugt)|\brebuilt from\b|g[ée]n[ée]r[ée] automatiquement|generado autom[áa]ticamente",
    re.I,
)
NO_NOTICE = re.compile(r"maintained by hand|used to be|no longer|not generated|reads what|order of the|ids are never|first written|by hand if", re.I)
LICENCE = re.compile(r"released under (?:its|their) own licen[cs]e|\bcopyright\b.{0,20}\bauthors\b|licensed under the|SPDX-License-Identifier|@license\b", re.I)
BANNER = re.compile(r"^\s*/\*!?\s*[\w./@-]+\s+v?\d+\.\d+[\w.-]*")
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|0[xX][0-9A-Fa-f]+|\d[\d_.]*(?:[eE][+-]?\d+)?|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[^\w\s]")
BLOCK = re.compile(r"^[ \t]*(?:/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z))", re.M | re.S)
LINE_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|pragma)|\*|/\*|\*/|--|<!--)")


def notice_lines(lines: list[str]) -> list[int]:
    """Lines, wherever they are, that are comments and say that a program wrote the file."""
    found = []
    for i, line in enumerate(lines):
        comment = COMMENT.match(line)
        if comment and NOTICE.search(comment[1]) and not NO_NOTICE.search(comment[1]):
            found.append(i)
    return found


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def licensed(text: str) -> bool:
    """Whether a comment, wherever it is and however long, names a licence."""
    return any(LICENCE.search(m[0]) for m in BLOCK.finditer(text)) or any(LICENCE.search(x) for x in text.splitlines() if COMMENT.match(x))


def third_party_place(path: str, text: str) -> bool:
    """In a package's folder below a folder for others' code (a file directly in such a folder needs a licence too)."""
    parts = path.split("/")
    at = next((i for i, p in enumerate(parts[:-1]) if i and p.lower() in OTHERS), None)
    return at is not None and (at < len(parts) - 2 or licensed(text))


def ratio(raw: bytes, window: int = 2048) -> float:
    """Compressed size as a share of the size, over windows, so that it doesn't fall with the length of the file."""
    if not raw:
        return 1.0
    cuts = range(0, max(len(raw) - window // 2, 1), window)
    return sum(len(zlib.compress(raw[i : i + window], 6)) for i in cuts) / min(len(raw), len(cuts) * window)


def entropies(tokens: list[str], window: int = 256) -> tuple[float, float]:
    """Entropy of the tokens as a share of the largest possible, and share of different ones, over windows."""
    entropy = different = count = 0.0
    for i in range(0, max(len(tokens) - window // 2, 1), window):
        part = tokens[i : i + window]
        if len(part) > 1:
            counts = Counter(part)
            entropy -= sum(c / len(part) * math.log2(c / len(part)) for c in counts.values()) / math.log2(len(part))
            different += len(counts) / len(part)
            count += 1
    return (entropy / count, different / count) if count else (1.0, 1.0)


def repetition(shapes: list[str], window: int = 40) -> tuple[float, float]:
    """Share of lines whose shape occurs more than twice, and of different shapes, over windows."""
    same = different = count = 0.0
    for i in range(0, max(len(shapes) - window // 2, 1), window):
        part = shapes[i : i + window]
        if part:
            counts = Counter(part)
            same += sum(c for c in counts.values() if c > 2) / len(part)
            different += len(counts) / len(part)
            count += 1
    return (same / count, different / count) if count else (0.0, 1.0)


def features(lines: list[str], kind: int) -> tuple[list[float], float]:
    """What the forest sees of a body, and the share of its characters that are in literals."""
    text = "\n".join(lines)
    raw = text.encode("utf-8", "surrogatepass")
    comments = sum(1 for x in lines if LINE_COMMENT.match(x))
    filled = [x for x in lines if x.strip()]
    body = "\n".join(x for x in filled if not LINE_COMMENT.match(x))
    tokens = TOKEN.findall(body)
    words = [t for t in tokens if t[0].isalpha() or t[0] in "_$"]
    entropy, different = entropies(tokens)
    solid = max(sum(len(t) for t in tokens), 1)
    literal = sum(len(t) for t in tokens if t[0].isdigit() or (t[0] in "\"'`" and len(t) > 1))
    marks = sum(len(t) for t in tokens if len(t) == 1 and not t.isalnum() and t not in "_$")
    same, different_shapes = repetition([re.sub(r"\w+", "x", x) for x in filled])
    kinds = set(words)
    return [
        ratio(raw),
        entropy,
        different,
        sum(map(len, words)) / max(len(words), 1),
        sum(len(w) <= 2 for w in words) / max(len(words), 1),
        sum(map(len, kinds)) / max(len(kinds), 1),
        comments / max(len(filled), 1),
        len(text) / max(len(filled), 1),
        sum(c.isspace() for c in text) / max(len(text), 1),
        sum(c.isdigit() for c in text) / max(len(text), 1),
        same,
        different_shapes,
        float(kind == 0),
        float(kind == 1),
    ], (literal + marks) / solid if literal else 0.0


def shingles(text: str, words: int) -> list[str]:
    found = re.findall(r"\w+", text)
    return [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])


def _study(params: ProvenanceParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = path.replace("\\", "/")
                name, text = place.rsplit("/", 1)[-1], text or ""
                lines = text.splitlines()
                kind = 0 if suffix(place) in CODE else 1 if suffix(place) in SETTINGS else 2
                notices = notice_lines(lines) if kind < 2 else []
                named = bool(BUILT_NAME.search(name) or BUILT_START.match(name) or LOCK_NAME.match(name))
                for i in reversed(notices):
                    del lines[i]
                while lines and (not lines[0].strip() or BANNER.match(lines[0]) or (COMMENT.match(lines[0]) and LICENCE.search(lines[0]))):
                    del lines[0]
                values, literal = features(lines, kind)
                data = kind == 0 and literal >= params.literal and len(text) >= 200
                reason = "notice" if notices else "name" if named else "data" if data else "third party" if kind == 0 and third_party_place(place, text) else None
                rows.append((path, reason, bool(notices or named or data), kind == 0, values))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.float64())])], names=["path", "reason", "label", "code", "features"])

    return run


_OWNERS: dict[int, dict[str, list[int]]] = {}


def shingle_owners(upstream: list[str], words: int) -> dict[str, list[int]]:
    """The third-party texts that have each shingle, built once in a worker; only the last block's are kept."""
    key = hash((words, tuple(upstream)))
    if key not in _OWNERS:
        owners: dict[str, list[int]] = {}
        for k, text in enumerate(upstream):
            for s in set(shingles(text, words)):
                owners.setdefault(s, []).append(k)
        _OWNERS.clear()
        _OWNERS[key] = owners
    return _OWNERS[key]


def _copied(upstream, params: ProvenanceParams):
    """Paths of files most of whose shingles one third-party file has. upstream: their texts, or a broadcast of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = shingle_owners(getattr(upstream, "value", upstream), params.words)
        for batch in batches:
            found = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = set(shingles(text or "", params.words))
                if sum(s in owners for s in mine) < params.similarity * len(mine):
                    continue  # no one file has more of them than all together
                hits = Counter(k for s in mine for k in owners.get(s, ()))
                if hits and max(hits.values()) >= params.similarity * len(mine):
                    found.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    return run


def not_hand_written(files: DataFrame, upstream: DataFrame | None = None, path: str = "path", text: str = "text", upstream_text: str = "text", params: ProvenanceParams = ProvenanceParams()) -> DataFrame:
    """``(path, reason, probability)`` of every file not written by hand, one row for each path.

    ``reason`` is the first of notice, name, data, third party, upstream and forest that holds; ``probability`` is the
    forest's, null where no forest could be fitted (all labels alike, as in an empty table). Prose and settings are never judged by it. A null or empty text is
    judged by its path alone, a row with a null path is left out, and a repeated path is one file if any of its rows is.
    Third-party texts are sent to the executors in blocks of at most ``block``. Other columns are not read.
    """
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path is not null")
    studied = staged(rows.mapInArrow(_study(params), "path string, reason string, label boolean, code boolean, features array<double>"), "studied")
    tally = {r["label"]: r["n"] for r in studied.groupBy("label").agg(F.count("*").alias("n")).collect()}
    vector = array_to_vector("features").alias("features")
    if len(tally) == 2:
        share = min(1.0, 1.5 * params.sample / sum(tally.values()))
        sample = studied.where(F.pmod(F.xxhash64("path", F.lit(params.seed)), F.lit(1_000_000)) < int(share * 1_000_000))
        sample = sample.orderBy(F.xxhash64("path", F.lit(params.seed))).limit(params.sample)
        train = staged(sample.select(vector, "code", F.col("label").cast("double").alias("label")), "train")
        forest = RandomForestClassifier(numTrees=params.trees, maxDepth=params.depth, seed=params.seed, minInstancesPerNode=4, maxBins=64)
        first = forest.fit(train).transform(train).where((F.col("label") == 1) | ~F.col("code") | (vector_to_array("probability")[1] < params.doubt))
        model = forest.fit(staged(first.select("features", "label"), "train"))
        judged = model.transform(studied.select("path", "reason", "code", vector)).select("path", "reason", "code", vector_to_array("probability")[1].alias("probability"))
    else:
        judged = studied.select("path", "reason", "code", F.lit(None).cast("double").alias("probability"))
    parts = [judged.where((F.col("reason").isNotNull()) | (F.col("code") & (F.col("probability") >= params.threshold))).select("path", F.coalesce("reason", F.lit("forest")).alias("reason"), "probability")]
    if upstream is not None:
        texts = upstream.select(F.col(upstream_text).alias("text")).where("length(text) > 0").distinct()
        blocks = max(1, -(-texts.count() // params.block))
        for number in range(blocks):
            part = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number) if blocks > 1 else texts
            held = files.sparkSession.sparkContext.broadcast([r["text"] for r in part.collect()])  # at most ``block`` texts
            parts.append(rows.where("length(text) > 0").mapInArrow(_copied(held, params), "path string").select("path", F.lit("upstream").alias("reason"), F.lit(None).cast("double").alias("probability")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    order = F.expr("array_position(array('notice', 'name', 'data', 'third party', 'upstream', 'forest'), reason)")
    return every.groupBy("path").agg(F.min_by("reason", order).alias("reason"), F.max("probability").alias("probability"))
