"""Mixing sources to target shares by pivotal dependent rounding.

All documents of a source get the same expected number of copies, so that the source's expected tokens are exactly its
target. The whole part is given to each document; the fractional parts are rounded in pairs: tokens are moved from one
document's chance to the other's, at random in the direction that keeps both unbiased, until one chance is 0 or 1. The
total never changes, so a source ends within one document of its target. Pairs are formed within groups of bounded
size; what is left of each group, at most one document, is paired again in a tree of groups.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import random
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.truncation import source_key
from quarrystone.session import staged


@dataclass(frozen=True)
class MixParams:
    """ranks: a byte-pair vocabulary in tiktoken's format, and pattern, how it splits texts (None: the public
    vocabulary and pattern installed with this interpreter). tokens: size of a mix (None: the largest at which every
    source still reaches its share). group: documents rounded by one task. fan: leftovers that a step of the tree joins.
    small: targets up to which the plan is broadcast; a longer one is joined by shuffle."""

    ranks: str | None = None
    pattern: str | None = None
    tokens: int | None = None
    group: int = 20_000
    fan: int = 64
    small: int = 100_000
    seed: int = 11


def _vocabulary(params: MixParams) -> tuple[str, str]:
    if params.ranks:
        return params.ranks, params.pattern or r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken"), params.pattern or public_tokenizers.PATTERN
    return "/opt/tokenizers/byte_bpe_50k.tiktoken", params.pattern or r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_ENCODINGS: dict[str, object] = {}


def _encoding(raw: bytes, pattern: str):
    """The tokenizer of a vocabulary, built once in a worker."""
    import tiktoken

    name = hashlib.sha256(pattern.encode() + raw).hexdigest()
    if name not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def token_counts(documents: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """``(doc_id, source, tokens)`` of every document with an id; a null text has 0 tokens.

    The vocabulary is read by the driver only, and sent once to each executor.
    """
    place, pattern = _vocabulary(params)
    raw = documents.sparkSession.sparkContext.broadcast(Path(place).read_bytes())  # some 50,000 lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(raw.value, pattern)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.select(F.col(ident).alias("doc_id"), F.coalesce(source_key(F.col(source)), F.lit("")).alias("source"), F.col(text).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, tokens long")


def plan_mixes(counts: DataFrame, targets: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``(mix, source, share, max_repeats, available, fair, copies)``: for each target the source's tokens, its share
    among the sources that have any, and the expected copies of each of its documents.

    A source without documents cannot contribute: the others keep their proportions. Repeated targets of a mix and
    source count once, with the larger values; a null or negative share is 0, and null repeats are 1.
    """
    wanted = targets.select("mix", F.coalesce(source_key(F.col("source")), F.lit("")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).where("mix is not null")
    wanted = wanted.groupBy("mix", "source").agg(F.max("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    totals = counts.groupBy("source").agg(F.sum("tokens").alias("available"))
    known = wanted.join(totals, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("share") > 0)
    sums = known.where(usable).groupBy("mix").agg(F.sum("share").alias("whole"), F.min(F.col("available") * F.col("max_repeats") / F.col("share")).alias("room"))
    # all shares are scaled alike, so the source with the least room for its share bounds the mix
    size = F.col("room") * F.col("whole") if params.tokens is None else F.least(F.lit(float(params.tokens)), F.col("room") * F.col("whole"))
    named = known.join(sums.select("mix", "whole", size.alias("size")), "mix", "left")
    fair = F.when(usable, F.col("share") / F.col("whole")).otherwise(F.lit(0.0))
    copies = F.when(usable, F.least(fair * F.col("size") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return named.select("mix", "source", "share", "max_repeats", "available", fair.alias("fair"), copies.alias("copies"))


def pivot(rows: list[tuple], chance: random.Random) -> tuple[dict, tuple | None]:
    """Rounds ``(key, p, weight)`` in pairs. Gives 0 or 1 for all but at most one, which is returned with what it has.

    sum(p * weight) stays the same; of two with 0 < p < 1, weight is moved by the largest amounts a (up for the first)
    or b (down) that leave both within 0 and 1, with chances b : a, so that no expectation changes.
    """
    done: dict = {}
    held: tuple | None = None
    for key, p, weight in rows:
        if p <= 1e-9 or p >= 1 - 1e-9:
            done[key] = int(p > 0.5)
            continue
        if held is None:
            held = (key, p, weight)
            continue
        other, q, size = held
        up = min((1 - p) * weight, q * size)
        down = min(p * weight, (1 - q) * size)
        if chance.random() * (up + down) < down:
            p, q = p + up / weight, q - up / size
        else:
            p, q = p - down / weight, q + down / size
        pair = [(key, p, weight), (other, q, size)]
        held = None
        for k, x, w in pair:
            if x <= 1e-9 or x >= 1 - 1e-9:
                done[k] = int(x > 0.5)
            else:
                held = (k, x, w)
    return done, held


def select_mix(documents: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """``(mix, doc_id, source, tokens, copies)`` of every document that a mix uses, ``copies`` (at least 1) times.

    Documents with a null id or without tokens are in no mix; a null source is the source "". The same seed and rows
    give the same mix. Rows that repeat an id are documents of their own. No source, however large, is rounded by one
    task: groups have at most about ``group`` documents, are shuffled as such, and each leaves one for the next step of
    the tree.
    """
    counts = staged(token_counts(documents, ident, text, source, params).where("tokens > 0"), "tokens")
    return _select(counts, plan_mixes(counts, targets, params), params)


def grouped(rows: DataFrame):
    """Rows shuffled and grouped by the part of a mix's source they belong to."""
    return rows.repartition("mix", "source", "part").groupBy("mix", "source", "part")


def _select(counts: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    kind = counts.schema["doc_id"].dataType.simpleString()
    sizes = counts.groupBy("source").agg(F.count("*").alias("docs"))
    plan = plan.where("copies > 0").join(sizes, "source").select("mix", "source", "copies", F.ceil(F.col("docs") / params.group).cast("long").alias("groups"))
    if plan.count() <= params.small:
        plan = F.broadcast(plan)
    rows = counts.join(plan, "source").select("mix", "source", "doc_id", "tokens", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"), F.pmod(F.xxhash64("doc_id", "mix", F.lit(params.seed)), F.col("groups")).alias("part"))
    schema = f"mix string, source string, doc_id {kind}, tokens long, whole long, p double, part long, state int"

    def round_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "tokens"], kind="stable").reset_index(drop=True)
        chance = random.Random(f"{params.seed} {group['mix'].iloc[0]} {group['source'].iloc[0]} {group['part'].iloc[0]} {len(group)}")
        order = list(range(len(group)))
        chance.shuffle(order)
        p, weight = group["p"].to_numpy().copy(), group["tokens"].to_numpy()
        done, held = pivot([(i, float(p[i]), float(weight[i])) for i in order], chance)
        for i, x in done.items():
            p[i] = x
        if held is not None:
            p[held[0]] = held[1]
        return group.assign(p=p, state=[1 if held is not None and held[0] == i else 0 for i in range(len(group))])

    # a join by source has all of a source in one place, which would do for the grouping: groups are spread on purpose
    rounded = staged(grouped(rows).applyInPandas(round_group, schema), "rounded")
    finished, left = rounded.where("state = 0"), rounded.where("state = 1")
    most = plan.agg(F.max("groups")).first()[0] or 1
    done = [finished]
    while most > 1:
        left = staged(grouped(left.withColumn("part", F.floor(F.col("part") / params.fan))).applyInPandas(round_group, schema), "left")
        done.append(left.where("state = 0"))
        left = left.where("state = 1")
        most = -(-most // params.fan)
    # one document of a source may be left: to its nearer whole number
    done.append(left.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    return every.select("mix", "doc_id", "source", "tokens", copies).where("copies > 0")


def mix_shares(documents: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """``(mix, source, target_share, available_tokens, documents, tokens, share, most_copies)`` of every target."""
    counts = staged(token_counts(documents, ident, text, source, params).where("tokens > 0"), "tokens")
    plan = staged(plan_mixes(counts, targets, params), "plan")
    used = _select(counts, plan, params).groupBy("mix", "source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    joined = staged(plan.join(used, ["mix", "source"], "left").na.fill(0, ["documents", "tokens", "most_copies"]), "shares")
    totals = joined.groupBy("mix").agg(F.sum("tokens").alias("total"))
    share = F.round(F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0), 6)
    return joined.join(totals, "mix").select("mix", "source", F.col("share").alias("target_share"), F.col("available").alias("available_tokens"), "documents", "tokens", share.alias("share"), "most_copies")
