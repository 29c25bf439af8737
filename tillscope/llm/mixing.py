"""Mixing sources to target weights: seeded draws per output shard over permuted blocks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import WORD, by_batch, n_words, placed
from tillscope.session import stage

#: Words of a block, and the blocks that a source's target or size has at least, in narrower ones if need be.
BLOCK = 64
LEAST_BLOCKS = 256
SLOTS = 8192
_SHARDS_A_TASK = 256


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """``share`` of all sizes by weight; a target stops at ``most`` times its size and the excess is reshared."""
    made = [0.0] * len(sizes)
    open_, rest = set(range(len(sizes))), share * sum(sizes)
    while open_ and rest > 0:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                made[i] = rest * weights[i] / weight
            break
        for i in over:
            made[i] = most * sizes[i]
            rest -= made[i]
        open_ -= over
    return made


def text_crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


@dataclass(frozen=True)
class Plan:
    """The recipe: per source (by code point, null last) its size, target, words of a block, blocks and places."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    widths: list[int]
    blocks: list[int]
    places: list[int]
    slots: int
    seed: int

    @property
    def shards(self) -> int:
        return -(-sum(self.places) // self.slots)


def plan(sizes: dict[str | None, int], weights: Sequence[float], share: float, block: int, slots: int, seed: int) -> Plan:
    """Blocks have ``block`` words, in small sources fewer, so that half a block is never much of a target."""
    sources = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    held = [int(sizes[s]) for s in sources]
    goal = targets(held, [weights[i % len(weights)] for i in range(len(sources))], share)
    widths = [max(1, min(block, int(min(n, t)) // LEAST_BLOCKS)) for n, t in zip(held, goal)]
    blocks = [-(-n // w) for n, w in zip(held, widths)]
    places = []
    for n, t, w, b in zip(held, goal, widths, blocks):
        # whole passes take every word; what is left of the target is taken in full blocks
        passes = min(2, int(t // n)) if n else 0
        places.append(min(2 * b, passes * b + min(b, round((t - passes * n) / w))))
    return Plan(sources, held, goal, widths, blocks, places, slots, seed)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` draws without replacement are among the ``good``, for numbers of any size.

    The law is log-concave, so beside its mode it lies under a flat piece and two exponential
    tails of the mode's own height; points under these are drawn until one lies under the law.
    """
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    mode = min(high, max(low, (taken + 1) * (good + 1) // (good + bad + 2)))

    def log_weight(x: int) -> float:
        return -sum(math.lgamma(k + 1.0) for k in (x, good - x, taken - x, bad - taken + x))

    top = log_weight(mode)
    whole = sum(math.lgamma(k + 1.0) for k in (good, bad, taken, good + bad - taken)) - math.lgamma(good + bad + 1.0)
    height = min(1.0, math.exp(whole + top))
    flat = 1.0 + height / 2
    while True:
        side, across, up, sign = rng.random(4)
        far = 0.0 if side * (1.0 + flat) <= flat else rng.standard_exponential()
        at = (across * flat if far == 0.0 else flat + far) / height
        x = mode + (1 if sign < 0.5 else -1) * round(at)
        if low <= x <= high and math.log(up or 5e-324) - far <= log_weight(x) - top:
            return x


def _left_half(rng: np.random.Generator, counts: np.ndarray, taken: int) -> np.ndarray:
    """How many of ``taken`` places fall to every source when ``counts`` are dealt at random."""
    made, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        made[i] = hypergeometric(rng, n, rest - n, taken)
        rest, taken = rest - n, taken - int(made[i])
    return made


def counts_between(recipe: Plan, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the shards from ``first`` to ``last`` (exclusive): the number, its multinomial source counts, those of all before it.

    The draws are conditioned on the whole mix meeting its places exactly. They descend a
    binary tree over the shards whose nodes have their own seeds, so any task gets the counts
    of its shards without knowing the others, and alike on every run.
    """
    counts = np.array(recipe.places, np.int64)
    open_ = [(0, recipe.shards, counts, np.zeros_like(counts))]
    while open_:
        low, high, counts, before = open_.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, counts, before
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([recipe.seed, low, high])
        half = _left_half(rng, counts, (middle - low) * recipe.slots)
        open_ += [(middle, high, counts - half, before + half), (low, middle, half, before)]


def shard_counts(recipe: Plan, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The source counts of one output shard, and those of all shards before it."""
    return next(counts_between(recipe, shard, shard + 1))[1:]


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 at ``index``: Feistel rounds, walked into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1) for r in range(1, 5)]

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x >> np.uint64(half), x & mask
            for k in keys:
                mixed = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(31)
                mixed *= np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ (mixed >> np.uint64(33)) & mask
            return left << np.uint64(half) | right

        made = once(index.astype(np.uint64))
        while len(out := np.flatnonzero(made >= size)):
            made[out] = once(made[out])
    return made.astype(np.int64)


def _shard(recipe: Plan, shard: int, counts: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """The places of one shard: source, copy and block of every slot."""
    held = np.flatnonzero(counts)
    source = np.repeat(held, counts[held])
    copies, blocks = [], []
    for s in held.tolist():
        copy, at = np.divmod(np.arange(before[s], before[s] + counts[s]), recipe.blocks[s])
        block = np.empty_like(at)
        for c in np.unique(copy).tolist():
            of = copy == c
            block[of] = permuted(at[of], recipe.blocks[s], recipe.seed + 2 * s + c)
        copies.append(copy)
        blocks.append(block)
    mixed = np.random.default_rng([recipe.seed, shard]).permutation(len(source))
    return [x[mixed] for x in (source, np.concatenate(copies), np.concatenate(blocks))]


def draws(spark, recipe: Plan) -> DataFrame:
    """Every place of the mix: shard, slot, source_no, copy (0 or 1) and the block that fills it.

    A task has at most some hundred shards and holds the places of one at a time.
    """
    kinds = {"shard": pa.int64(), "slot": pa.int64(), "source_no": pa.int32(), "copy": pa.int32(), "block": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            for shard, counts, before in counts_between(recipe, int(ids[0]), int(ids[-1]) + 1):
                source, copy, block = _shard(recipe, shard, counts, before)
                made = (np.full(len(source), shard), np.arange(len(source)), source, copy, block)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds.values())], names=list(kinds))

    tasks = max(1, min(recipe.shards, max(spark.sparkContext.defaultParallelism * 4, -(-recipe.shards // _SHARDS_A_TASK))))
    schema = "shard long, slot long, source_no int, copy int, block long"
    return spark.range(0, recipe.shards, 1, tasks).mapInArrow(run, schema)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    block: int = BLOCK,
    slots: int = SLOTS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame, Plan]:
    """The mix of ``docs`` to ``share`` of their words: documents in place, what is taken of them, the recipe.

    The words of a source, its documents in a fixed hashed order, form one stream of blocks. A
    place of the mix names a block through the source's permutation; each pass over a source
    has its own permutation and there are at most two, so nothing is taken more than twice.
    The first frame has doc_id, source, size, source_no and ``start`` (words before it in its
    source); the second has, for every part of a document that a place takes, shard, slot,
    copy, source_no, start, ``first`` (word within the document) and ``words``. A null text has
    no words. Sources are the recipe's entries and are listed on the driver. Every source's
    words come within one and a half of its blocks of its target: half a percent, or a word.
    """
    spark = docs.sparkSession
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_crc(F.col("text")).alias("crc")), "sized")
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    recipe = plan(sizes, weights, share, block, slots, seed)
    ahead = stage(placed(sized, ["source"], ["doc_id", "crc", "size"], "start", size="size"), "places")
    rows = [(s, i, w) for i, (s, w) in enumerate(zip(recipe.sources, recipe.widths))]
    numbers = spark.createDataFrame(rows, "name string, source_no int, width long")
    ahead = ahead.join(numbers, ahead["source"].eqNullSafe(numbers["name"])).drop("name")
    width, end = F.col("width"), F.col("start") + F.col("size")
    block_no = F.explode(F.sequence(F.expr("start div width"), F.expr("(start + size - 1) div width")))
    low, high = F.greatest(F.col("start"), F.col("block") * width), F.least(end, (F.col("block") + 1) * width)
    parts = (
        ahead.where("size > 0")
        .select("source_no", "start", "size", "width", block_no.alias("block"))
        .select("source_no", "start", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    )
    ahead = ahead.drop("width")
    # the planner takes the places for as small as the list of shards they come from; both sides grow
    taken = draws(spark, recipe).hint("merge").join(parts, ["source_no", "block"])
    return ahead, taken.select("shard", "slot", "copy", "source_no", "start", "first", "words"), recipe


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every document, one row for each row given.

    doc_id, size, source_size, target (its source's) and taken, all in words, repeats counted.
    """
    ahead, taken, recipe = mix(docs, **options)
    sums = taken.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    rows = [(i, n, t) for i, (n, t) in enumerate(zip(recipe.sizes, recipe.targets))]
    sources = docs.sparkSession.createDataFrame(rows, "source_no int, source_size long, target double")
    at = F.when(F.col("size") > 0, F.col("start"))
    met = ahead.withColumn("at", at).join(sums.withColumnRenamed("start", "at"), ["source_no", "at"], "left").join(sources, "source_no")
    return met.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WORD = re.compile(WORD)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of ``text`` in the given (first, count) spans, as they stand there; spans that touch are one."""
    at = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for first, count in sorted(spans):
        if merged and merged[-1][1] == first:
            merged[-1][1] = first + count
        else:
            merged.append([first, first + count])
    if merged == [[0, len(at)]]:
        return text
    return " ".join(text[at[a][0] : at[b - 1][1]] for a, b in merged)


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row for each pass over a document.

    A row's text is what that pass takes of the document, whole or in part, so a document
    comes back up to twice, once, or not at all. Of rows that agree in id, source and text the
    other columns are those of one of them. ``n_chars`` follows the text if it is a column.
    """
    ahead, taken, _ = mix(docs, **options)
    by = ["doc_id", "source", "crc", "size"]
    spans = taken.groupBy("source_no", "start", "copy").agg(F.collect_list(F.struct("first", "words")).alias("spans"))
    cuts = spans.join(ahead.where("size > 0").select("source_no", "start", *by), ["source_no", "start"])
    # one text key on both sides: the texts are dealt and sorted once, for the repeats and the join
    key = F.to_json(F.struct(*by)).alias("__key")
    names, fields = docs.columns, docs.schema
    known = docs.select(
        F.struct(*names).alias("row"), "doc_id", "source", text_crc(F.col("text")).alias("crc"), n_words(F.col("text")).alias("size")
    )
    keyed = known.select(key, "row").dropDuplicates(["__key"])
    met = keyed.join(cuts.select(key, F.col("spans").alias("__spans")).hint("merge"), "__key").select("row.*", "__spans")

    def make():
        def work(batch):
            made = {c: batch.column(c) for c in names}
            whole = batch.column("text").to_pylist()
            made["text"] = [
                cut_words(t, [(s["first"], s["words"]) for s in spans]) for t, spans in zip(whole, batch.column("__spans").to_pylist())
            ]
            if "n_chars" in names:
                made["n_chars"] = [len(t) for t in made["text"]]
            return made

        return work

    return by_batch(met, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
