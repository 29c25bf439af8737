"""SimHash near-duplicates through one-wildcard segment variants."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillscope.llm.common import by_batch
from tillscope.session import stage

SEED = 42
_BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _hashes(text: str | None, words: int, block: int = 1 << 16):
    """The hashes of a text's word shingles, repeats included, in blocks."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + block], last[at : at + block])], "<u8")


def fingerprint(text: str | None, words: int = 3, block: int = 1 << 16) -> int:
    """Majority of every bit over the hashes of a text's word shingles, repeats included.

    Fewer words than a shingle: their whole sequence is the one shingle. No word, or null: 0.
    Counts are summed in blocks, so memory does not grow with the text.
    """
    counts, n = np.zeros(_BITS, np.int64), 0
    for hashes in _hashes(text, words, block):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    set_bits = np.flatnonzero(2 * counts > n)
    return int(sum(1 << int(b) for b in set_bits))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of every row (text null: 0)."""

    def make():
        def work(batch):
            made = [fingerprint(t.as_py()) for t in batch.column("text")]
            return {"doc_id": batch.column("doc_id"), "fp": np.array(made, np.uint64).view(np.int64)}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), make, f"doc_id {kind}, fp long")


def _forest(codes: np.ndarray, others: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Links that span the groups of ``codes`` (or of the links between two sets), found breadth first.

    Every code is compared once with those not yet reached, so a dense family costs little
    more than one pass and no pair but those of the forest is kept.
    """
    rest = [codes] if others is None else [codes, others]
    made: list[tuple[int, int]] = []
    while len(rest[0]):
        front, rest[0] = [(rest[0][0], 0)], rest[0][1:]
        while front:
            code, side = front.pop()
            at = 0 if others is None else 1 - side
            near = np.bitwise_count(rest[at] ^ code) <= most
            for hit in rest[at][near]:
                made.append((int(code), int(hit)))
                front.append((hit, at))
            rest[at] = rest[at][~near]
    return made


def variants(fps: DataFrame, segments: int = 2) -> DataFrame:
    """Every distinct ``fp`` under its one-wildcard keys: 64 of them, 32 for either half.

    Two codes at ``2 * segments - 1`` or fewer differing bits have a segment in which they
    differ by one bit at most, so they share the key whose wildcard lies on that bit.
    """
    width = _BITS // segments
    mask = (1 << width) - 1
    keys = []
    for s in range(segments):
        segment = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(mask))
        for w in range(width):
            # segment number and wildcard position above the segment's bits, the wildcard cleared
            tag = (s * width + w) << width
            keys.append(segment.bitwiseAND(F.lit(mask ^ (1 << w))).bitwiseOR(F.lit(tag)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, most: int = 3, small: int = 32, block: int = 4096, per_task: int = 40_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that are ``most`` bits apart or less.

    Codes meet by an equality join on the variant keys and are verified. A key under ``small``
    codes joins them directly; a larger one, as a family of near copies makes, is cut into
    blocks of about ``block`` codes and every two blocks meet in a task of their own, which
    returns only a spanning forest. No link between components is lost either way, and no task
    holds more than two blocks.
    """
    if most > 3:
        raise ValueError("two segments with one wildcard find codes at 3 bits or less")
    # each code becomes 64 rows, so a task is given few
    keyed = variants(fps.repartition(max(1, math.ceil(fps.count() / per_task)), "fp"))
    counts = keyed.groupBy("key").count().where("count > 1")
    # planned sizes do not count the variants, so the join must not be left to them
    shared = stage(keyed.join(counts.hint("merge"), "key"), "simhash-keys")
    few = shared.where(F.col("count") <= small).select("key", "fp")
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
        .select("a", "b")
    )
    blocks = F.ceil(F.col("count") / block).cast("int")
    many = (
        shared.where(F.col("count") > small)
        .withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def forest(key, rows):
        own = rows["own"].to_numpy()
        codes = rows["fp"].to_numpy().view(np.uint64)
        i, j = int(key[1]), int(key[2])
        found = _forest(codes, None, most) if i == j else _forest(codes[own == i], codes[own == j], most)
        made = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": made.min(axis=1), "b": made.max(axis=1)})

    return pairs.unionByName(many.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``edges`` (a, b: long).

    Alternating large-star and small-star steps; each is written to the shared folder, so a
    lost executor costs one step and lineage stays short.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b")
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        met = both.join(low, both["a"] == low["u"])
        if large:
            made = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            made = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return made.where("a <> b").distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    while seen[0]:
        edges = stage(star(star(edges, True), False), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _roots(codes: DataFrame, most: int) -> DataFrame:
    """``fp`` and ``root``, one code of its component, for the distinct ``fp`` of ``codes``."""
    roots = components(links(codes.select("fp"), most))
    return codes.join(roots, codes["fp"] == roots["node"], "left").select(codes["*"], F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable.

    One row for each row given. Documents of one fingerprint are one component before any
    link is sought, so copies never meet in pairs. Null text has no words (fingerprint 0). A
    row without an id gets the smallest id of its component, null if none has one.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    codes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    rooted = stage(_roots(codes, most), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Words of a shingle where texts are compared by their shingles; least hashes of a sketch, and of a band; bands.
_ALIKE_WORDS, _SKETCH, _ROWS, _BANDS = 5, 160, 7, 48
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, _SKETCH), np.uint64) * np.uint64(2) + np.uint64(1)
#: Every band is of other hashes of the sketch.
_MEMBERS = np.array([np.random.default_rng(SEED + b).permutation(_SKETCH)[:_ROWS] for b in range(_BANDS)])
#: Bits of two sketches that may differ: 16 do at a similarity of 0.8, with a deviation of 4, and 40 at 0.5.
_APART = 34


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles of five words, in order."""
    parts = list(_hashes(text, _ALIKE_WORDS))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def sketch(text: str | None, block: int = 512) -> np.ndarray:
    """The least hash of a text's shingles under each of 160 permutations; none without a word."""
    least, some = np.full(_SKETCH, np.iinfo(np.uint64).max, np.uint64), False
    for hashes in _hashes(text, _ALIKE_WORDS, block):
        least = np.minimum(least, (hashes[:, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
        some = True
    return least if some else np.zeros(0, np.uint64)


def bands(least: np.ndarray) -> np.ndarray:
    """Keys of a sketch's bands; two texts of Jaccard 0.8 share none in about 2 of 10,000 cases."""
    if not len(least):
        return np.zeros(0, np.int64)
    keys = np.arange(1, _BANDS + 1, dtype=np.uint64)
    for row in least[_MEMBERS].T:
        keys = (keys ^ (row >> np.uint64(17)) ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def low_bits(least: np.ndarray) -> list[int]:
    """One bit of each hash of a sketch, in three numbers."""
    bits = np.zeros(192, np.uint8)
    bits[: len(least)] = (least >> np.uint64(40)) & np.uint64(1)
    return np.packbits(bits).view(np.int64).tolist()


def _near() -> Column:
    """Whether the sketches of ``a`` and ``b`` allow a similarity of 0.8."""
    apart = F.lit(0)
    for i in range(3):
        apart = apart + F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i]))
    return apart <= _APART


def alike_to_smaller(docs: DataFrame, sketched: DataFrame, least: float = 0.8, small: int = 64, block: int = 1024, per_part: int = 256) -> DataFrame:
    """``doc_id`` of documents that a chain of like texts leads to a smaller id that is not among them.

    Two texts are alike if the Jaccard similarity of their 5-word shingles is ``least`` or more,
    which is computed for all candidates: ids that share a MinHash band and whose sketches (the
    ``keys`` and ``bits`` of ``sketched``, one row an id) are near enough. First the least id of
    every band is compared with the others in it, and those alike to it are done, over again
    while that finds any: a family of copies takes about one comparison for each of its
    members. Then all that are left in a band meet, directly or, in a band of more than ``small``,
    in blocks that each have a task of their own; only those with near sketches leave it, so
    a family that shares a passage, but is not alike, costs sketches and not texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = f"struct<doc_id:{kind},bits:array<bigint>>"
    keyed = sketched.select(F.struct("doc_id", "bits").alias("b"), F.explode("keys").alias("key"))

    def shared(keyed):
        # planned sizes do not tell which keys are shared, so the join must not be left to them
        return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "key")

    def make_verdicts():
        held = [None, None]

        def work(batch):
            likes = []
            for a, text, other in zip(batch.column("a").to_pylist(), batch.column("text"), batch.column("other")):
                if held[0] != (a, text):
                    held[:] = [(a, text), shingles(text.as_py())]
                likes.append(jaccard(held[1], shingles(other.as_py())) >= least)
            return {"a": batch.column("a"), "b": batch.column("b"), "alike": likes}

        return work

    live = stage(shared(keyed).select("key", "b", "n"), "shared-bands")
    in_bands = live.select("b.doc_id").distinct()
    texts = stage(docs.join(in_bands, "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]), "band-texts")

    def judged(pairs: DataFrame) -> DataFrame:
        """The greater ids of the pairs (a, b) that are alike."""
        pairs = stage(pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct(), "candidates")
        # an id's pairs are cut into parts, so that no task has all of a family
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
        cut = stage(pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts"), "candidate-parts")
        left = cut.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a")
        right = cut.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
        verdicts = by_batch(left.join(right, ["a", "part"]).select("a", "b", "text", "other"), make_verdicts, f"a {kind}, b {kind}, alike boolean")
        return stage(verdicts.where("alike").select(F.col("b").alias("doc_id")).distinct(), "alike")

    gone = []
    while live.head(1):
        heads = live.groupBy("key").agg(F.min("b").alias("a"))
        met = live.join(heads.hint("merge"), "key").where((F.col("a.doc_id") < F.col("b.doc_id")) & _near())
        found = judged(met)
        if not found.head(1):
            break
        gone.append(found)
        rest = live.join(found, live["b.doc_id"] == found["doc_id"], "left_anti").select("key", "b")
        live = stage(shared(stage(rest, "rest")).select("key", "b", "n"), "shared-bands")
    few = live.where(F.col("n") <= small)
    pairs = few.select("key", F.col("b").alias("a")).join(few.select("key", "b").hint("merge"), "key").where((F.col("a.doc_id") < F.col("b.doc_id")) & _near())
    blocks = F.ceil(F.col("n") / block).cast("int")
    many = (
        live.where(F.col("n") > small)
        .withColumn("own", F.pmod(F.xxhash64("b.doc_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", "b", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    target = to_arrow_schema(StructType.fromDDL(f"a {item}, b {item}"))

    def near_pairs(key, table):
        own, items = table.column("own").to_numpy(), table.column("b").combine_chunks()
        ids = items.field("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: tuple(ids[k].values()) if isinstance(ids[k], dict) else ids[k])
        bits = items.field("bits").flatten().to_numpy().reshape(-1, 3)[order].view(np.uint64)
        own, (i, j) = own[order], (key[1].as_py(), key[2].as_py())
        first, second = [], []
        for at in range(len(order) - 1):
            near = np.bitwise_count(bits[at + 1 :] ^ bits[at]).sum(axis=1) <= _APART
            if i != j:
                near &= own[at + 1 :] != own[at]
            hits = at + 1 + np.flatnonzero(near)
            first.append(np.full(len(hits), at))
            second.append(hits)
        order = np.array(order)
        picked = [pa.array(order[np.concatenate(x)] if x else [], pa.int64()) for x in (first, second)]
        return pa.Table.from_arrays([items.take(p).cast(f.type) for p, f in zip(picked, target)], schema=target)

    pairs = pairs.select("a", "b").unionByName(many.groupBy("key", "i", "j").applyInArrow(near_pairs, f"a {item}, b {item}"))
    gone.append(judged(pairs))
    made = gone[0]
    for more in gone[1:]:
        made = made.unionByName(more)
    return made.distinct()


def _document(docs: DataFrame):
    """A row's id and a hash of its text: what tells documents apart where an id comes twice."""
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def keep_one(docs: DataFrame, most: int = 3, alike: float | None = None) -> DataFrame:
    """The rows of ``docs`` that lead their component, all columns kept.

    A component's lead is its smallest id, of rows that share the id the one whose text has the
    smallest hash; rows equal in id and text are one document, and one of them stays. So a text
    goes only where one like it stays, whatever ids come twice. Rows without an id all stay,
    for nothing says which of them leads. With ``alike``, of those that lead, no two stay
    whose 5-word shingles have that Jaccard similarity: most copies with edits lie further
    apart than ``most`` bits. An empty table gives an empty result.
    """
    known = docs.where("doc_id is not null")
    named = known.select(_document(docs).alias("doc_id"), "text")

    def make():
        def work(batch):
            texts = [t.as_py() for t in batch.column("text")]
            sketches = [sketch(t) if alike is not None else np.zeros(0, np.uint64) for t in texts]
            return {
                "doc_id": batch.column("doc_id"),
                "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64),
                "keys": [bands(k) for k in sketches],
                "bits": [low_bits(k) for k in sketches],
            }

        return work

    kind = named.schema["doc_id"].dataType.simpleString()
    prints = stage(by_batch(named, make, f"doc_id {kind}, fp long, keys array<long>, bits array<long>"), "fingerprints")
    codes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    lead = stage(_roots(codes, most).groupBy("root").agg(F.min("least").alias("doc_id")).select("doc_id"), "leads")
    if alike is not None:
        sketched = prints.join(lead, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        lead = stage(lead.join(alike_to_smaller(named, sketched, alike), "doc_id", "left_anti"), "leads")
    named = lead.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.h").alias("__h"))
    rows = known.withColumn("__own", _document(docs)["h"])
    kept = rows.join(named, (rows["doc_id"] == named["__id"]) & (rows["__own"] == named["__h"]), "left_semi")
    kept = kept.dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
