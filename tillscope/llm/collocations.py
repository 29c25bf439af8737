"""Phrases that occur together more often than their parts: per language, from united count transducers."""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillscope.llm.automata import Automaton, summed, united
from tillscope.session import stage

#: Words of the longest phrase.
LONGEST = 5
#: Words of a shard's block, and word occurrences that a prefix range stands for; both bound a task's memory.
BLOCK, RANGE = 1 << 20, 1 << 19
_SLICE = 1 << 20
#: Steps of a bucket's share of the line, and of a doubling of a count, where shards are told them.
_STEPS, _FINE = 1 << 16, 8
_MARK = b"A"
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE = bytes(_TABLE)
_BLOCKS = "lang string, block long, words binary, counts binary, n_words long, n long, ids binary, tail int"
_LISTS = "lang string, bucket int, block long, places binary, words binary, counts binary"
_TOLD = "lang string, block long, told binary, word binary, label long, f long"


def _pressed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2 to the 64, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(planes.tobytes(), 1)


def _unpressed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


class _Buffer:
    """Words of one language as numbers in the order they were met; 0 ends a piece."""

    def __init__(self, carry: list[bytes] = ()):
        # a mark cannot be a word, for words have no capitals
        self.words = {_MARK: 0}
        self.ids = array("I")
        self.add(carry)

    def add(self, tokens: list[bytes]) -> None:
        known = self.words
        self.ids.extend([known.setdefault(w, len(known)) for w in tokens])

    def row(self, lang: str, number: int, tail: int) -> dict:
        ids = np.frombuffer(self.ids, np.uint32)
        counts = np.bincount(ids[: len(ids) - tail], minlength=len(self.words))[1:]
        words = zlib.compress(b" ".join(list(self.words)[1:]), 1)
        planes = zlib.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
        return {"lang": lang, "block": number, "words": words, "counts": _pressed(counts), "n_words": len(counts), "n": int(counts.sum()), "ids": planes, "tail": tail}


def _tokens(data: bytes) -> list[bytes]:
    return data.replace(b"\n", b" " + _MARK + b" ").split()


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Shards of the texts of a language: their words, how often each occurs, and the texts as numbers.

    A text longer than a slice goes on in the next block: the last words of a block (``tail``)
    are there for phrases that begin before them, and begin phrases themselves in the next.
    """

    kind = to_arrow_schema(StructType.fromDDL(_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Buffer] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(lang: str, tail: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([held.pop(lang).row(lang, number, tail)], schema=kind)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text")):
                data = text.as_py().translate(_TABLE)
                at = 0
                while at < len(data):
                    ends = [e for e in (data.find(b" ", at + _SLICE), data.find(b"\n", at + _SLICE)) if e >= 0]
                    end = min(ends, default=len(data))
                    tokens = _tokens(data[at:end])
                    buffer = held.setdefault(lang, _Buffer())
                    buffer.add(tokens)
                    at = end
                    if at < len(data) and len(buffer.ids) >= block:
                        # phrases that begin in the last words are counted where they end
                        names = list(buffer.words)
                        carry = [names[i] for i in buffer.ids[1 - LONGEST :]]
                        yield flush(lang, len(carry))
                        held[lang] = _Buffer(carry)
                if lang in held:
                    held[lang].add([_MARK])
                    if len(held[lang].ids) >= block:
                        yield flush(lang, 0)
                if sum(len(b.ids) for b in held.values()) >= 2 * block:
                    for other in list(held):
                        yield flush(other, 0)
        for lang in list(held):
            yield flush(lang, 0)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    return texts.mapInArrow(run, _BLOCKS)


# ------------------------------------------------------------------- the words


def _word_lists(buckets: int):
    """The words of each block and their counts, dealt to buckets by a hash of the word."""

    kind = to_arrow_schema(StructType.fromDDL(_LISTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_words"]:
                    continue
                words, counts = zlib.decompress(row["words"]).split(b" "), _unpressed(row["counts"])
                bucket = np.array([zlib.crc32(w) for w in words], np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                made = []
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    # words of the tail alone count 0 times, but phrases go on into it
                    listed = zlib.compress(b" ".join([words[i] for i in part]), 1)
                    made.append((row["lang"], int(bucket[part[0]]), row["block"], _pressed(part), listed, _pressed(counts[part])))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), kind)], schema=kind)

    return run


def _frequent_words(least: int, buckets: int):
    """Of one bucket the frequent words, numbered in order, and for each block which of its words they are.

    A word's place on the line of its language (0 to 1) is its bucket's share of the line and,
    in it, the share of the occurrences before it. Ranges need it and the count roughly only,
    but the same in all shards: they are told in steps.
    """
    kind = to_arrow_schema(StructType.fromDDL(_TOLD))

    def run(key, table):
        lang, bucket = (k.as_py() for k in key)
        parts = [(r["block"], r["places"], zlib.decompress(r["words"]).split(b" "), _unpressed(r["counts"])) for r in table.select(["block", "places", "words", "counts"]).to_pylist()]
        total: dict[bytes, int] = {}
        for _, _, words, counts in parts:
            for word, n in zip(words, counts.tolist()):
                total[word] = total.get(word, 0) + n
        kept = sorted(w for w, n in total.items() if n >= least)
        f = np.array([total[w] for w in kept], np.int64)
        number = {w: i for i, w in enumerate(kept)}
        line = (np.cumsum(f) - f) * _STEPS // max(1, f.sum())
        size = np.ceil(_FINE * np.log2(np.maximum(f, 1))).astype(np.int64)
        rows = [(lang, None, None, w, (bucket << 32) + 1 + i, n) for i, (w, n) in enumerate(zip(kept, f.tolist()))]
        for block, places, words, _ in parts:
            at = np.array([number.get(w, -1) for w in words], np.int64)
            there = np.flatnonzero(at >= 0)
            if len(there):
                at, place = at[there], _unpressed(places)[there]
                told = (bucket, buckets, *[_pressed(c) for c in (np.diff(place, prepend=0), at, size[at], line[at])])
                rows.append((lang, block, pickle.dumps(told, 5), None, None, None))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)

    return run


# ----------------------------------------------------------------- the phrases


def _ranges(rows: np.ndarray, f: np.ndarray, line: np.ndarray, label: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix range of every path (local word numbers) and the depth at which ranges are cut there.

    The words of a language lie on a line from 0 to 1, each over its share of the occurrences,
    and ranges of about ``size`` occurrences are cut from it. A first word with more than that
    gets ranges of its own, cut by the second word on the same line, as many as its count needs;
    and so on for the words after it. The result depends on a path alone, so all shards agree
    without a list of bounds.
    """
    width = rows.shape[1]
    key, depth = np.zeros(len(rows), np.uint64), np.full(len(rows), width, np.int64)
    own = np.zeros(len(rows), np.uint64)
    expected, splits = np.full(len(rows), float(n)), np.full(len(rows), max(1.0, np.ceil(n / size)))
    open_ = np.ones(len(rows), bool)
    step = np.uint64(0x9E3779B97F4A7C15)
    for d in range(width):
        w = rows[:, d]
        part = np.floor(line[w] * splits).astype(np.uint64)
        expected = expected * f[w] / n
        done = open_ & ((expected <= size) | (w == 0) | (d == width - 1))
        # a word that fills a range is told from its neighbours on the line
        key[done] = (own[done] * step ^ (part[done] + np.uint64(1))) * step + np.uint64(d)
        depth[done] = d + 1
        open_ &= ~done
        own = (own * step) ^ label[w].astype(np.uint64)
        splits = np.maximum(1.0, np.ceil(expected / size))
    return (key >> np.uint64(1)).astype(np.int64), depth


class _Block:
    """A block's words as numbers of the frequent ones (0: any other, or the end of a piece), and its pairs of such words."""

    def __init__(self, row: dict):
        ids = np.frombuffer(zlib.decompress(row["ids"]), np.uint8).reshape(4, -1)
        ids = np.ascontiguousarray(ids.T).view(np.uint32).ravel()
        parts = [(bucket, buckets, *map(_unpressed, rest)) for bucket, buckets, *rest in map(pickle.loads, row["told"])]
        place = np.concatenate([np.cumsum(p[2]) for p in parts])
        label = np.concatenate([(p[0] << 32) + 1 + p[3] for p in parts])
        f = np.concatenate([2.0 ** (p[4] / _FINE) for p in parts])
        line = np.concatenate([(p[0] + p[5] / _STEPS) / p[1] for p in parts])
        order = np.argsort(label)
        first = np.zeros(1)
        self.n = row["n_all"]
        self.label, self.f, self.line = np.append(first, label[order]).astype(np.int64), np.append(first, f[order]), np.append(first, line[order])
        local = np.zeros(max(int(ids.max(initial=0)), int(place.max()) + 1) + 1, np.int64)
        local[place[order] + 1] = np.arange(1, len(order) + 1)
        self.words = np.append(local[ids], np.zeros(LONGEST, np.int64))
        starts = len(ids) - row["tail"]
        # pairs that begin in the tail are needed to go on from the pairs before them
        self.start = np.flatnonzero((self.words[: len(ids)] > 0) & (self.words[1 : len(ids) + 1] > 0))
        self.counted = self.start < starts
        packed = (self.words[self.start] << 32) | self.words[self.start + 1]
        pairs, self.pair_of = np.unique(packed, return_inverse=True)
        self.pairs = np.column_stack([pairs >> 32, pairs & 0xFFFFFFFF])

    def cut(self, rows: np.ndarray, size: int) -> list[tuple[int, int, np.ndarray]]:
        """The rows (ascending) by prefix range: its key, its depth, the rows' numbers."""
        key, depth = _ranges(rows, self.f, self.line, self.label, self.n, size)
        order = np.argsort(key, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []
        return [(int(key[p[0]]), int(depth[p[0]]), p) for p in parts]

    def pair_transducers(self, size: int) -> list[tuple]:
        counts = np.bincount(self.pair_of[self.counted], minlength=len(self.pairs))
        return [(key, depth, Automaton.of(self.label[self.pairs[p]], counts[p]).dump()) for key, depth, p in self.cut(self.pairs, size)]

    def long_transducers(self, size: int, masks: dict[int, bytes]) -> list[tuple]:
        """Phrases of three words and more of which every two neighbours are a frequent pair."""
        frequent = np.zeros(len(self.pairs), bool)
        for key, _, part in self.cut(self.pairs, size):
            if key in masks:
                frequent[part] = np.unpackbits(np.frombuffer(zlib.decompress(masks[key]), np.uint8), count=len(part)).astype(bool)
        goes_on = np.zeros(len(self.words), bool)
        goes_on[self.start] = frequent[self.pair_of]
        first = self.start[self.counted]
        first = first[goes_on[first] & goes_on[first + 1]]
        if not len(first):
            return []
        rows = self.words[first[:, None] + np.arange(LONGEST)]
        rows[:, 1:] *= np.logical_and.accumulate(goes_on[first[:, None] + np.arange(LONGEST - 1)], axis=1)
        rows, counts = summed(rows, np.ones(len(rows), np.int64))
        return [(key, depth, Automaton.of(self.label[rows[p]], counts[p]).dump()) for key, depth, p in self.cut(rows, size)]


def _shard(make, schema: str):
    """``make(row) -> list of tuples`` for every block, as rows behind its language and number."""

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = [(row["lang"], row["block"], *m) for m in make(row)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), kind)], schema=kind)

    return run


_GRAMS = "lang string, block long, key long, depth int, grams binary"
_PHRASES = "lang string, labels array<long>, f long, whole boolean"
_PAIRS = "lang string, block long, key long, mask binary, labels array<long>, f long"


def _frequent_pairs(least: int):
    """The frequent pairs of one prefix range, and for each block a bit for each of its pairs there."""
    kind = to_arrow_schema(StructType.fromDDL(_PAIRS))

    def run(key, table):
        lang, key, _ = (k.as_py() for k in key)
        parts = [Automaton.load(d.as_py()).paths() for d in table.column("grams")]
        paths, counts = summed(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))
        frequent = np.flatnonzero(counts >= least)
        rows = [(lang, None, None, None, labels, f) for labels, f in zip(paths[frequent].tolist(), counts[frequent].tolist())]
        held = Automaton.of(paths[frequent], counts[frequent]) if len(frequent) else None
        for block, (own, _) in zip(table.column("block").to_pylist(), parts):
            bits = held.look_up(own) > 0 if held else np.zeros(len(own), bool)
            if bits.any():
                rows.append((lang, block, key, zlib.compress(np.packbits(bits).tobytes(), 1), None, None))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)

    return run


def _united(least: int):
    """Phrases of three words and more of one prefix range: whole counts from the depth of its cuts on, parts of the shorter ones'."""
    kind = to_arrow_schema(StructType.fromDDL(_PHRASES))

    def run(key, table):
        lang, _, depth = (k.as_py() for k in key)
        rows, counts = united([Automaton.load(d.as_py()) for d in table.column("grams")])
        labels, f, whole = [], [], []
        for words in range(3, LONGEST + 1):
            there = np.flatnonzero(rows[:, words - 1] > 0)
            part = rows[there][:, :words]
            if not len(part):
                break
            new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]).any(axis=1)))
            total = np.add.reduceat(counts[there], new)
            kept = np.flatnonzero((total >= least) | (words < depth))
            labels += part[new[kept]].tolist()
            f += total[kept].tolist()
            whole += [words >= depth] * len(kept)
        return pa.Table.from_pydict({"lang": [lang] * len(f), "labels": labels, "f": f, "whole": whole}, schema=kind)

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, block: int = BLOCK, size: int = RANGE, per_bucket: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, label, f) and phrases (lang, labels, f) with ``least`` or more occurrences, and n of each language.

    A phrase is so frequent only if its words and its pairs of neighbours are, so shards leave
    out all others: words are counted first, then pairs, then longer phrases. Each time the
    shards' lists or transducers are cut into ranges, those of a range are united in a task of
    its own, and every shard is told which of its entries are frequent. Counts are exact.
    """
    shards = stage(blocks(docs, block), "blocks")
    totals = stage(shards.groupBy("lang").agg(F.sum("n").alias("n_all")), "totals")
    listed = shards.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-listed // per_bucket))
    lists = shards.select("lang", "block", "words", "counts", "n_words").mapInArrow(_word_lists(buckets), _LISTS)
    answers = stage(lists.groupBy("lang", "bucket").applyInArrow(_frequent_words(least, buckets), _TOLD), "words")
    told = answers.where("block is not null").groupBy("lang", "block").agg(F.collect_list("told").alias("told"))
    words = answers.where("label is not null").select("lang", "word", "label", "f")
    known = stage(shards.select("lang", "block", "ids", "tail").join(told.hint("merge"), ["lang", "block"]).join(totals, "lang"), "known")

    pairs = known.mapInArrow(_shard(lambda row: _Block(row).pair_transducers(size), _GRAMS), _GRAMS)
    pairs = stage(pairs.groupBy("lang", "key", "depth").applyInArrow(_frequent_pairs(least), _PAIRS), "pairs")
    masks = pairs.where("block is not null").groupBy("lang", "block").agg(F.collect_list(F.struct("key", "mask")).alias("masks"))
    # a shard without a frequent pair holds no longer phrase
    met = known.join(masks.hint("merge"), ["lang", "block"])

    def longer(row: dict) -> list[tuple]:
        return _Block(row).long_transducers(size, {m["key"]: m["mask"] for m in row["masks"]})

    grams = met.mapInArrow(_shard(longer, _GRAMS), _GRAMS)
    made = stage(grams.groupBy("lang", "key", "depth").applyInArrow(_united(least), _PHRASES), "range-phrases")
    parts = made.where("not whole").groupBy("lang", "labels").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = pairs.where("labels is not null").select("lang", "labels", "f")
    phrases = phrases.unionByName(made.where("whole").select("lang", "labels", "f")).unionByName(parts)
    return words, stage(phrases, "phrases"), totals.withColumnRenamed("n_all", "n")


def _filled(column, width: int = LONGEST) -> np.ndarray:
    """Lists of labels as rows, filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    rows[at, runs_within(sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return rows


def runs_within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def part_counts(words: DataFrame, phrases: DataFrame, per_task: int = 5_000) -> DataFrame:
    """(lang, labels, k, l, r) for every phrase and cut: how often its first k words and the rest occur.

    All frequent words and phrases are compiled into transducers by prefix, and the parts asked
    for, dealt the same way, are composed with them. Every part of a frequent phrase is frequent.
    """
    held = words.select("lang", F.array("label").alias("part"), "f").unionByName(phrases.select("lang", F.col("labels").alias("part"), "f"))
    ask = phrases.select("lang", "labels", F.explode(F.sequence(F.lit(1), F.size("labels") - 1)).alias("k"))
    first = F.slice("labels", F.lit(1), F.col("k"))
    rest = F.slice("labels", F.col("k") + 1, F.size("labels") - F.col("k"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), first.alias("part")), F.struct(F.lit(1).alias("side"), rest.alias("part"))))
    ask = ask.select("lang", "labels", "k", sides.alias("s")).select("lang", "labels", "k", "s.side", "s.part")
    buckets = max(1, -(-phrases.count() // per_task))
    bucket = F.pmod(F.xxhash64(F.slice("part", 1, 2)), F.lit(buckets)).alias("bucket")
    kind = pa.schema([("lang", pa.string()), ("labels", pa.list_(pa.int64())), ("k", pa.int32()), ("side", pa.int32()), ("f", pa.int64())])

    def composed(asked, stored):
        if not asked.num_rows:
            return kind.empty_table()
        rows, weights = summed(_filled(stored.column("part")), stored.column("f").to_numpy())
        found = Automaton.of(rows, weights).look_up(_filled(asked.column("part")))
        return pa.Table.from_arrays([asked.column(c).cast(kind.field(c).type) for c in ("lang", "labels", "k", "side")] + [pa.array(found)], schema=kind)

    asked = ask.select("*", bucket).groupBy("lang", "bucket")
    stored = held.select("*", bucket).groupBy("lang", "bucket")
    made = asked.cogroup(stored).applyInArrow(composed, "lang string, labels array<long>, k int, side int, f long")
    return made.groupBy("lang", "labels", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, block: int = BLOCK, size: int = RANGE) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 5 words: lang, rank, phrase, a, l, r, n, score.

    Words are runs without space or tab, in pieces between ``.,;:!?`` and line ends, A-Z as a-z; a
    null text has none, a null language is ``und``. A phrase occurs ``a`` times, ``least`` or more,
    its two parts ``l`` and ``r`` times at the cut of lowest score floor(1000 a n / (l r)), the first
    of equal ones; products are decimals of 38 digits. A phrase is left out if a phrase one
    word longer that holds it occurs as often, which any longer one then does by way of it.
    Repeated rows count each; an empty table gives an empty result.
    """
    words, phrases, totals = frequent_phrases(docs, least, block, size)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = stage(part_counts(words, phrases).join(phrases.withColumnRenamed("f", "a"), ["lang", "labels"]), "cuts")
    scored = cuts.join(totals, "lang").withColumn("top", F.lit(1000).cast("decimal(38,0)") * exact("a") * exact("n"))
    scored = scored.withColumn("low", exact("l") * exact("r")).withColumn("score", F.expr("top div low"))
    best = scored.groupBy("lang", "labels", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    n_words = F.size("labels")
    ends = F.array_compact(
        F.array(
            F.when((n_words > 2) & (F.col("k") == n_words - 1) & (F.col("l") == F.col("a")), F.slice("labels", F.lit(1), n_words - 1)),
            F.when((n_words > 2) & (F.col("k") == 1) & (F.col("r") == F.col("a")), F.slice("labels", F.lit(2), n_words - 1)),
        )
    )
    inside = cuts.select("lang", F.explode(ends).alias("labels")).distinct()
    left = stage(best.join(inside, ["lang", "labels"], "left_anti"), "collocations")
    spelled = left.select("lang", "labels", F.posexplode("labels").alias("place", "label")).join(words.select("lang", "label", "word"), ["lang", "label"])
    spelled = spelled.groupBy("lang", "labels").agg(F.sort_array(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))).alias("w"))
    named = left.join(spelled.select("lang", "labels", F.array_join("w.word", " ").alias("phrase")), ["lang", "labels"])
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
