"""A Merkle manifest of a dataset: coordinates by rank in bitmaps, levels reduced over slot arrays."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import by_batch, placed
from tillscope.session import stage

#: A bitmap word holds 64 ids; a directory node has at most 2 to this power children.
_FAN = 14
#: Leaves of a slot array, as a power of two: so many levels are reduced at once.
LEVELS = 10


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def _leaf(n_chars: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return _hash(F.concat(*[_field(c) for c in fields]))


def leaves(docs: DataFrame) -> DataFrame:
    """Per row: ``grp`` (its language, null as the empty text), ``doc_id``, ``leaf`` and ``changed``.

    ``changed`` is the leaf after tampering, which adds 1 to n_chars where 7 divides the crc32
    of the id as text; a null id or a null count stays as it is.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    return docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("grp"),
        "doc_id",
        _leaf(F.col("n_chars")).alias("leaf"),
        F.when(hit, _leaf(F.col("n_chars") + 1)).alias("changed"),
    )


# ---------------------------------------------------------------- coordinates


def bitmaps(rows: DataFrame) -> DataFrame:
    """The ids of each group as words of 64 bits; a word without ids is not stored.

    Per (grp, word): ``bits``, the rows ``n`` that it stands for, and ``again``, how many rows
    more than one an id of it has. Words are merged by OR before they are shuffled. Null ids
    are a word of their own, without bits.
    """
    ids = rows.groupBy("grp", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    low = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    more = F.when((F.col("m") > 1) & F.col("doc_id").isNotNull(), F.struct(low.alias("low"), (F.col("m") - 1).alias("n")))
    return ids.groupBy("grp", F.shiftright("doc_id", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low)).alias("bits"),
        F.sum("m").alias("n"),
        F.collect_list(more).alias("again"),
    )


def with_directory(words: DataFrame) -> DataFrame:
    """``words`` with ``before``: the rows of all words ahead in the group.

    Popcounts are summed over a tree of words with at most 16,384 children a node, so no
    window holds more than the children of one node, whatever the ids are.
    """
    out = words.withColumn("before", F.lit(0).cast("long"))
    for shift in range(0, 64, _FAN):
        node = F.shiftright("word", shift)
        parent = F.shiftright("word", shift + _FAN) if shift + _FAN < 64 else F.lit(0)
        sums = words.groupBy("grp", node.alias("node"), parent.alias("parent")).agg(F.sum("n").alias("n"))
        ahead = Window.partitionBy("grp", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("grp").alias("__grp"), "node", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__ahead"))
        out = out.join(sums, (out["grp"] == sums["__grp"]) & node.eqNullSafe(sums["node"]))
        out = out.withColumn("before", F.col("before") + F.col("__ahead")).drop("__grp", "node", "__ahead")
    return out


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, doc_id: whole numbers, leaf) with ``at``, the place in the order of the ids of their group.

    The place is a rank query: the rows of the words ahead, and the bits below in the word.
    Nothing is sorted by id. Rows that share an id lie in the order of their leaves; equal rows
    are dealt to their places one each.
    """
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    words = stage(bitmaps(rows), "bitmaps")
    words = with_directory(words).select(F.col("grp").alias("__grp"), F.col("word").alias("__word"), "bits", "n", "again", "before")
    low = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    below = F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low)))
    copies = F.aggregate(F.filter("again", lambda x: x["low"] < low), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    met = rows.join(words, (F.col("grp") == F.col("__grp")) & F.shiftright("doc_id", 6).eqNullSafe(F.col("__word")))
    ranked = met.select(
        *rows.columns,
        (F.col("before") + F.coalesce(F.bit_count(below).cast("long") + copies, F.lit(0))).alias("at"),
        F.when(F.col("doc_id").isNull(), F.col("n") > 1).otherwise(F.exists("again", lambda x: x["low"] == low)).alias("shared"),
    )
    ranked = stage(ranked, "ranks")
    shared = ranked.where("shared")
    if not shared.head(1):
        return ranked.drop("row", "shared")
    # the leaves of one id, by their first byte and then within it; a leaf may have any number of copies
    key = ["grp", "doc_id"]
    kinds = shared.groupBy(*key, "leaf").agg(F.count(F.lit(1)).alias("m")).withColumn("radix", F.substring("leaf", 1, 2))
    parts = kinds.groupBy(*key, "radix").agg(F.sum("m").alias("m"))
    ahead = Window.partitionBy(*key).orderBy("radix").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("grp").alias("g"), F.col("doc_id").alias("i"), F.col("radix").alias("r"), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*key, "radix").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("inner", F.coalesce(F.sum("m").over(within), F.lit(0)))
    same = (F.col("grp") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i"))
    kinds = kinds.join(parts, same & (F.col("radix") == F.col("r"))).select("g", "i", F.col("leaf").alias("l"), (F.col("ahead") + F.col("inner")).alias("ahead"))
    dealt = placed(shared, [*key, "leaf"], ["row"], "nth").join(kinds, same & (F.col("leaf") == F.col("l")))
    dealt = dealt.withColumn("at", F.col("at") + F.col("ahead") + F.col("nth")).select(*ranked.columns)
    return stage(ranked.where("not shared").unionByName(dealt), "places").drop("row", "shared")


# ----------------------------------------------------------------------- tree


def _joined(left: str, right: str) -> str:
    return sha256((left + right).encode()).hexdigest()


def _grown(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and the levels above them; the last run of a level may be a single node."""
    made = [nodes]
    for _ in range(levels):
        nodes = [_joined(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else "") for i in range(0, len(nodes), 2)]
        made.append(nodes)
    return made


def _height(n: int) -> int:
    """Levels that a slot array of a group of ``n`` nodes reduces."""
    return min(LEVELS, (n - 1).bit_length())


def _path(levels: list[list[str]], slot: int) -> str:
    """The siblings on the way up: L or R, the side a sibling is on, and its digest; N where there is none."""
    steps = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        steps.append("N" if other >= len(nodes) else ("L" if slot & 1 else "R") + nodes[other])
        slot >>= 1
    return "".join(steps)


def _steps(path: str) -> list[tuple[str, str]]:
    made, at = [], 0
    while at < len(path):
        end = at + (1 if path[at] == "N" else 65)
        made.append((path[at], path[at + 1 : end]))
        at = end
    return made


def _slots(batch):
    """The slot arrays of a batch, column by column, with the bounds of each row."""
    column = batch.column("slots")
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return column.flatten(), ends


def _up(nodes: DataFrame) -> list[DataFrame]:
    """The slot arrays of every tier of the trees over ``nodes`` (grp, at, node, further columns), the last one the trees' tops.

    A tier is keyed by (grp, at without its last bits), so a group of any size is spread; each
    array is reduced by up to ten levels in one go, to one node of the tier above.
    """

    def make():
        def work(batch):
            flat, ends = _slots(batch)
            hashes = flat.field("node").to_pylist()
            n = batch.column("n").to_pylist()
            tops = [_grown(hashes[ends[i] : ends[i + 1]], _height(n[i]))[-1][0] for i in range(len(n))]
            return {"grp": batch.column("grp"), "at": batch.column("block"), "node": tops}

        return work

    tiers = []
    sizes = stage(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    while True:
        inner = [c for c in nodes.columns if c not in ("grp", "at")]
        slot = F.struct(F.col("at").bitwiseAND(F.lit((1 << LEVELS) - 1)).alias("slot"), *inner)
        arrays = nodes.groupBy("grp", F.shiftright("at", LEVELS).alias("block")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        arrays = stage(arrays.join(sizes, "grp"), "slot-arrays")
        tiers.append(arrays)
        nodes = stage(by_batch(arrays, make, "grp string, at long, node string"), "tops")
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1 << LEVELS:
            return [*tiers, nodes]
        sizes = sizes.withColumn("n", F.ceil(F.col("n") / (1 << LEVELS)).cast("long"))


def _down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, at, path, top) for the nodes that the lowest of ``tiers`` holds.

    ``above`` has (grp, path, top) of every tree: what lies over its top.
    """

    def make():
        def work(batch):
            flat, ends = _slots(batch)
            hashes, n, paths = flat.field("node").to_pylist(), batch.column("n").to_pylist(), batch.column("path").to_pylist()
            of, slots, made = [], [], []
            for i in range(len(n)):
                levels = _grown(hashes[ends[i] : ends[i + 1]], _height(n[i]))
                for slot in range(ends[i + 1] - ends[i]):
                    of.append(i)
                    slots.append(slot)
                    made.append(_path(levels, slot) + paths[i])
            block = batch.column("block").to_numpy()[of]
            return {"grp": batch.column("grp").take(of), "at": (block << LEVELS) + np.array(slots, np.int64), "path": made, "top": batch.column("top").take(of)}

        return work

    paths = above.withColumn("at", F.lit(0).cast("long"))
    for arrays in reversed(tiers):
        over = paths.select(F.col("grp").alias("g"), F.col("at").alias("a"), "path", "top")
        met = arrays.join(over, (F.col("grp") == F.col("g")) & (F.col("block") == F.col("a"))).drop("g", "a")
        paths = by_batch(met, make, "grp string, at long, path string, top string")
        if arrays is not tiers[0]:
            paths = stage(paths, "paths")
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's leaf, the root of its language, the root of all, and its proof.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, or
    else the leaf, and the siblings of the proof) and verified. Null values are hashed as ``-``;
    null ids come first in their language, rows of one id in the order of their leaves, equal
    rows at places of their own. An empty table gives an empty result. The tree over the
    languages has one node for each; their order is found in one task.
    """
    rows = coordinates(leaves(docs)).withColumnRenamed("leaf", "node")
    *tiers, tops = _up(rows)
    ordered = tops.select(F.lit("").alias("grp"), (F.row_number().over(Window.orderBy("grp")) - 1).cast("long").alias("at"), "node", F.col("grp").alias("of"))
    ordered = stage(ordered, "subroots")
    *upper, top = _up(ordered)
    first = top.first()
    root = first["node"] if first else ""
    over = _down(upper, top.select("grp", F.lit("").alias("path"), F.col("node").alias("top")))
    over = over.drop("grp", "top").join(ordered.select("at", F.col("of").alias("grp"), F.col("node").alias("top")), "at")
    above = stage(over.select("grp", "path", "top"), "above")

    def make():
        def work(batch):
            flat, ends = _slots(batch)
            hashes, changed = flat.field("node").to_pylist(), flat.field("changed").to_pylist()
            n, paths = batch.column("n").to_pylist(), batch.column("path").to_pylist()
            of, proofs, folded = [], [], []
            for i in range(len(n)):
                start, end = int(ends[i]), int(ends[i + 1])
                levels = _grown(hashes[start:end], _height(n[i]))
                over = _steps(paths[i])
                for slot in range(end - start):
                    steps = _steps(_path(levels, slot)) + over
                    node = changed[start + slot] or hashes[start + slot]
                    for side, other in steps:
                        node = _joined(other, node) if side == "L" else _joined(node, other)
                    of.append(i)
                    proofs.append(sha256("".join([other for _, other in steps]).encode()).hexdigest())
                    folded.append(node)
            return {
                "doc_id": flat.field("doc_id"),
                "leaf": flat.field("node"),
                "subroot": batch.column("top").take(of),
                "root": [root] * len(of),
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [f == root for f in folded],
            }

        return work

    below = _down(tiers[1:], above) if len(tiers) > 1 else above.withColumn("at", F.lit(0).cast("long"))
    over = below.select(F.col("grp").alias("g"), F.col("at").alias("a"), "path", "top")
    met = tiers[0].join(over, (F.col("grp") == F.col("g")) & (F.col("block") == F.col("a"))).drop("g", "a")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return by_batch(met, make, schema)
