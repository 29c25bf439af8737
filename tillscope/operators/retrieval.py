"""Retrieval corpus, exact cosine top-n, context text and prompts."""

from __future__ import annotations

import math
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions import text
from tillscope.functions.literals import label_lookup, literal_frame
from tillscope.operators.attribution import explained
from tillscope.session import stage

# The helpers below travel to the workers with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How many neighbours, and the distance beyond which none is useful.
NEIGHBOURS = 3
MAX_DISTANCE = 0.6


def build_corpus(flat: DataFrame) -> DataFrame:
    """Documents and metadata of root causes, keyed ``kpi_date``."""
    return flat.select(
        text.narrative_key(F.col("kpi_name"), F.col("date")).alias("id"),
        text.anomaly_document().alias("document"),
        "kpi_name",
        F.col("date").cast("string").alias("date"),
        F.coalesce("anomaly_severity", F.lit("unknown")).alias("severity"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        text.side(F.col("total_deviation")).alias("direction"),
    )


def refresh_corpus(existing: DataFrame | None, flat: DataFrame, force: bool = False) -> DataFrame:
    """What a build leaves behind: the stored corpus untouched unless empty or forced."""
    built = build_corpus(flat)
    if existing is None or force:
        return built
    # A stored corpus of any size wins; only an empty one lets the new rows through.
    stored_rows = existing.agg(F.count(F.lit(1))).scalar()
    return existing.unionByName(built.where(stored_rows == 0))


def missing_documents(existing: DataFrame, flat: DataFrame) -> DataFrame:
    """Documents not stored yet, for appending."""
    return build_corpus(flat).join(existing.select("id"), "id", "left_anti")


_PAIRS = "query_id string, id string, distance double"
#: Rounding allowed for when a bound on an angle decides.
_SLACK = 1e-6
#: Groups that get cells of their own, and numbers that all their pivots may hold: the bound of the index.
_GROUPS, _INDEX = 10_000, 1 << 22
#: Regions of a group and parts of a region's visitors: each row is shipped no oftener, however many there are.
_REGIONS, _VISITOR_PARTS = 32, 16
#: Numbers of the vectors of a region, and query rows whose visits are sought at once.
_REGION_NUMBERS, _ASKED_ROWS = 1 << 24, 512


def _angles(unit: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ to.T, -1.0, 1.0))


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows with a direction, and these as unit vectors of ``width`` numbers.

    A vector of another length counts as filled with zeros, so numbers beyond ``width``, which no
    stored vector has, matter for the length alone. Null and zero vectors, and such with null,
    NaN or infinite numbers have no direction.
    """
    sizes = column.value_lengths()
    if column.null_count == 0 and column.flatten().null_count == 0 and len(column) and (sizes.to_numpy(zero_copy_only=False) == width).all():
        at, unit = np.arange(len(column)), column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        size = np.linalg.norm(unit, axis=1)
    else:
        rows = [(i, np.array(v, np.float64)) for i, v in enumerate(column.to_pylist()) if v is not None and None not in v]
        at, unit, size = np.array([i for i, _ in rows], np.int64), np.zeros((len(rows), width)), np.array([np.linalg.norm(v) for _, v in rows])
        for k, (_, v) in enumerate(rows):
            unit[k, : min(width, len(v))] = v[:width]
    ok = np.flatnonzero((size > 0) & np.isfinite(size))
    return at[ok], unit[ok] / size[ok, None]


def _spread(unit: np.ndarray, n: int) -> np.ndarray:
    """The numbers of ``n`` rows far from each other: each is the farthest from those before it."""
    chosen, nearest = [0], 1.0 - unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, 1.0 - unit @ unit[chosen[-1]])
    return np.array(chosen)


class _Cells:
    """The cells of one group in two levels: rows under the nearest top pivot, there in the cell of the nearest pivot.

    Pivots are stored rows. With every cell, and everything under a top pivot, goes the greatest
    angle of a row to its pivot: rows within an angle of a query lie only where the query's angle
    to the pivot is no more than both together.
    """

    def __init__(self, ids: list[str], unit: np.ndarray, most: int):
        """From drawn rows: top pivots spread among all, and under each its share of ``most`` spread among its rows."""
        tops = _spread(unit, max(1, math.ceil(math.sqrt(min(most, len(unit))))))
        nearest = _angles(unit, unit[tops]).argmin(axis=1)
        # every top pivot holds itself, so none is without cells
        nearest[tops] = np.arange(len(tops))
        chosen, self.under = [], []
        for t, top in enumerate(tops):
            own = np.append(top, np.setdiff1d(np.flatnonzero(nearest == t), tops))
            picked = own[_spread(unit[own], max(1, round(most * len(own) / len(unit))))]
            self.under.append(len(chosen) + np.arange(len(picked)))
            chosen += picked.tolist()
        self.ids, self.pivots, self.tops = np.array(ids, dtype=object)[chosen], unit[chosen], unit[tops]
        pivots, tops = self.pivots, len(tops)
        self.radius, self.top_radius, self.blocks = np.full(len(pivots), -1.0), np.full(tops, -1.0), np.ones(len(pivots), np.int64)
        self.held, self.top_held = np.zeros(len(pivots), np.uint64), np.zeros(tops, np.uint64)
        self.rows = np.zeros(len(pivots), np.int64)
        self.first, self.span = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)

    def tell(self, cell: int, top: int, n: int, radius: float, top_radius: float, held: int, block_rows: int) -> None:
        """What was measured of a cell; ``held`` has a bit for every remainder of its ids' hashes."""
        bits = np.uint64(held & 0xFFFFFFFFFFFFFFFF)
        self.radius[cell], self.blocks[cell], self.held[cell], self.rows[cell] = radius, -(-n // block_rows), bits, n
        self.top_radius[top] = max(self.top_radius[top], top_radius)
        self.top_held[top] |= bits

    def gather(self, rows: int) -> None:
        """Put cells into regions of about ``rows`` rows: small neighbouring cells share one, a large cell has several."""
        at, held = 0, 0
        for cell, n in enumerate(self.rows.tolist()):
            if held and held + n > rows:
                at, held = at + 1, 0
            self.first[cell], self.span[cell] = at, max(1, -(-n // rows))
            if n > rows:
                at += int(self.span[cell])
            else:
                held += n

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every row its cell, its angle to the pivot, and the same of the top pivot."""
        to_tops = _angles(unit, self.tops)
        top = to_tops.argmin(axis=1)
        cell, angle = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for t in np.unique(top):
            rows, own = np.flatnonzero(top == t), self.under[t]
            near = _angles(unit[rows], self.pivots[own])
            best = near.argmin(axis=1)
            cell[rows], angle[rows] = own[best], near[np.arange(len(rows)), best]
        return cell, angle, top, to_tops[np.arange(len(unit)), top]

    def visits(self, unit: np.ndarray, ids: np.ndarray, n: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that can hold one of the ``n`` nearest of a row within ``reach``.

        The n-th nearest pivot is no nearer than the n-th nearest row, and the farthest place in a
        cell with n other ids is no nearer either. Both are sought under the nearest top pivot,
        and pivots among all where that has too few.
        """
        to_tops = _angles(unit, self.tops)
        full, top_full = np.bitwise_count(self.held) > n, np.bitwise_count(self.top_held) > n
        limit = (to_tops + np.where(top_full, self.top_radius, np.inf)).min(axis=1)
        nearest = to_tops.argmin(axis=1)
        for t in np.unique(nearest):
            rows, own = np.flatnonzero(nearest == t), self.under[t]
            if len(own) <= n:
                own = np.arange(len(self.pivots))
            near = _angles(unit[rows], self.pivots[own])
            limit[rows] = np.minimum(limit[rows], (near + np.where(full[own], self.radius[own], np.inf)).min(axis=1))
            near[ids[rows][:, None] == self.ids[own][None, :]] = np.inf
            if len(own) >= n:
                limit[rows] = np.minimum(limit[rows], np.partition(near, n - 1, axis=1)[:, n - 1])
        limit = np.minimum(limit, reach) + _SLACK
        found = []
        for t, own in enumerate(self.under):
            rows = np.flatnonzero(to_tops[:, t] - self.top_radius[t] <= limit) if self.top_radius[t] >= 0 else []
            if len(rows):
                near = _angles(unit[rows], self.pivots[own])
                row, cell = np.nonzero((near - self.radius[own] <= limit[rows, None]) & (self.radius[own] >= 0))
                found.append((rows[row], own[cell]))
        return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))


def _by_group(batch, width: int):
    """(grp, ids, unit vectors) of every group in a batch."""
    at, unit = _unit(batch.column("vector"), width)
    grp = np.array(batch.column("grp").to_pylist(), dtype=object)[at]
    ids = np.array(batch.column("id").to_pylist(), dtype=object)[at]
    for g in set(grp.tolist()):
        rows = np.flatnonzero(grp == g)
        yield g, ids[rows], unit[rows]


def _batch(columns: dict) -> pa.RecordBatch:
    kinds = {"vector": pa.list_(pa.float64()), "wanted": pa.list_(pa.float64()), "cell": pa.int64(), "block": pa.int64(), "region": pa.int64(), "n": pa.int64(), "top": pa.int64(), "held": pa.int64(), "radius": pa.float64(), "top_radius": pa.float64()}
    arrays = {}
    for name, values in columns.items():
        kind = kinds.get(name, pa.string())
        if isinstance(values, np.ndarray) and values.ndim == 2:
            ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            arrays[name] = pa.ListArray.from_arrays(ends, np.ascontiguousarray(values).ravel())
        else:
            arrays[name] = pa.array(values, kind)
    return pa.RecordBatch.from_pydict(arrays)


def _cut(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The block of its cell that a row is in."""
    return np.array([zlib.crc32(i.encode()) for i in ids], np.int64) % blocks


def _measured(index: dict[str, _Cells], width: int):
    """Rows, radius and top radius of every cell, batch by batch."""

    def measure(batches):
        for batch in batches:
            for grp, ids, unit in _by_group(batch, width):
                if grp in index:
                    cell, angle, top, top_angle = index[grp].place(unit)
                    found, at, n = np.unique(cell, return_inverse=True, return_counts=True)
                    radius, top_radius, tops = np.zeros(len(found)), np.zeros(len(found)), np.zeros(len(found), np.int64)
                    np.maximum.at(radius, at, angle)
                    np.maximum.at(top_radius, at, top_angle)
                    tops[at] = top
                    held = np.zeros(len(found), np.uint64)
                    np.bitwise_or.at(held, at, np.uint64(1) << np.array([zlib.crc32(i.encode()) & 63 for i in ids], np.uint64))
                    yield _batch({"grp": [grp] * len(found), "cell": found, "n": n, "radius": radius, "top": tops, "top_radius": top_radius, "held": held.view(np.int64)})

    return measure


def _region_rows(n: int, width: int, block_rows: int) -> int:
    """Rows of a region: ``block_rows``, or a group's share if that is more, as far as memory allows."""
    return max(block_rows, min(-(-n // _REGIONS), max(1, _REGION_NUMBERS // width)))


def _stored(index: dict[str, _Cells], width: int, other_regions: int):
    """Stored rows with their cell and, as block, their region; groups without cells are one cell, -1, cut by a hash of the id."""

    def place(batches):
        for batch in batches:
            for grp, ids, unit in _by_group(batch, width):
                cells = index.get(grp)
                cell = cells.place(unit)[0] if cells else np.full(len(ids), -1)
                region = cells.first[cell] + _cut(ids, cells.span[cell]) if cells else _cut(ids, other_regions)
                yield _batch({"grp": [grp] * len(ids), "id": ids, "vector": unit, "cell": cell, "block": region})

    return place


def _some_rows(batches, width: int):
    """(grp, ids, unit vectors) of some rows of a group, so few that their visits fit into memory."""
    for batch in batches:
        for grp, ids, unit in _by_group(batch, width):
            for at in range(0, len(ids), _ASKED_ROWS):
                yield grp, ids[at : at + _ASKED_ROWS], unit[at : at + _ASKED_ROWS]


def _several(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from ``first`` on, for each pair."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)


def _visits(index: dict[str, _Cells], width: int, n: int, reach: float):
    """For inspection: the cells that query rows visit; groups without cells are one cell, -1."""

    def place(batches):
        for grp, ids, unit in _some_rows(batches, width):
            cells = index.get(grp)
            row, cell = cells.visits(unit, ids, n, reach) if cells else (np.arange(len(ids)), np.full(len(ids), -1))
            blocks = cells.blocks[cell] if cells else np.ones(len(row), np.int64)
            if len(row):
                yield _batch({"grp": [grp] * int(blocks.sum()), "query_id": np.repeat(ids[row], blocks), "cell": np.repeat(cell, blocks), "block": _several(np.zeros(len(blocks), np.int64), blocks)})

    return place


def _asked(index: dict[str, _Cells], width: int, other_regions: int, n: int, reach: float, vectors: bool = True):
    """Query rows once for every region that holds a cell they visit."""

    def place(batches):
        for grp, ids, unit in _some_rows(batches, width):
            cells = index.get(grp)
            if cells:
                row, cell = cells.visits(unit, ids, n, reach)
                first, span = cells.first[cell], cells.span[cell]
            else:
                row, first, span = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.full(len(ids), other_regions)
            row, region = np.unique(np.stack([np.repeat(row, span), _several(first, span)]), axis=1) if len(row) else (row, row)
            made = {"grp": [grp] * len(row), "query_id": ids[row], "region": region}
            if len(row):
                yield _batch(made | {"wanted": unit[row]} if vectors else made)

    return place


def _block_neighbours(n: int, max_distance: float | None, numbers: int = 1 << 22):
    """The n nearest corpus rows of one region for each query row that visits it, ``numbers`` distances at a time."""

    target = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("distance", pa.float64())])

    def matrix(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
        return flat.reshape(len(column), -1)[order]

    def search(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return target.empty_table()
        ids = np.array(corpus.column("id").to_pylist(), dtype=object)
        query_ids = np.array(queries.column("query_id").to_pylist(), dtype=object)
        by_id = np.argsort(ids, kind="stable")
        ids, targets = ids[by_id], matrix(corpus.column("vector"), by_id).T
        sought = matrix(queries.column("wanted"), np.arange(len(query_ids)))
        # equal ids lie together
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        own = {i: (a, b) for i, a, b in zip(ids[starts], starts, np.append(starts[1:], len(ids)))}
        out, chunk = [], max(1, numbers // len(ids))
        for start in range(0, len(query_ids), chunk):
            mine = query_ids[start : start + chunk]
            likeness = sought[start : start + chunk] @ targets
            for i, query_id in enumerate(mine):
                if query_id in own:
                    likeness[i, slice(*own[query_id])] = -np.inf
            if n < len(ids):
                # all that are not beyond the n-th distance, so that ties still go by id; more than what is rounded off is allowed for
                limit = np.partition(likeness, len(ids) - n, axis=1)[:, len(ids) - n]
                row, column = np.nonzero((likeness >= limit[:, None] - 1e-11) & np.isfinite(likeness))
            else:
                row, column = np.nonzero(np.isfinite(likeness))
            # equal vectors must tie whatever the shape of the product
            near = np.round(1.0 - likeness[row, column], 12)
            if max_distance is not None:
                within = near <= max_distance
                row, column, near = row[within], column[within], near[within]
            # corpus rows are in the order of their ids
            order = np.lexsort((column, near, row))
            row, column, near = row[order], column[order], near[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < n
            out.append((mine[row[kept]], ids[column[kept]], near[kept]))
        made = map(np.concatenate, zip(*out))
        return pa.Table.from_arrays([pa.array(list(m), type=f.type) for m, f in zip(made, target)], schema=target)

    return search


def _nearest(found: DataFrame, n: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _index(corpus: DataFrame, block_rows: int, pivots: int | None) -> tuple[dict[str, _Cells], int, int, int]:
    """The cells of each group, the width of the vectors, the regions of a group without cells, and the rows.

    A group of n rows gets about 2 sqrt(n) pivots, spread among four times as many rows drawn by
    a hash of the id, and their number is cut only where all would pass the index's bound; groups of few rows, and
    those beyond the largest 10,000, are one cell each.
    """
    sizes = corpus.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"))
    largest = sizes.orderBy(F.desc("n"), "grp").limit(_GROUPS).collect()
    width = max((r["width"] for r in largest), default=0)
    if len(largest) == _GROUPS:
        width = sizes.agg(F.max("width")).first()[0]
    if width < 1:
        return {}, 0, 1, 0
    quota = {r["grp"]: pivots or math.ceil(2 * math.sqrt(r["n"])) for r in largest if pivots or r["n"] >= 64}
    share = min(1.0, _INDEX / width / max(1, sum(quota.values())))
    quota = {g: max(1, int(q * share)) for g, q in quota.items()}
    # squares of finite numbers above zero: NaN is the greatest number, a null makes the sum null
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    able = corpus.where((squares > 0) & (squares < float("inf")))
    draw = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30))
    counts = {r["grp"]: r["n"] for r in largest}
    rows = []
    if quota:
        # rows without a direction leave the draw, so it is wider than needed
        below = {g: min(1 << 30, int(8 * q / counts[g] * (1 << 30)) + 1) for g, q in quota.items()}
        if len(below) <= 100:
            drawn = able.withColumn("draw", draw).where(F.col("draw") < label_lookup(F.col("grp"), below, F.lit(0)))
        else:
            wide = corpus.sparkSession.createDataFrame(list(below.items()), "of string, below long")
            drawn = able.withColumn("draw", draw).join(wide, F.col("grp") == F.col("of")).where("draw < below")
        rows = drawn.select("grp", "id", "vector", "draw").orderBy("draw", "id").limit(4 * sum(quota.values())).collect()
        short = set(quota) - {r["grp"] for r in rows}
        if short:
            rows += able.where(F.col("grp").isin(*sorted(short)[:1000])).select("grp", "id", "vector", draw.alias("draw")).orderBy("draw", "id").limit(4 * sum(quota.values())).collect()
    index = {}
    for grp, most in quota.items():
        own = [r for r in rows if r["grp"] == grp][: 4 * most]
        if own:
            at, unit = _unit(pa.array([r["vector"] for r in own], pa.list_(pa.float64())), width)
            if len(at):
                index[grp] = _Cells([own[i]["id"] for i in at], unit, most)
    others = [r["n"] for r in largest if r["grp"] not in index]
    if len(largest) == _GROUPS:
        others.append(largest[-1]["n"])
    if index:
        measured = corpus.mapInArrow(_measured(index, width), "grp string, cell long, n long, radius double, top long, top_radius double, held long")
        most = [F.max(c).alias(c) for c in ("radius", "top_radius")]
        for r in measured.groupBy("grp", "cell", "top").agg(F.sum("n").alias("n"), *most, F.bit_or("held").alias("held")).collect():
            index[r["grp"]].tell(r["cell"], r["top"], r["n"], r["radius"], r["top_radius"], r["held"], block_rows)
        for cells in index.values():
            cells.gather(_region_rows(int(cells.rows.sum()), width, block_rows))
    n_rows = sum(r["n"] for r in largest) if len(largest) < _GROUPS else corpus.count()
    most_others = max(others, default=1)
    return index, width, max(1, -(-most_others // _region_rows(most_others, width, block_rows))), n_rows


def similar_topk(
    queries: DataFrame,
    corpus: DataFrame,
    n: int = NEIGHBOURS,
    max_distance: float | None = MAX_DISTANCE,
    same_kpi_only: bool = False,
    block_rows: int = 8192,
    pivots: int | None = None,
    visited: list | None = None,
) -> DataFrame:
    """The ``n`` nearest corpus rows by cosine distance for each query row, exactly.

    Both sides carry ``(id, kpi_name, embedding)``; a row never retrieves itself. Corpus rows lie
    in cells of two levels, about twice the square root of their number (``pivots`` names another).
    A query visits the cells that can hold a row within ``max_distance`` and within its n-th
    nearest pivot, by the triangle inequality on angles; among rows in clusters that is about
    n cells' worth of rows. Neighbouring cells make regions of about ``block_rows``, of more
    where a group would have over 32; a region's rows and its visitors, these in at most 16
    parts, meet in groups of their own, which ship only their best ``n`` per query. So a row is shipped
    at most some 64 times as a query and 16 as a stored one, until regions reach their bound in memory. The index
    of pivots and radii is at most 32 MB. Vectors of another length count as filled with
    zeros; those without a direction (null, zero, NaN) or an id find nothing and are not found.
    ``visited`` takes, for inspection, the frame of (query, cell) visits.
    """
    group = F.col("kpi_name").cast("string") if same_kpi_only else F.lit("all")

    def rows(df):
        known = df.where("id is not null and kpi_name is not null") if same_kpi_only else df.where("id is not null")
        return known.select(group.alias("grp"), F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))

    spark = corpus.sparkSession
    index, width, other_regions, n_rows = _index(rows(corpus), block_rows, pivots)
    if not width:
        return spark.createDataFrame([], "query_id string, id string, distance double, rank int")
    reach = math.pi if max_distance is None else math.acos(max(-1.0, 1.0 - max_distance))
    any_queries = n_rows if queries is corpus else queries.count()
    c = rows(corpus).mapInArrow(_stored(index, width, other_regions), "grp string, id string, vector array<double>, cell long, block long").withColumnRenamed("block", "region")
    ask = lambda vectors: _asked(index, width, other_regions, n, reach, vectors)
    place = "grp string, query_id string, region long"
    q = rows(queries).mapInArrow(ask(True), f"{place}, wanted array<double>")
    if visited is not None:
        visited.append(rows(queries).mapInArrow(_visits(index, width, n, reach), "grp string, query_id string, cell long, block long"))
    key = ["grp", "region"]
    # the visitors of a region are many only if the queries are
    if any_queries > block_rows:
        visits = rows(queries).mapInArrow(ask(False), place).groupBy(*key).agg(F.count(F.lit(1)).alias("visits"))
        most = F.least(F.ceil(F.col("visits") / block_rows), F.greatest(F.lit(_VISITOR_PARTS), F.ceil(F.col("visits") * width / _REGION_NUMBERS)))
        parts = stage(visits.select(*key, most.cast("int").alias("parts")), "visitor_parts")
        q = q.join(parts, key).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int"))
        c = c.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = [*key, "part"]
    found = q.select(*key, "query_id", "wanted").groupBy(*key).cogroup(c.select(*key, "id", "vector").groupBy(*key)).applyInArrow(_block_neighbours(n, max_distance), _PAIRS)
    return _nearest(found, n).withColumn("distance", F.round("distance", 4))


def with_metadata(neighbours: DataFrame, corpus: DataFrame) -> DataFrame:
    """Document, KPI, date and severity of each neighbour."""
    return neighbours.join(corpus.select("id", "document", "kpi_name", "date", "severity"), "id")


# Fixed formats: the two context lines.
NO_CONTEXT = "No similar historical anomalies found."
CONTEXT_HEADING = "Similar historical anomalies for context:"


def context_block(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Numbered context text per query id; a query without neighbours gets the fixed line.

    ``neighbours`` has at most n rows per query, so collecting them per query is bounded.
    """
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("kpi_name"), F.lit(" anomaly in "),
        text.month_year(F.col("date").cast("date")), F.lit(" (severity: "), F.col("severity"), F.lit("): "), F.col("document"),
    )
    lines = neighbours.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")
    )
    body = F.concat(F.lit(CONTEXT_HEADING + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return (
        queries.select(F.col("id").alias("query_id"))
        .join(lines, "query_id", "left")
        .select("query_id", F.when(F.col("lines").isNull(), NO_CONTEXT).otherwise(body).alias("context"))
    )


# --------------------------------------------------------------------- prompts

# Used when no prompt catalogue is given. The placeholders are those of the catalogue.
DEFAULT_PROMPT = (
    "v1",
    "Built-in wording",
    "Write a short business summary of this anomaly for an executive.\n"
    "Metric: {kpi}\nDate: {date}\nSeverity: {severity}\n"
    "The metric was {deviation_pct:.1f}% {direction} expected.\nMain drivers: {drivers_text}\n",
)


def prompt_catalogue(spark, versions: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Prompt versions ``(id, description, template)`` in order; the last one is current."""
    rows = [(i, *v) for i, v in enumerate(versions or [DEFAULT_PROMPT])]
    return literal_frame(spark, rows, ["position", "id", "description", "template"])


def latest_prompt(prompts: DataFrame) -> DataFrame:
    return prompts.orderBy(F.desc("position")).limit(1)


def fill_once(template: Column, fills: dict[str, Column]) -> Column:
    """``template`` with its marks replaced by their values; a mark within a value is left as it is."""
    marks = "|".join(re.escape(m) for m in sorted(fills, key=len, reverse=True))
    values = F.create_map(*[x for mark, value in fills.items() for x in (F.lit(mark), F.coalesce(value, F.lit("")))])
    found = F.concat(F.regexp_extract_all(template, F.lit(marks), F.lit(0)), F.array(F.lit("")))
    parts = F.zip_with(F.split(template, marks, -1), found, lambda text_, m: F.concat(text_, F.coalesce(F.try_element_at(values, m), F.lit(""))))
    return F.array_join(parts, "")


def retrieved_prompts(flat: DataFrame, corpus: DataFrame, vectors: DataFrame, prompts: DataFrame, n: int = NEIGHBOURS, max_distance: float | None = MAX_DISTANCE) -> DataFrame:
    """The retrieval prompt of every root cause: its nearest stored anomalies of the same KPI as context.

    ``corpus`` holds the stored documents, ``vectors`` (id, kpi_name, embedding) the vectors of
    documents and causes under the same ids.
    """
    near = similar_topk(vectors, vectors, n, max_distance, same_kpi_only=True)
    context = context_block(corpus, with_metadata(near, corpus))
    ids = corpus.select(F.col("id").alias("query_id"), "kpi_name", F.to_date("date").alias("date"))
    placed = flat.join(ids.join(context, "query_id"), ["kpi_name", "date"])
    return render_prompts(placed, prompts, F.col("context"))


def render_prompts(flat: DataFrame, prompts: DataFrame, context: Column | None = None) -> DataFrame:
    """Fill the current template for each root cause.

    With ``context`` the retrieval form is rendered: the context fills ``{context}`` and
    drivers are listed without their shares.
    """
    empty = "no specific segment identified"
    drivers = text.drivers_with_share(empty) if context is None else text.drivers_plain(empty)
    fills = {
        "{kpi}": text.document_label(F.col("kpi_name")),
        "{date}": F.date_format("date", "MMMM dd, yyyy"),
        "{severity}": F.upper("anomaly_severity"),
        "{deviation_pct:.1f}": F.format_string("%.1f", F.abs("total_deviation_pct")),
        "{direction}": text.side(F.col("total_deviation")),
        "{drivers_text}": drivers,
    }
    if context is not None:
        fills["{context}"] = context
    current = latest_prompt(prompts).select(F.struct("id", "template")).scalar()
    prompt = fill_once(F.col("_prompt")["template"], fills)
    return flat.withColumn("_prompt", current).select(
        "kpi_name", "date", F.col("_prompt")["id"].alias("prompt_version"), prompt.alias("prompt")
    )


# ------------------------------------------------------------------ narratives


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", text.narrative_key(F.col("kpi_name"), F.col("date")))


def pending_narratives(root_causes: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Explained causes without a stored narrative; all of them when forced."""
    keyed = with_key(explained(root_causes))
    return keyed if force else keyed.join(existing.select("key"), "key", "left_anti")


def narrative_lookup(rows: DataFrame, narratives: DataFrame) -> DataFrame:
    return with_key(rows).join(narratives.select("key", "narrative"), "key", "left")


def narrative_compare(standard: DataFrame, retrieval: DataFrame) -> DataFrame:
    """Narratives present in both sets, side by side."""
    left = standard.select(
        "key", F.coalesce("prompt_version", F.lit("v2")).alias("standard_version"), F.col("narrative").alias("standard")
    )
    right = retrieval.select(
        "key",
        F.coalesce("prompt_version", F.lit("v2-rag")).alias("rag_version"),
        F.col("narrative").alias("rag"),
        F.coalesce(F.size("retrieved_context"), F.lit(0)).alias("n_retrieved"),
    )
    return left.join(right, "key").withColumn(
        "display", F.concat_ws(" — ", text.key_label(F.col("key")), text.key_date(F.col("key")))
    )


def parse_narratives(entries: DataFrame, narrative_type: str, now: Column | None = None) -> DataFrame:
    """File entries to table rows: name variants merged, undated and empty entries dropped."""
    blank = ("NaT", "nan", "None", "")

    def given(name):
        return F.when(~F.col(name).isin(*blank), F.col(name))

    # The first non-empty date decides; if it is not a date the entry is dropped.
    raw_date = F.coalesce(F.when(F.col("anomaly_date") != "", F.col("anomaly_date")), F.col("date"))
    date = F.when(~raw_date.isin(*blank), F.to_date(F.try_to_timestamp(raw_date)))
    body = F.coalesce(F.when(F.col("narrative") != "", F.col("narrative")), F.col("narrative_text"), F.lit(""))
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    context = F.col("retrieved_context")
    return entries.select(
        "kpi_name",
        date.alias("anomaly_date"),
        F.lit(narrative_type).alias("narrative_type"),
        F.coalesce("prompt_version", F.lit("unknown")).alias("prompt_version"),
        body.alias("narrative_text"),
        F.when(F.size(context) > 0, F.to_json(context)).alias("retrieved_context"),
        F.coalesce(F.to_timestamp_ntz(given("generated_at")), now).alias("generated_at"),
    ).where(F.col("anomaly_date").isNotNull() & (F.col("narrative_text") != ""))
