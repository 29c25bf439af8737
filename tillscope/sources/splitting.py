"""Reading one file in many tasks where a record's end depends on what comes before it.

A file is read in byte ranges. What a range does to the state it is entered in (inside quotes,
how deep in brackets) is found for every range first; states are then carried from range to
range, of each of which the driver holds one, and every range is cut into records on its own.
A record that goes over the end of a range is put together from its parts.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.session import stage

# The helpers below travel to the workers with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARTS = "path string, start long, at int, ended boolean, listed boolean, value binary"
_ROWS = 1000


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """What lies between separators, in order, with the file and the range it was read in."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """The pieces of each range that a task reads."""
    held: list = [None, None]

    def pieces() -> Iterator[tuple[tuple[str, int], bytes]]:
        for batch in batches:
            starts = batch.column("start").to_pylist()
            for path, start, value in zip(batch.column("path"), starts, batch.column("value")):
                yield (path.as_py(), start), value.as_py()

    stream = pieces()
    held[0] = next(stream, None)

    def own(key) -> Iterator[bytes]:
        while held[0] is not None and held[0][0] == key:
            value = held[0][1]
            held[0] = next(stream, None)
            yield value

    while held[0] is not None:
        key = held[0][0]
        yield key, own(key)
        for _ in own(key):
            pass


def _emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("start", pa.int64()), ("at", pa.int32()), ("ended", pa.bool_()), ("listed", pa.bool_()), ("value", pa.binary())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5])
        if len(held) >= _ROWS or size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), kind)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), kind)], schema=kind)


def _stitched(parts: DataFrame, glue: bytes) -> DataFrame:
    """Records that go over the end of a range, from their parts: each begins in one range and ends in a later one.

    ``at`` is 0 for a part that goes on from the range before and 1 for one that begins a record;
    ``ended`` tells whether the record found its end in the file.
    """
    order = Window.partitionBy("path").orderBy("start", "at")
    numbered = parts.withColumn("record", F.sum("at").over(order))
    whole = numbered.groupBy("path", "record").agg(F.max("listed").alias("listed"), F.sort_array(F.collect_list(F.struct("start", "at", "value", "ended"))).alias("p"))
    joined = F.aggregate(F.slice("p", 2, 1 << 30), F.col("p")[0]["value"], lambda a, x: F.concat(a, F.lit(glue), x["value"]))
    return whole.select("listed", joined.alias("value"), F.element_at("p", -1)["ended"].alias("ended"))


# ------------------------------------------------------------------------ CSV


def _csv_parts(states: dict[str, dict[int, bool]], wanted: str):
    """Records of every range: the whole ones, or the parts of those that go over its ends."""

    def rows(batches) -> Iterator[tuple]:
        for (path, start), lines in _ranges(batches):
            if start not in states.get(path, ()):
                raise RuntimeError(f"{path} is read in other ranges than when its quotes were counted; read it anew")
            inside = states[path][start]
            held: list[bytes] = []
            # a range that begins inside quotes goes on with a record of the one before it
            going_on, header = inside, start == 0
            for line in lines:
                held.append(line)
                inside ^= line.count(b'"') & 1 == 1
                if inside:
                    continue
                if going_on:
                    if wanted == "parts":
                        yield path, start, 0, True, False, b"\n".join(held)
                elif header:
                    header = False
                elif wanted == "whole" and (len(held) > 1 or held[0].strip()):
                    yield path, start, 1, True, False, b"\n".join(held)
                going_on = False
                held.clear()
            if held and wanted == "parts":
                yield path, start, 0 if going_on else 1, False, False, b"\n".join(held)

    return lambda batches: _emit(rows(batches))


def csv_records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``value``: the records of CSV files with a header, line breaks within quotes included.

    Quotes are those of RFC 4180: a field that holds a quote or a line break is quoted, quotes
    in it are doubled. A file is read in as many tasks as any text file.
    """
    lines = _pieces(spark, path, "\n")
    quotes = F.length("value") - F.length(F.call_function("replace", F.col("value").cast("string"), F.lit('"'), F.lit("")).cast("binary"))
    # 1 where the quotes of a range are odd; the sums tell the ranges that begin inside quotes
    odd = lines.groupBy("path", "start").agg((F.sum(quotes) % 2 == 1).alias("odd"))
    states: dict[str, dict[int, bool]] = defaultdict(dict)
    inside: dict[str, bool] = defaultdict(bool)
    for r in odd.orderBy("path", "start").toLocalIterator():
        states[r["path"]][r["start"]] = inside[r["path"]]
        inside[r["path"]] ^= r["odd"]
    states = dict(states)
    whole = lines.mapInArrow(_csv_parts(states, "whole"), _PARTS).select("value")
    # an end of the file inside quotes leaves a part that nothing ends, which is a record too
    if any(v for of in states.values() for v in of.values()) or any(inside.values()):
        parts = lines.mapInArrow(_csv_parts(states, "parts"), _PARTS)
        whole = whole.unionByName(_stitched(parts, b"\n").select("value"))
    text = F.decode("value", encoding)
    return whole.select(F.regexp_replace(text, "\r$", "").alias("value"))


# ----------------------------------------------------------------------- JSON

_SIGNS = re.compile(rb'\\.|["{}\[\]]', re.S)


def _scan(piece: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and how many brackets it opens more than it closes."""
    depth = 0
    for sign in _SIGNS.findall(piece):
        if sign == b'"':
            inside = not inside
        elif not inside:
            depth += 1 if sign in b"{[" else -1 if sign in b"}]" else 0
    return inside, depth


def _closed(piece: bytes, inside: bool, depth: int) -> tuple[bool, int]:
    """The state after a piece and the ``}`` that ended it."""
    inside, change = _scan(piece, inside)
    return inside, depth + change - (not inside)


#: The state where a ``}`` has just closed an entry of the outermost object or list.
_BETWEEN = (False, 1)


def _json_effects(batches) -> Iterator[pa.RecordBatch]:
    """What each range does to the state: per state it may begin in, the one it ends in and the change of depth."""
    names = [("path", pa.string()), ("start", pa.int64()), ("listed", pa.bool_()), ("out0", pa.bool_()), ("out1", pa.bool_()), ("depth0", pa.int64()), ("depth1", pa.int64())]
    kind = pa.schema(names)
    for (path, start), pieces in _ranges(batches):
        state, listed = [(False, 0), (True, 0)], None
        for piece in pieces:
            state = [_closed(piece, *s) for s in state]
            if listed is None and piece.strip():
                listed = piece.lstrip()[:1] == b"["
        made = (path, start, bool(listed), state[0][0], state[1][0], state[0][1], state[1][1])
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(made, kind)], schema=kind)


def _json_parts(states: dict[str, dict[int, tuple[bool, int]]], lists: set[str]):
    def rows(batches) -> Iterator[tuple]:
        for (path, start), pieces in _ranges(batches):
            if start not in states.get(path, ()):
                raise RuntimeError(f"{path} is read in other ranges than when its brackets were counted; read it anew")
            state, listed = states[path][start], path in lists
            going_on = start > 0 and state != _BETWEEN
            held: list[bytes] = []
            for piece in pieces:
                held.append(piece + b"}")
                state = _closed(piece, *state)
                if state == _BETWEEN:
                    yield path, start, 0 if going_on else 1, True, listed, b"".join(held)
                    going_on = False
                    held.clear()
            if held:
                yield path, start, 0 if going_on else 1, False, listed, b"".join(held)

    return lambda batches: _emit(rows(batches))


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of files that hold one object or one list: ``listed`` (it is of a list) and ``value``, an object or list of few entries.

    A file is cut at the ends of those outermost entries that are objects, in as many tasks as
    its size calls for, so neither a file nor its entries are ever held together. What lies
    between two such ends goes with the later one; what follows the last is left out.
    """
    pieces = _pieces(spark, path, "}")
    effects = pieces.mapInArrow(_json_effects, "path string, start long, listed boolean, out0 boolean, out1 boolean, depth0 long, depth1 long")
    states: dict[str, dict[int, tuple[bool, int]]] = defaultdict(dict)
    ends: dict[str, tuple[bool, int]] = defaultdict(lambda: (False, 0))
    lists = set()
    for r in effects.orderBy("path", "start").toLocalIterator():
        inside, depth = states[r["path"]][r["start"]] = ends[r["path"]]
        ends[r["path"]] = (r["out1"], depth + r["depth1"]) if inside else (r["out0"], depth + r["depth0"])
        if r["listed"] and len(states[r["path"]]) == 1:
            lists.add(r["path"])
    cut = pieces.mapInArrow(_json_parts(dict(states), lists), _PARTS)
    if any(len(of) > 1 for of in states.values()):
        cut = stage(cut, "json_parts")
        parts = _stitched(cut.where("at = 0 or not ended"), b"").where("ended")
        made = cut.where("at = 1 and ended").select("listed", "value").unionByName(parts.select("listed", "value"))
    else:
        made = cut.where("ended").select("listed", "value")
    # without the comma or bracket ahead of it, an entry is put into an object or list of its own
    entry = F.regexp_replace(F.col("value").cast("string"), r"^\s*[,{\[]", "")
    opened = F.when(F.col("listed"), F.concat(F.lit("["), entry, F.lit("]"))).otherwise(F.concat(F.lit("{"), entry, F.lit("}")))
    return made.select("listed", opened.alias("value"))
