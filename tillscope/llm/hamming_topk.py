"""Exact top-k by Hamming distance: multi-index hashing with growing segment radii."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillscope.session import stage

BITS = 64


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``code``: the signs of the first 64 numbers of a vector, the first in the lowest bit.

    Numbers beyond the 64th play no part. A positive number sets its bit; null, missing and other numbers do not. A null vector has
    code 0. Rows without an id are left out, for no result could name them.
    """
    bit = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(F.get(vector, i) > 0, F.expr("1L")).otherwise(F.expr("0L")))
    packed = F.aggregate(F.reverse(bit), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(packed, F.lit(0).cast("long")).alias("code"))


def _segments(codes: DataFrame, segments: int, name: str) -> DataFrame:
    width = BITS // segments
    mask = F.lit((1 << width) - 1).cast("long")
    values = [F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("code", s * width).bitwiseAND(mask).alias("value")) for s in range(segments)]
    return codes.select("*", F.explode(F.array(*values)).alias(name)).select(*codes.columns, f"{name}.seg", f"{name}.value")


def _bundles(rows: DataFrame, columns: list[str], bundle: int, tag: str) -> DataFrame:
    """Rows of one (seg, value) gathered into arrays of about ``bundle``, so no array grows with the table."""
    held = rows.groupBy("seg", "value").agg(F.ceil(F.count("*") / bundle).cast("int").alias("parts"))
    cut = rows.join(held, ["seg", "value"]).withColumn("part", F.pmod(F.xxhash64(*columns), "parts").cast("int"))
    return cut.groupBy("seg", "value", "part").agg(F.collect_list(F.struct(*columns)).alias(tag)).drop("part")


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 10, segments: int = 8, bundle: int = 2048) -> DataFrame:
    """The ``k`` codes of ``corpus`` nearest to every code of ``queries`` (both: id, code), ties by id.

    Every code is filed under the value of each of its segments. In round r a query visits the
    values that differ from its own in exactly r bits; whatever was not met by then differs in
    at least r + 1 bits in every segment. A query is done once its k-th distance is below
    ``segments * (r + 1)``, so the result is exact; it only takes codes that can still enter.
    Ids are whole numbers or strings, of one type on both sides; rows without one are left out.
    Returns query_id, rank (from 1), id and distance. A query is not its own result; equal codes
    under other ids are. Fewer than k others give as many rows as there are. Repeated rows count once.
    """
    width = BITS // segments
    # copies of a row would fill the places that a bundle has for its best k
    each = stage(corpus.where("id is not null").select("id", "code").distinct(), "distinct-codes")
    index = stage(_bundles(_segments(each, segments, "s"), ["id", "code"], bundle, "held"), "hamming-index")
    active = stage(queries.where("id is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query_code"), F.lit(BITS + 1).alias("bound")).distinct(), "queries")
    best = None
    done = []
    kind = corpus.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, query_code long, id {kind}, distance int"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def sortable(ids):
        return np.array(ids.to_pylist()) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False)

    def meet(batches):
        for batch in batches:
            for held, asked in zip(batch.column("held"), batch.column("asked")):
                held, asked = held.values.flatten(), asked.values.flatten()
                ids, have = sortable(held[0]), held[1].to_numpy().view(np.uint64)
                query, code, bound = sortable(asked[0]), asked[1].to_numpy(), asked[2].to_numpy()
                rows = [[], [], [], []]
                for q, c, b in zip(query, code, bound):
                    distance = np.bitwise_count(have ^ c.view(np.uint64))
                    # of equal distance to the k-th, a smaller id may still win
                    at = np.flatnonzero((distance <= b) & (ids != q))
                    if len(at) > k:
                        at = at[np.lexsort((ids[at], distance[at]))[:k]]
                    rows[0].append(np.full(len(at), q))
                    rows[1].append(np.full(len(at), c))
                    rows[2].append(ids[at])
                    rows[3].append(distance[at].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r), type=t.type) for r, t in zip(rows, target)], schema=target)

    def nearest(found: DataFrame) -> DataFrame:
        first = F.slice(F.array_sort(F.collect_set(F.struct("distance", "id"))), 1, k)
        return found.groupBy("query_id", "query_code").agg(first.alias("found"))

    for radius in range(width + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
        asked = _segments(active.withColumnRenamed("query_code", "code"), segments, "s").select("query_id", F.col("code").alias("query_code"), "bound", "seg", "value")
        probes = asked.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
        bundled = _bundles(probes, ["query_id", "query_code", "bound"], bundle, "asked")
        # planned sizes do not count the probes, so the join must not be left to them
        met = index.join(bundled.hint("merge"), ["seg", "value"]).select("held", "asked").mapInArrow(meet, schema)
        if best is not None:
            met = met.unionByName(best)
        ranked = active.select("query_id", "query_code").join(nearest(met), ["query_id", "query_code"], "left")
        ranked = stage(ranked, "nearest")
        last = F.coalesce(F.get("found", F.lit(k - 1))["distance"], F.lit(BITS + 1))
        over = (last < segments * (radius + 1)) if radius < width else F.lit(True)
        done.append(ranked.where(over))
        rest = ranked.where(~over)
        if radius == width or not rest.head(1):
            break
        active = rest.select("query_id", "query_code", last.alias("bound"))
        best = rest.where("found is not null").select("query_id", "query_code", F.explode("found").alias("f")).select("query_id", "query_code", F.col("f.id").alias("id"), F.col("f.distance").alias("distance"))
    full = done[0]
    for part in done[1:]:
        full = full.unionByName(part)
    places = full.where("found is not null").select("query_id", F.posexplode("found").alias("at", "f"))
    return places.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("id"), F.col("f.distance").cast("int").alias("distance"))


def every_hundredth(vectors: DataFrame, k: int = 10) -> DataFrame:
    """Top-k for every vector whose id is divisible by 100, against all vectors."""
    coded = stage(codes(vectors), "codes")
    return top_k(coded, coded.where("id % 100 = 0"), k)
