"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import by_batch, placed
from tillscope.session import stage

# The multiplier of the published generator, and 2 to the power 31.
_STEP = np.uint64(2862933555777941757)
_SPAN = float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to ``shards`` - 1) of every unsigned 64-bit key.

    A key leaves shard ``b`` only for a shard that is new, so growing from n to n + 1
    shards moves about one key in n + 1, all of them into shard n.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    keys = keys.astype(np.uint64)
    at = np.zeros(len(keys), np.int64)
    active, state = np.arange(len(keys)), keys.copy()
    ahead = np.zeros(len(keys), np.int64)
    while len(active):
        at[active] = ahead[active]
        with np.errstate(over="ignore"):
            state[active] = state[active] * _STEP + np.uint64(1)
        draw = (state[active] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[active] = ((at[active] + 1) * (_SPAN / draw)).astype(np.int64)
        active = active[ahead[active] < shards]
    return at


def assign(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = None) -> DataFrame:
    """``df`` with ``out``, the shard of ``key``, and with ``grown``, its shard if one were added.

    The key is hashed as text, so the type of the column does not matter. A null key counts as
    one fixed key; repeated keys share a shard. All columns of ``df`` pass through Python, so
    give it narrow.
    """
    columns = df.columns

    def make():
        def work(batch):
            keys = batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            made = {c: batch.column(c) for c in columns}
            made[out] = jump(keys, shards)
            if grown:
                made[grown] = jump(keys, shards + 1)
            return made

        return work

    keyed = df.withColumn("__key", F.xxhash64(F.col(key).cast("string")))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{c}` int" for c in (out, grown) if c])
    return by_batch(keyed, make, fields)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document with its shard, its place there and its shard after one more is added.

    Size is the UTF-8 length of the text plus 1 (null: 1, crc32 0). ``slot`` is gapless from 0
    in each shard. Equal rows get different slots; an empty table gives an empty result.
    """
    octets = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sized = docs.select(
        "doc_id",
        (F.octet_length(octets) + 1).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
    )
    sharded = stage(assign(sized, "doc_id", shards, "shard", "grown_shard"), "shards")
    return placed(sharded, ["shard"], ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
