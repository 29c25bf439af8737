"""What several operators share: reading a table, the held-out fold, places in a global order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a Python worker is handed at once; it holds some copies of them.
_BATCH = "4m"
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; from here on tasks take its long texts from Spark in smaller batches than usual."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids whose crc32 (of the id as text) leaves 1; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salt(columns: list[Column], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def placed(df: DataFrame, group: list[str], order: list[str], out: str, salts: int = 256, size: str | None = None) -> DataFrame:
    """``df`` with ``out``: the rows (or the total ``size``) that come before a row in its group.

    The order is by a hash of ``order`` and then by ``order`` itself, so a group is cut into
    ``salts`` parts, each numbered on its own and shifted by what the parts before it hold:
    a group with any share of the rows is spread over that many tasks. ``df`` is read twice,
    so give it staged.
    """
    df = df.withColumn("__salt", salt([F.col(c) for c in order], salts))
    one = F.lit(1) if size is None else F.col(size)
    parts = df.groupBy(*group, "__salt").agg(F.sum(one).cast("long").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(f"__{c}") for c in group],
        F.col("__salt").alias("__part"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
    )
    within = Window.partitionBy(*group, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(one).over(within), F.lit(0))
    same = F.col("__salt") == F.col("__part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return (
        df.withColumn("__local", local)
        .join(parts, same)
        .withColumn(out, (F.col("__local") + F.col("__shift")).cast("long"))
        .select(*[c for c in df.columns if c != "__salt"], out)
    )


def by_batch(df: DataFrame, make, schema: str) -> DataFrame:
    """``make(batch) -> dict of columns`` over Arrow batches, where ``make()`` is built once per task."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, target = make(), to_arrow_schema(kind)
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                columns = [made[f.name] for f in target]
                arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, target)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, kind)
