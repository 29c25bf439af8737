"""Small fixed tables, built so that the planner knows how small they are."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_frame(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def label_lookup(key, labels: dict, other=None):
    """The label of ``key``; when it has none, ``other`` or else the key itself."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key if other is None else other)
