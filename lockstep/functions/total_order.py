"""Positions in a total order without ordering all rows in one task.

Rows are cut into parts by bounds that a bounded sample of their keys gives; the sizes of
the parts, a fixed number of rows, give each part's first position, and only rows of one
part are ordered together.  Bounds are constants of the plan, so every pass over the
rows cuts them alike; which bounds they are decides how even the parts are, never a
position.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys a part.
LOOKS = 32


def _bounds(keyed: DataFrame, parts: int) -> list[tuple]:
    # One key of each hash bucket, drawn by a second hash: one pass that combines before its shuffle.
    looked = keyed.groupBy(F.pmod(F.xxhash64("_key"), F.lit(LOOKS * parts)).alias("_look")).agg(
        F.min_by("_key", F.xxhash64("_key", F.lit(1))).alias("_key"))
    sample = sorted(tuple(r["_key"]) for r in looked.select("_key").collect())  # LOOKS * parts rows
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []


def _part(bounds: list[Column]) -> Column:
    """How many of the ascending bounds are not above the key: first among every so-many-th, then among those up to the next."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [F.array(*bounds[k:k + step]) for k in range(0, len(bounds), step)]
    through = lambda some: F.size(F.filter(some, lambda b: b <= F.col("_key")))
    coarse = through(F.array(*bounds[::step]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + through(F.get(F.array(*groups), coarse - 1)))


def with_position(df: DataFrame, order: list[Column], output: str = "position", parts: int | None = None) -> DataFrame:
    """Append the 1-based position of each row; ``order`` are ascending columns without nulls, unique together."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    kind = keyed.schema["_key"].dataType
    bounds = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(bound, kind.fields, strict=True)])
              for bound in _bounds(keyed, parts)]
    rows = keyed.withColumn("_part", _part(bounds))
    through = F.sum("count").over(Window.orderBy("_part"))  # one row a part
    starts = rows.groupBy("_part").count().select("_part", (through - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(
        output, F.col("_before") + F.col("_own")).drop("_key", "_part", "_own", "_before")
