"""Numbering rows in an order, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are sampled to cut an order into ranges, about, and the ranges, at most.
SAMPLED, RANGES = 4000, 200


def numbered(rows: DataFrame, by: tuple[str, ...] = ("block_id", "start", "end"), out: str = "place", keys: DataFrame | None = None) -> DataFrame:
    """Number rows from 1 in the order of ``by``, without any task that sees all rows.

    Sampled values of the first column cut the order into ranges; rows are numbered within ranges, and the counts of the
    ranges before are added.  A null comes first.  ``keys`` may have values of the first column that are cheaper to read
    than those of ``rows``; they decide where ranges end and nothing else.
    """
    keys = rows if keys is None else keys
    first = F.col(by[0])
    total = keys.agg(F.approx_count_distinct(first)).first()[0]
    share = min(1.0, SAMPLED / max(1, total))
    chosen = keys.where(F.xxhash64(first) <= min(int(share * 2**64) - 2**63, 2**63 - 1)).where(first.isNotNull())
    found = sorted(r[0] for r in chosen.select(first).distinct().collect())  # about SAMPLED values
    cuts = found[:: max(1, -(-len(found) // RANGES))]
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= first)) if cuts else F.lit(0)
    ranged = rows.withColumn("__range", F.when(first.isNull(), -1).otherwise(place))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # a row per range
    before = counts.selectExpr("__range", "coalesce(sum(__n) over (order by __range rows between unbounded preceding and 1 preceding), 0) as __before")
    ranked = ranged.selectExpr("*", f"row_number() over (partition by __range order by {', '.join(f'`{c}`' for c in by)}) as __rank")
    return ranked.join(F.broadcast(before), "__range").withColumn(out, (F.col("__rank") + F.col("__before")).cast("long")).drop("__range", "__rank", "__before")
