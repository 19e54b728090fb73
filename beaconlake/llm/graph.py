"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.common import MOST_SENT, discard, materialize, unsent


def _starred(edges: DataFrame, large: bool, n: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with u > v, n in number, linked anew to the least neighbour; and these neighbours.

    large: each node's larger neighbours go to its least neighbour; small: its smaller ones and itself do.
    The least neighbour is summed map-side. Of many edges the least neighbours are written first: between two shuffled
    sides a node of many edges splits as a skewed join does.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("of"), F.least("m", "u").alias("m") if large else F.col("m")
    )
    if n > MOST_SENT:
        least = materialize(least, "least")
    linked = both.join(unsent(least, n), F.col("u") == F.col("of"))
    if large:
        moved = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("of").alias("u"), F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct(), least


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 100) -> DataFrame:
    """One row per node that has an edge: node, root (the least node that it reaches).

    Each round is written to the shared folder; the driver sees a count and a checksum.
    """
    a, b = F.col(left), F.col(right)
    now = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "edges")
    mark, n = None, now.count()
    for _ in range(most_rounds):
        half, least = _starred(now, True, n)
        if n > MOST_SENT:
            half = materialize(half, "edges")
        later, lesser = _starred(half, False, n)
        later = materialize(later, "edges")
        discard(now, half, least, lesser)
        now = later
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if seen == mark:
            break
        mark, n = seen, seen[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    out.scratch_path = now.scratch_path
    return out
