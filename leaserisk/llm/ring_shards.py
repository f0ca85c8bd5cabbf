"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells; a row's place on it is a hash of its id and
text.  Every shard owns ``vnodes`` points of the ring; the rows on the arc
before a point belong to the point's shard.  A shard takes rows up to its bound;
rows beyond it go on clockwise to the next point whose shard still has room.
The bounds add up to the number of rows and differ by at most one, so the law
is ``rows``: counts at most one apart, while all but the overflow stay where
the plain ring puts them.

Only counts decide who overflows: rows are counted by cell, the counts of the
``shards * vnodes`` arcs (a fixed number) are walked once around the ring,
and the resulting runs of ranks are joined back.  Ranks inside a cell come from a
window over that cell, ranks before it from sums over cells, so no task sees
an arc or a shard whole.  DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaserisk.llm.text import text_column

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(last cell of the arc, shard) for each point, clockwise; points that meet in a cell keep the first."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.md5(f"{shard}/{v}".encode()).digest()[:8], "big") % CELLS
            points.setdefault(cell, shard)
    return sorted(points.items())


def bounded_runs(counts: list[int], owners: list[int], shards: int) -> list[dict]:
    """Runs of ranks of each arc and the shard and first slot that they get.

    One walk clockwise: a point's shard takes its own arc's rows, then those
    carried to it, as far as its bound allows; what is left is carried on.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs, carried = [], []
    for step in range(2 * len(counts) + 1):
        arc = step % len(counts)
        arriving = ([(arc, 0, counts[arc])] if step < len(counts) and counts[arc] else []) + carried
        shard, carried = owners[arc], []
        for origin, lo, n in arriving:
            took = min(n, room[shard])
            if took:
                runs.append({"arc": origin, "lo": lo, "hi": lo + took, "shard": shard, "base": used[shard]})
                used[shard] += took
                room[shard] -= took
            if n > took:
                carried.append((origin, lo + took, n - took))
        if step >= len(counts) and not carried:
            break
    if carried:  # shards without a point left; none for usual numbers of points
        for origin, lo, n in carried:
            for shard in range(shards):
                if took := min(n, room[shard]):
                    runs.append({"arc": origin, "lo": lo, "hi": lo + took, "shard": shard, "base": used[shard]})
                    used[shard] += took
                    room[shard] -= took
                    lo, n = lo + took, n - took
    return runs


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a fixed, small number of rows, written into the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = 64, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    Null ids and texts have a place like any other (a null text is empty).
    Rows that repeat are rows of their own and get slots of their own; equal in id
    and text, they lie in the same cell.  An empty table gives an empty result.  Other columns
    aren't read.
    """
    spark = docs.sparkSession
    text = text_column(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(F.col(f"`{id_col}`"), text).alias("place"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("place", 64 - CELL_BITS).cast("int"))
    points = ring_points(shards, vnodes)
    first = [0] + [cell + 1 for cell, _ in points[:-1]]
    arcs = [{"arc": i, "lo": lo, "hi": cell} for i, (lo, (cell, _)) in enumerate(zip(first, points))]
    if points[-1][0] < CELLS - 1:  # the ring closes: the last cells belong to the first point
        arcs.append({"arc": 0, "lo": points[-1][0] + 1, "hi": CELLS - 1})
    arc_of = small_table(spark, arcs, "arc: int, lo: int, hi: int").select(
        "arc", F.explode(F.sequence("lo", "hi")).alias("cell"))
    cells = rows.groupBy("cell").agg(F.count("*").alias("n")).join(arc_of, "cell")
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    counts = [0] * len(points)
    for arc, n in cells.groupBy("arc").agg(F.sum("n")).collect():  # at most shards * vnodes rows
        counts[arc] = n
    runs = small_table(spark, bounded_runs(counts, [s for _, s in points], shards),
                       "arc: int, lo: long, hi: long, shard: int, base: long")
    inside = Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = (rows.withColumn("in_cell", F.row_number().over(inside) - 1)
              .join(cells.select("cell", "arc", "before"), "cell")
              .withColumn("rank", F.col("before") + F.col("in_cell")))
    return (ranked.join(F.broadcast(runs), "arc").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
