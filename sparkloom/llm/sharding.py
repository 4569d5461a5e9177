"""Histogram sort: shards that are ranges of a sort key with near-equal bytes.

Splitters are found by counting: each round counts the exact bytes and rows between candidate boundaries
(a partial sum in each task) and refines only the intervals that hold a wanted boundary, until they are within
the tolerance or hold a single key. Then the rows are exchanged once, each to its range.

The sort key is (doc_id, salt). The salt only matters where one doc_id has so many bytes that a shard boundary
falls inside its rows; those are then parted by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.store import saved

SHARDS = 8
TOLERANCE = 0.001
PROBES = 512
#: Bound of the counts that a round brings to the driver, and of the ranges that rows are dealt into.
PROBE_ROWS = 1 << 16
MOST_RANGES = 4096
_SALT_BITS = 40


@dataclass
class _Target:
    """A wanted boundary: want bytes lie below it; it is in [low, high) of the key's part now refined."""

    want: float
    low: int
    high: int
    below: int = 0
    key: int | None = None  # set when low..high is a single doc_id and the salt is refined
    done: tuple[int, int] | None = None

    def range(self) -> tuple[int | None, int, int]:
        return (self.key, self.low, self.high)


def _count(rows: DataFrame, targets: list[_Target], probes: int) -> dict[tuple, list[tuple[int, int]]]:
    """For each range that open targets look at the bytes of each of its `probes` equal intervals, as [(interval, bytes)].

    Ranges of open targets are the same or apart, so a row falls into one of them at most.
    """
    ranges = sorted({t.range() for t in targets if t.done is None}, key=lambda r: (r[1], 0) if r[0] is None else (r[0], r[1]))
    array = lambda xs: F.expr("array(" + ", ".join(f"CAST({x}BD AS DECIMAL(20,0))" for x in xs) + ")")
    lows = [(r[1], 0) if r[0] is None else (r[0], r[1]) for r in ranges]
    highs = [(r[2], 0) if r[0] is None else (r[0], r[2]) for r in ranges]
    k, salt = F.col("k"), F.col("salt")
    at = _with_range(rows, "r", lows, "k", "salt").where("r > 0")
    pick = lambda xs: F.get(array(xs), F.col("r") - 1)
    hk, hs = pick([h[0] for h in highs]), pick([h[1] for h in highs])
    inside = at.where((k < hk) | ((k == hk) & (salt < hs)))
    x = F.when(F.get(F.expr("array(" + ", ".join(str(r[0] is not None) for r in ranges) + ")"), F.col("r") - 1), salt).otherwise(k)
    inside = inside.select("size", "r", x.alias("x"), pick([r[1] for r in ranges]).alias("low"), pick([-(-(r[2] - r[1]) // probes) for r in ranges]).alias("width"))
    out: dict[tuple, list[tuple[int, int]]] = {}
    for r in inside.groupBy("r", F.expr("(x - low) div width").alias("bin")).agg(F.sum("size").alias("b")).collect():  # at most ranges x probes rows
        out.setdefault(ranges[r.r - 1], []).append((r.bin, r.b))
    return {key: sorted(v) for key, v in out.items()}


def splitters(rows: DataFrame, shares: list[float], tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(k, salt) boundaries of rows(k, salt, size): the bytes below boundary i are near shares[i] of all.

    Off by at most tolerance x (all bytes x the least step of shares), or by one row where rows are larger.
    """
    total, low, high = rows.agg(F.sum("size"), F.min("k"), F.max("k")).first()
    if total is None:
        return [(0, 0) for _ in shares]
    total, low, high = int(total), int(low), int(high)
    steps = [b - a for a, b in zip([0.0, *shares], [*shares, 1.0], strict=True)]
    slack = tolerance * total * min(steps)
    targets = [_Target(s * total, low, high + 1) for s in shares]
    while any(t.done is None for t in targets):
        open_ranges = len({t.range() for t in targets if t.done is None})
        probes = max(16, min(PROBES, PROBE_ROWS // open_ranges))
        found = _count(rows, targets, probes)
        for t in targets:
            if t.done is not None:
                continue
            width, below, own = -(-(t.high - t.low) // probes), t.below, t.range()
            for k, size in found.get(own, []):
                if below + size >= t.want:
                    break
                below += size
            else:
                # Only rounding can leave nothing to take: the range's end.
                k, size = probes, 0
            left = t.low + k * width
            right = min(left + width, t.high)
            near_left, near_right = t.want - below, below + size - t.want
            if min(near_left, near_right) <= slack or size == 0:
                cut = left if near_left <= near_right else right
                t.done = (cut, 0) if t.key is None else (t.key, cut)
            elif right - left > 1:
                t.low, t.high, t.below = left, right, below
            elif t.key is None:
                t.key, t.low, t.high, t.below = left, 0, 1 << _SALT_BITS, below
            else:
                cut = left if near_left <= near_right else right
                t.done = (t.key, cut)
    return sorted(t.done for t in targets)  # type: ignore[type-var]


def histogram_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (replacing columns of those names).

    size is the UTF-8 bytes of the text (null: none) plus 1; shards are ranges of doc_id (null first) with
    near-equal bytes (law 'bytes'), slot is the row's place in its shard in the order of doc_id, gapless from 0,
    grown_shard null. All columns stay. Rows with the same doc_id, repeated ones too, may be parted if they are
    more than a shard's share of bytes; docs must then give the same rows in the same tasks when read again, as
    a table does. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63) + 1)).alias("k"),
    )
    rows = rows.withColumn("salt", F.shiftrightunsigned(F.xxhash64("text_crc32", "size", F.monotonically_increasing_id()), 64 - _SALT_BITS))
    counted = saved(rows.select(F.col("k").cast("decimal(20,0)").alias("k"), F.col("salt").cast("decimal(20,0)").alias("salt"), "size"), "shard-sizes")
    # Finer ranges than shards, so that a shard is not one task: each shard is cut into `fine` ranges.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = max(1, min(-(-tasks // shards), MOST_RANGES // shards))
    bounds = splitters(counted, [i / (shards * fine) for i in range(1, shards * fine)], tolerance)
    placed = _with_range(rows, "range", bounds, "k", "salt")
    # The one exchange: each range is a task of its own.
    moved = placed.repartitionById(shards * fine, F.col("range").cast("int"))
    place = moved.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("k", "salt")) - 1)
    # Exact row counts below each range, from the counted table.
    per = _with_range(counted, "r", bounds, "k", "salt").groupBy("r").count().collect()  # one row a range
    counts = dict((r.r, r["count"]) for r in per)
    first, begin = [], 0
    for i in range(shards * fine):
        if i % fine == 0:
            begin = 0
        first.append(begin)
        begin += counts.get(i, 0)
    base = F.get(F.expr("array(" + ", ".join(f"{x}L" for x in first) + ")"), F.col("range"))
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in names]
    return place.select(
        *own, "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("range") / fine).cast("int").alias("shard"), (F.col("at") + base).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _with_range(df: DataFrame, name: str, bounds: list[tuple[int, int]], k: str, salt: str) -> DataFrame:
    """df with the number of boundaries at or below the key of columns k and salt.

    Boundaries are held as blocks of about the square root of their number: first the blocks that lie below the
    key are counted, then the boundaries inside the next one.
    """
    n = len(bounds)
    if not n:
        return df.withColumn(name, F.lit(0))
    step = math.isqrt(n - 1) + 1
    blocks = [bounds[i : i + step] for i in range(0, n, step)]
    one = lambda b: f"named_struct('a', CAST({b[0]}BD AS DECIMAL(20,0)), 'b', CAST({b[1]}BD AS DECIMAL(20,0)))"
    array = lambda bs: "array(" + ", ".join(map(one, bs)) + ")"
    below = f"x -> x.a < {k} OR (x.a = {k} AND x.b <= {salt})"
    coarse = df.withColumn("block", F.expr(f"size(filter({array([b[-1] for b in blocks])}, {below}))"))
    inner = f"coalesce(size(filter(get(array({', '.join(map(array, blocks))}), block), {below})), 0)"
    return coarse.withColumn(name, F.expr(f"least({n}, block * {step} + greatest(0, {inner}))")).drop("block")
