"""Mixing sources to target weights by Pfair scheduling.

Each source is a task that gets its weight's share of block slots. Its i-th block is released at floor(i / w) and due at
ceil((i + 1) / w); in each slot, the released block with the earliest deadline goes next. So at every slot, each source is less
than one block away from its share. With whole-number weights the order repeats after as many slots as the weights add up
to; the driver works out that one period, and every row looks its slot up.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import written

RESOLUTION = 1000  # target weights are whole shares of about this
BLOCK_ROWS = 16
BUCKET_ROWS = 512
MAX_SOURCES = 1000  # a plan has at most this many sources and phases


@dataclass
class Phase:
    """Slots from ``slot`` on, until a source runs out; ``turns`` are a source's slots within the period."""

    number: int
    slot: int
    period: int
    first: dict[str, int]
    last: dict[str, int]
    weights: dict[str, int]
    turns: dict[str, list[int]]


def period_order(weights: dict[str, int]) -> list[str]:
    """The sources of one period, by earliest deadline among released blocks; ties go to the smaller name."""
    period = sum(weights.values())
    waiting = [(0, name, 0) for name in weights]  # release, name, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    order = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, name, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // weights[name]), name, i))
        _, name, i = heapq.heappop(ready)
        order.append(name)
        if i + 1 < weights[name]:
            heapq.heappush(waiting, ((i + 1) * period // weights[name], name, i + 1))
    return order


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[Phase]:
    """The schedule of all blocks. When a source has no more blocks, the others go on by their own weights in a new phase."""
    done = dict.fromkeys(blocks, 0)
    found: list[Phase] = []
    slot = 0
    while active := {name: weights[name] for name in sorted(blocks) if done[name] < blocks[name]}:
        period = sum(active.values())
        turns: dict[str, list[int]] = {name: [] for name in active}
        for at, name in enumerate(period_order(active)):
            turns[name].append(at)
        ends = []
        for name, weight in active.items():
            rounds, turn = divmod(blocks[name] - done[name] - 1, weight)
            ends.append(rounds * period + turns[name][turn] + 1)
        length = min(ends)
        rounds, rest = divmod(length, period)
        taken = {name: rounds * weight + sum(turn < rest for turn in turns[name]) for name, weight in active.items()}
        found.append(Phase(len(found), slot, period, {n: done[n] for n in active}, {n: done[n] + taken[n] for n in active}, active, turns))
        for name in active:
            done[name] += taken[name]
        slot += length
    return found


def temperature_weights(rows: dict[str, int], power: float = 0.5, resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole weights in proportion to a power of the number of rows; at least one each."""
    total = sum(n**power for n in rows.values())
    return {name: max(1, round(resolution * n**power / total)) for name, n in rows.items()}


def _name(source: str) -> Column:
    """The source as text; a null source is a source of its own, apart from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def mix(
    docs: DataFrame, weights: dict[str | None, int] | None = None, source: str = "source", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``docs`` with their places in the mix, as new columns at the end; every row is there once.

    mix_block: number of the block within its source. mix_phase: the sources that still have blocks share the slots of a
    phase. mix_release, mix_deadline, mix_slot: of the block. mix_row: place within the block. A training order is (mix_slot, mix_row).

    A source's rows are dealt to blocks in the order of the MD5 of doc_id; repeated ids follow each other in the order of their
    texts' hashes. ``weights`` are whole numbers by source (None: the null source; every source needs one); by default, in
    proportion to the square root of the rows. The last block of a source may be short. Null and empty texts are rows like others; a null
    doc_id counts as empty text; no rows give no rows. Columns of ``docs`` of the new names are replaced.
    """
    keyed = docs.select(F.struct("*").alias("_row"), _name(source).alias("_source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"), F.xxhash64("text").alias("_text"))
    rows = {row["_source"]: row["n"] for row in keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    shares = temperature_weights(rows) if weights is None else {"" if k is None else f"={k}": w for k, w in weights.items()}
    if missing := set(rows) - {name for name, weight in shares.items() if weight > 0}:
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    plan = phases({name: -(-n // block_rows) for name, n in rows.items()}, {name: shares[name] for name in rows})
    # Ranges of keys of a source, some hundred rows each, or the root of all rows if that is more.
    size = max(BUCKET_ROWS, isqrt(sum(rows.values())))
    spark = docs.sparkSession
    split = spark.createDataFrame([(name, -(-n // size)) for name, n in rows.items()], "_source string, _buckets bigint")
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * F.col("_buckets") / F.lit(1 << 32))
    placed = keyed.join(F.broadcast(split), "_source").withColumn("_bucket", bucket)
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(placed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("n"))).select(
        "_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "_text")
    ranked = placed.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(starts), ["_source", "_bucket"])
    index = F.col("_start") + F.col("_rank") - 1
    numbered = ranked.select("_row", "_source", F.floor(index / block_rows).alias("_block"), (index % block_rows).alias("_place"))
    steps = spark.createDataFrame(
        [(n, p.number, p.slot, p.period, p.weights[n], p.first[n], p.last[n], p.turns[n]) for p in plan for n in p.weights if p.last[n] > p.first[n]],
        "_source string, phase int, slot bigint, period bigint, weight bigint, first bigint, last bigint, turns array<int>",
    )
    met = numbered.join(
        F.broadcast(steps.withColumnRenamed("_source", "_s")), (F.col("_source") == F.col("_s")) & (F.col("_block") >= F.col("first")) & (F.col("_block") < F.col("last"))
    )
    turn = F.col("_block") - F.col("first")
    new = {
        "mix_block": F.col("_block"), "mix_phase": F.col("phase"),
        "mix_release": F.col("slot") + F.expr("(_block - first) * period div weight"),
        "mix_deadline": F.col("slot") + F.expr("((_block - first + 1) * period + weight - 1) div weight"),
        "mix_slot": F.col("slot") + F.expr("(_block - first) div weight * period") + F.get("turns", (turn % F.col("weight")).cast("int")),
        "mix_row": F.col("_place").cast("bigint"),
    }
    kept = [F.col("_row").getField(name).alias(name) for name in docs.columns if name not in new]
    return met.select(*kept, *[value.alias(name) for name, value in new.items()])
