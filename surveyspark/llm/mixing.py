"""Mixing sources to target weights by Pfair scheduling.

A source is a stream of blocks of equal size. With a target weight w, its block j may be
placed from slot floor(j / w) on and must be placed before slot ceil((j + 1) / w); the
earliest deadline among released blocks goes first, which keeps every source within one
block of its target at any time. Weights are whole numbers over their sum, exactly as given,
so a phase has no cycle. When a source is used up, the others go on with their weights
rescaled: a new phase.

A phase is scheduled in stretches of slots, each in a task of its own. At any slot T a source
has placed floor(w T) or ceil(w T) blocks. A run that begins at T with the earliest deadlines
counted as placed meets all deadlines after T. Two such runs take the least of two queues of
equal size with equal arrivals, so their queues differ only in blocks up to the latest
deadline open at T, and are equal from there on: a lead of 1 / (smallest weight) slots gives
a stretch the very slots of one run over the whole phase.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.core.bounded import collect_bounded
from surveyspark.llm.common import partitions, small_join, cut_lineage

BLOCK = 1 << 15
CYCLE = 1000
MOST_SOURCES = 1000
STRETCH = 1 << 16
_NO_SOURCE, _NO_ID = "\0", "\0"


def cycle_units(weights: list[float], cycle: int) -> list[int]:
    """Slots of a cycle per source: at least one each, rounded by largest remainders."""
    total = sum(weights)
    exact = [w / total * cycle for w in weights]
    units = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (units[i] - exact[i], i))
    for i in order[: max(0, cycle - sum(units))]:
        units[i] += 1
    while sum(units) > cycle:  # sources raised to one slot take it from the largest
        units[max(range(len(units)), key=lambda i: (units[i], -i))] -= 1
    return units


def state_at(units: list[int], t: int) -> list[int]:
    """Blocks placed per source before slot ``t``: of those that may be, the earliest deadlines are."""
    total = sum(units)
    placed = [u * t // total for u in units]
    begun = sorted((-(-(p + 1) * total // u), i) for i, (u, p) in enumerate(zip(units, placed)) if u * t % total)
    for _, i in begun[: t - sum(placed)]:
        placed[i] += 1
    return placed


def edf(units: list[int], begin: int = 0) -> Iterator[tuple[int, int, int]]:
    """Slot, source and block from slot ``begin`` on without end: earliest deadline first among released blocks."""
    total, placed = sum(units), state_at(units, begin)
    waiting = [(p * total // u, i) for i, (u, p) in enumerate(zip(units, placed))]  # release, source
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # deadline, source
    t = begin
    while True:
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(placed[i] + 1) * total // units[i]), i))
        _, i = heapq.heappop(ready)
        yield t, i, placed[i]
        placed[i] += 1
        heapq.heappush(waiting, (placed[i] * total // units[i], i))
        t += 1


def lead(units: list[int]) -> int:
    """Slots after which a run begun anywhere equals the run from slot 0."""
    return -(-sum(units) // min(units))


def stretch(units: list[int], begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Slots ``begin`` to ``end`` (without) of the run from slot 0."""
    for t, i, block in edf(units, max(0, begin - lead(units))):
        if t >= end:
            return
        if t >= begin:
            yield t, i, block


def edf_cycle(units: list[int]) -> list[list[int]]:
    """Slots of each source in one cycle of as many slots as units."""
    slots: list[list[int]] = [[] for _ in units]
    for t, i, _ in stretch(units, 0, sum(units)):
        slots[i].append(t)
    return slots


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*(x.denominator for x in exact))
    out = [int(x * common) for x in exact]
    divisor = math.gcd(*out)
    return [x // divisor for x in out]


def phase_end(units: list[int], left: list[int]) -> tuple[int, list[int]]:
    """The slot after which a first source has no block left, and the blocks placed by then."""
    total = sum(units)
    latest = min(-(-n * total // u) for u, n in zip(units, left))
    first = min(r for u, n in zip(units, left) if (r := (n - 1) * total // u) < latest)
    begin = max(0, first - lead(units))
    placed = state_at(units, begin)
    for t, i, block in edf(units, begin):
        placed[i] = block + 1
        if placed[i] == left[i]:
            return t + 1, placed
    raise AssertionError("a run has no end")


def exact_phases(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple]:
    """Phases: sources, their units, their first blocks, first slot, number of slots."""
    left, start, out = {s: n for s, n in blocks.items() if n}, 0, []
    while left:
        names = sorted(left)
        units = whole([weights[s] for s in names])
        end, placed = phase_end(units, [left[s] for s in names])
        out.append((names, units, [blocks[s] - left[s] for s in names], start, end))
        left = {s: left[s] - p for s, p in zip(names, placed) if left[s] > p}
        start += end
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float], cycle: int = CYCLE) -> list[tuple]:
    """Phases of weights rounded to a cycle: (source, phase, first block, end block, first slot, cycle, units, slots in the cycle).

    ``mix_order`` does not round; see ``exact_phases``.
    """
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    phase = 0
    while left:
        names = sorted(left)
        size = max(cycle, 4 * len(names)) if len(names) > 1 else 1
        units = cycle_units([weights[s] for s in names], size)
        slots = edf_cycle(units)
        end = min((left[s] - 1) // u * size + own[(left[s] - 1) % u] + 1 for s, u, own in zip(names, units, slots))
        for s, u, own in zip(names, units, slots):
            placed = end // size * u + bisect_left(own, end % size)
            if placed:
                out.append((s, phase, done[s], done[s] + placed, start, size, u, own))
            done[s] += placed
            left[s] -= placed
            if not left[s]:
                del left[s]
        start += end
        phase += 1
    return out


_STRETCHES = pa.schema([("phase", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
_PLAN = pa.schema([("s", pa.string()), ("block", pa.int64()), ("phase", pa.int32()), ("release", pa.int64()), ("deadline", pa.int64()), ("slot", pa.int64())])


def _place(phases: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every block of the given stretches with its window and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, units, done, start, _ = phases[row["phase"]]
                total, held = sum(units), []

                def rows() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PLAN)], schema=_PLAN)

                for t, i, k in stretch(units, row["begin"], row["end"]):
                    held.append((names[i], done[i] + k, row["phase"], start + k * total // units[i], start - (-(k + 1) * total // units[i]), start + t))
                    if len(held) == 1 << 14:
                        yield rows()
                        held = []
                if held:
                    yield rows()

    return run


def mix_order(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, targets: dict[str, float] | None = None, temper: float = 0.7, block: int = BLOCK) -> DataFrame:
    """Place of every document: id, source, n_bytes, phase, block, release, deadline, slot, at.

    Documents of a source are taken in an order of hashes of their ids and fill blocks of
    ``block`` bytes; a document belongs to the block in which it begins, ``at`` bytes into it.
    Blocks of one slot follow each other by ``at``. ``targets``: weight per source, any scale;
    sources without one get the smallest given. Without ``targets`` a source weighs its bytes
    to the power ``temper``. Rows that share source and id are one unit, in one row; a null
    source or id is a value like others. ``size`` defaults to the bytes of ``text`` (null: 0),
    at least 1. At most ``MOST_SOURCES`` sources: more raise.
    """
    spark = df.sparkSession
    size = F.octet_length(F.col("text")) if size is None else size
    ids = F.col(f"`{id_col}`")
    rows = df.select(F.col(f"`{source_col}`").cast("string").alias("source"), ids.alias("id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(1)).cast("long").alias("n_bytes"))
    units = rows.groupBy("source", "id").agg(F.sum("n_bytes").alias("n_bytes"))
    bits = max(6, math.ceil(math.log2(8 * partitions(spark))))
    units = units.withColumns({"s": F.coalesce("source", F.lit(_NO_SOURCE)), "h": F.xxhash64(F.lit(6), "id")})
    units = cut_lineage(units.withColumn("slice", F.shiftright("h", 64 - bits)))
    before = (Window.unboundedPreceding, -1)
    slices = units.groupBy("s", "slice").agg(F.sum("n_bytes").alias("b"))
    ahead = slices.select("s", "slice", F.coalesce(F.sum("b").over(Window.partitionBy("s").orderBy("slice").rowsBetween(*before)), F.lit(0)).alias("ahead"))
    totals = {r["s"]: r["b"] for r in collect_bounded(slices.groupBy("s").agg(F.sum("b").alias("b")), MOST_SOURCES, "sources to mix")}
    blocks = {s: -(-b // block) for s, b in totals.items()}
    if targets:
        least = min(w for w in targets.values() if w > 0)
        weights = {s: targets.get(s) or least for s in totals}
    else:
        weights = {s: b**temper for s, b in totals.items()}
    phases = exact_phases(blocks, weights)
    # the lead of a stretch is run again, so it is no longer than the stretch
    begins = [(p, at, size, step) for p, (_, units, _, _, size) in enumerate(phases) for step in [max(STRETCH, lead(units))] for at in range(0, size, step)]
    stretches = spark.createDataFrame(pa.table([[p for p, *_ in begins], [at for _, at, *_ in begins], [min(at + step, size) for _, at, size, step in begins]], schema=_STRETCHES))
    plan = cut_lineage(stretches.mapInArrow(_place(phases), "s string, block long, phase int, release long, deadline long, slot long"))

    inside = Window.partitionBy("s", "slice").orderBy("h", "id").rowsBetween(*before)
    placed = units.withColumn("within", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))).join(ahead, ["s", "slice"])
    placed = placed.withColumn("begin", F.col("ahead") + F.col("within")).withColumn("block", F.floor(F.col("begin") / block))
    both = small_join(placed, plan, ["s", "block"], "inner", 64)
    return both.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_bytes", "phase", "block", "release", "deadline", "slot",
                       (F.col("begin") - F.col("block") * block).alias("at"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """All rows in mixed order: in range partitions of the schedule, sorted inside; columns as they were."""
    order = mix_order(df, id_col, source_col, **settings)
    place = cut_lineage(order.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__source"), F.col("slot").alias("__slot"), F.col("at").alias("__at")))
    keyed = {"__null": F.col("__id").isNull(), "__none": F.col("__source").isNull()}
    zero = F.lit(None).cast(df.schema[id_col].dataType)
    place = place.withColumns(keyed).withColumns({"__id": F.coalesce("__id", F.xxhash64(zero).cast(df.schema[id_col].dataType)), "__source": F.coalesce("__source", F.lit(_NO_SOURCE))})
    rows = df.withColumns({"__null": F.col(f"`{id_col}`").isNull(), "__none": F.col(f"`{source_col}`").isNull(),
                           "__id": F.coalesce(F.col(f"`{id_col}`"), F.xxhash64(zero).cast(df.schema[id_col].dataType)),
                           "__source": F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(_NO_SOURCE))})
    joined = small_join(rows, place, ["__id", "__source", "__null", "__none"], "left", 64)
    return joined.repartitionByRange(partitions(df.sparkSession), "__slot", "__at").sortWithinPartitions("__slot", "__at", "__id").select(*[f"`{c}`" for c in df.columns])
