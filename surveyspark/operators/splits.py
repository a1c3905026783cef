"""Folds and splits as columns. Keys are ranked by a seeded md5, so results repeat on every run."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.core.bounded import collect_bounded
from surveyspark.core.hashing import HASH_SPAN, seeded_hash, seeded_unit
from surveyspark.core.ordering import hash_positions, value_positions
from surveyspark.core.session import cut_lineage

MAX_GROUPS = 1_000_000


def _ranked_keys(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with position and total along the seeded hash."""
    keys = df.filter(F.col(key).isNotNull()).select(key).distinct()
    return hash_positions(keys.withColumn("__h", seeded_hash(seed, key)), "__h", HASH_SPAN, ties=[key]).drop("__h")


def even_part(position: Column, total: Column, parts: Column | int) -> Column:
    """Part of a position when the first ``total mod parts`` parts get one row more."""
    k = F.lit(parts) if isinstance(parts, int) else parts
    small = F.floor(total / k)
    extra = total - small * k
    edge = extra * (small + 1)
    return (
        F.when(position < edge, F.floor(position / (small + 1)))
        .otherwise(extra + F.floor((position - edge) / F.when(small > 0, small)))
        .cast("int")
    )


def assign_folds(df: DataFrame, key: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Column ``fold``: all rows of a key in one fold; never more folds than keys (-1: one per key)."""
    ranked = _ranked_keys(df, key, seed)
    k = F.col("total") if n_folds == -1 else F.least(F.lit(n_folds), F.col("total"))
    return df.join(ranked.select(key, even_part(F.col("position"), F.col("total"), k).alias("fold")), key)


def fold_roles(df: DataFrame, key: str, row_id: Sequence[str], n_folds: int = 5, val_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Columns ``role_0`` … : test for the fold's keys; of the other rows a hashed share is val, the rest train."""
    out = assign_folds(df, key, n_folds, seed)
    return out.withColumns(
        {
            f"role_{f}": F.when(F.col("fold") == f, "test")
            .when(seeded_unit(f"{seed}-{f}", *row_id) < val_size, "val")
            .otherwise("train")
            for f in range(n_folds)
        }
    )


def disjoint_fold_roles(df: DataFrame, key: str, n_folds: int = 5, val_size: float = 0.2, seed: int = 42) -> DataFrame:
    """As ``fold_roles``, but whole keys are val: ``ceil(val_size · keys outside the test fold)`` of them."""
    ranked = _ranked_keys(df, key, seed)
    k = F.least(F.lit(n_folds), F.col("total"))
    keys = ranked.select(key, "total", even_part(F.col("position"), F.col("total"), k).alias("fold"))
    rounds = keys.withColumn("__f", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).withColumn(
        "__h", F.when(F.col("fold") != F.col("__f"), seeded_hash(f"{seed}-val", F.col("__f"), key))
    )
    pos = value_positions(rounds, ["__f"], "__h").select(
        "__f", "__h", (F.col("before") < F.ceil(F.lit(val_size) * F.col("total"))).alias("__val")
    )
    roles = (
        rounds.join(pos, ["__f", "__h"], "left")
        .groupBy(key, "fold")
        .agg(
            *[
                F.max(
                    F.when(
                        F.col("__f") == f,
                        F.when(F.col("fold") == f, "test").when(F.col("__val"), "val").otherwise("train"),
                    )
                ).alias(f"role_{f}")
                for f in range(n_folds)
            ]
        )
    )
    return df.join(roles, key)


def random_split(df: DataFrame, row_id: Sequence[str], k: int = 6, seed: int = 42, out: str = "split") -> DataFrame:
    """Random split into ``k`` parts of equal size; every row is assigned."""
    pos = hash_positions(df.withColumn("__h", seeded_hash(seed, *row_id)), "__h", HASH_SPAN, ties=row_id)
    part = F.floor(F.col("position") * k / F.col("total")).cast("int")
    return pos.withColumn(out, F.concat(F.lit("split "), part.cast("string"))).drop("__h", "position", "total")


def validation_share(val: float, test: float) -> float:
    """Share of the validation part in what is left after training."""
    return val / (val + test)


def train_val_test(
    df: DataFrame, row_id: Sequence[str], sizes: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42
) -> DataFrame:
    """Exact shares: the first ``floor(train · n)`` rows along the hash, then val, then test."""
    pos = hash_positions(df.withColumn("__h", seeded_hash(seed, *row_id)), "__h", HASH_SPAN, ties=row_id)
    n_train = F.floor(F.lit(sizes[0]) * F.col("total"))
    n_val = F.floor(F.lit(validation_share(sizes[1], sizes[2])) * (F.col("total") - n_train))
    role = F.when(F.col("position") < n_train, "train").when(F.col("position") < n_train + n_val, "val").otherwise("test")
    return pos.withColumn("split", role).drop("__h", "position", "total")


def packed_counts(sizes: Sequence[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Largest-first packing into the least filled bin, on a table (size, how many groups).

    Groups of equal size are interchangeable, so each size class gives every bin a range of
    ranks: (size, bin, from, to). Runs of steps that go to one bin, or round to all bins,
    are taken at once, so the work grows with the number of distinct sizes.
    """
    heap = [(0, b) for b in range(bins)]
    out = []
    for size, m in sorted(sizes, reverse=True):
        got = [0] * bins
        while m > 0:
            loads = sorted(heap)
            low, high = loads[0][0], loads[-1][0]
            if high - low <= size and m >= bins:
                rounds = m // bins
                got = [g + rounds for g in got]
                heap = [(load + rounds * size, b) for load, b in heap]
                m -= rounds * bins
                heapq.heapify(heap)
                continue
            load, b = heapq.heappop(heap)
            second = heap[0][0] if heap else load
            t = min(m, max(1, math.ceil((second - load) / size)))
            got[b] += t
            heapq.heappush(heap, (load + t * size, b))
            m -= t
        start = 0
        for b, g in enumerate(got):
            if g:
                out.append((size, b, start, start + g))
                start += g
    return out


def packed_split(df: DataFrame, group: str, k: int = 6, seed: int = 42, out: str = "split") -> DataFrame:
    """Whole groups per split, largest group first into the smallest split.

    Only the histogram of group sizes reaches the driver: with n rows it has at most
    about √(2n) entries, however many groups there are.
    """
    groups = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    groups = groups.withColumn("__h", seeded_hash(seed, group))
    hist = groups.groupBy("__size").agg(F.count(F.lit(1)).alias("m"))
    rows = collect_bounded(hist, MAX_GROUPS, "distinct group sizes")
    plan = packed_counts([(r["__size"], r["m"]) for r in rows], k)
    table = df.sparkSession.createDataFrame(plan, "__size long, __bin int, __from long, __to long")
    rank = value_positions(groups, ["__size"], "__h").select("__size", "__h", F.col("before").alias("__rank"))
    placed = (
        groups.join(rank, ["__size", "__h"])
        .join(table, "__size")
        .filter((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
        .select(group, F.concat(F.lit("split "), F.col("__bin").cast("string")).alias(out))
    )
    return df.join(placed, group, "left")


#: Fractional part of the golden ratio: multiples of it fall evenly into [0, 1) whatever number is taken.
GOLDEN = 0.6180339887498949
#: Split totals closer than this share of their mean are even.
EVEN = 0.02


def _dealt(groups: DataFrame, unit: Sequence[str], within: Sequence[str], k: int) -> DataFrame:
    """Groups (n rows, d pull) with ``__bin``: the groups of a unit lie in different ones of ``k``.

    Units are ranked by the order of their size, then by their pull for each row; rank j
    starts at the golden multiple of j, and its groups follow each other from there, largest
    first. So each bin gets its share of units of any size and pull, whatever the number of
    groups they have.
    """
    units = groups.groupBy(*unit).agg(F.sum("n").alias("__n"), (F.sum("d") / F.sum("n")).alias("__d"), F.count(F.lit(1)).alias("__m"))
    units = cut_lineage(units)
    most = units.agg(F.max("__m").alias("m")).first()["m"] or 0
    if most > k:
        raise ValueError(f"a unit has {most} groups that must not share a split; raise the number of splits above {k}")
    order = F.struct((-F.floor(F.log2("__n"))).alias("size"), "__d", *unit)
    ranked = units.withColumn("__o", order)
    rank = value_positions(ranked, [], "__o").select("__o", F.col("before").alias("__j"))
    start = F.floor((F.col("__j") * F.lit(GOLDEN) - F.floor(F.col("__j") * F.lit(GOLDEN))) * k)
    starts = ranked.join(rank, "__o").select(*unit, start.alias("__start"))
    place = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("n"), *within)) - 1  # at most ``k`` rows
    return groups.join(starts, list(unit)).withColumn("__bin", F.pmod(F.col("__start") + place, F.lit(k)).cast("int")).drop("__start")


def even_moves(sizes: Sequence[tuple[int, int, int]], room: dict[int, float]) -> list[tuple[int, int, int]]:
    """How many groups of each size to move per pair of bins, largest first, into half the gap between them.

    ``sizes``: (pair, size, how many can move); ``room``: half the gap of each pair.
    """
    left, out = dict(room), []
    for pair, size, many in sorted(sizes, key=lambda r: (r[0], -r[1])):
        take = min(many, int(left[pair] // size))
        if take:
            left[pair] -= take * size
            out.append((pair, size, take))
    return out


def _evened(groups: DataFrame, unit: Sequence[str], keys: Sequence[str], k: int, rounds: int, seed: int) -> DataFrame:
    """Rounds in which each large bin gives groups to a small one that holds none of their unit.

    A pair of bins exchanges at most half of its gap. Groups go first whose pull is nearest to
    what would bring both to the same. What the driver sees is a total for each bin and a histogram of group sizes.
    """
    for _ in range(rounds):
        totals = {r["__bin"]: (r["n"], r["d"]) for r in groups.groupBy("__bin").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()}  # k rows
        loads = sorted((totals.get(b, (0, 0.0))[0], b) for b in range(k))
        mean = sum(n for n, _ in loads) / k
        pairs = [(loads[-1 - i][1], loads[i][1], (loads[-1 - i][0] - loads[i][0]) / 2) for i in range(k // 2)]
        pairs = [(h, low, gap) for h, low, gap in pairs if 2 * gap > EVEN * mean]
        if not pairs:
            break
        pull = {b: totals.get(b, (0, 0.0))[1] for b in range(k)}
        # pull that should go over with each row, so that both bins end at the same
        table = [(i, h, low, gap, (pull[h] - pull[low]) / 2 / gap) for i, (h, low, gap) in enumerate(pairs)]
        small = groups.sparkSession.createDataFrame(table, "__pair int, __bin int, __to int, __room double, __wanted double")
        there = groups.select(*unit, F.col("__bin").alias("__to")).distinct()
        can = groups.join(F.broadcast(small), "__bin").filter(F.col("n") <= F.col("__room")).join(there, [*unit, "__to"], "left_anti")
        can = cut_lineage(can)
        hist = collect_bounded(can.groupBy("__pair", "n").agg(F.count(F.lit(1)).alias("m")), MAX_GROUPS, "distinct group sizes")
        plan = even_moves([(r["__pair"], r["n"], r["m"]) for r in hist], {i: gap for i, (_, _, gap) in enumerate(pairs)})
        if not plan:
            break
        taken = groups.sparkSession.createDataFrame(plan, "__pair int, __size long, __take long")
        rank = F.struct(F.abs(F.col("d") - F.col("__wanted") * F.col("n")).alias("off"), seeded_hash(seed, *keys).alias("h"), *keys)
        asked = can.withColumn("__size", F.col("n")).join(taken, ["__pair", "__size"]).withColumn("__o", rank)
        place = value_positions(asked, ["__pair", "__size"], "__o").select("__pair", "__size", "__o", F.col("before").alias("__place"))
        moved = asked.join(place, ["__pair", "__size", "__o"]).filter(F.col("__place") < F.col("__take"))
        # two groups of a unit may be asked to the same bin in a round: the first goes
        first = moved.groupBy(*unit, "__to").agg(F.min(F.struct("__o", *keys)).alias("r")).select("__to", *[F.col(f"r.{c}").alias(c) for c in keys])
        groups = cut_lineage(groups.join(first, list(keys), "left").withColumn("__bin", F.coalesce("__to", "__bin")).drop("__to"))
    return groups


def _placed(df: DataFrame, groups: DataFrame, unit: Sequence[str], within: Sequence[str], k: int, rounds: int, seed: int, out: str) -> DataFrame:
    keys = [*unit, *within]
    dealt = cut_lineage(_dealt(groups, unit, within, k))
    chosen = _evened(dealt, unit, keys, k, rounds, seed)
    return df.join(chosen.select(*keys, F.concat(F.lit("split "), F.col("__bin").cast("string")).alias(out)), keys, "left")


def year_disjoint_split(df: DataFrame, unit: str, year: str, country: str, k: int = 6, out: str = "split", rounds: int = 6, seed: int = 42) -> DataFrame:
    """Groups (unit, year) in splits of even size, none of which holds two years of a unit in one country.

    The country of a unit and year is its smallest. Rows without unit or year get no split.
    """
    known = df.filter(F.col(unit).isNotNull() & F.col(year).isNotNull())
    groups = known.groupBy(unit, year).agg(F.count(F.lit(1)).alias("n"), F.min(country).alias("__c"), F.lit(0.0).alias("d"))
    dealt = cut_lineage(_dealt(groups.withColumn("__c", F.coalesce(F.col("__c").cast("string"), F.lit(""))), [unit, "__c"], [year], k))
    chosen = _evened(dealt, [unit, "__c"], [unit, year], k, rounds, seed)
    return df.join(chosen.select(unit, year, F.concat(F.lit("split "), F.col("__bin").cast("string")).alias(out)), [unit, year], "left")


def mean_balanced_split(
    df: DataFrame, unit: str, value: str, country: str, year: str | None = None, k: int = 6, out: str = "split", rounds: int = 6, seed: int = 42
) -> DataFrame:
    """Whole groups per split, balanced in mean and size; with ``year`` no split holds two years of a unit.

    A group's pull is the sum of its rows' distances from the overall mean. Rows without a
    value or key get no split.
    """
    units = [unit] + ([country] if country != unit else [])
    within = [year] if year else []
    data = df.dropna(subset=[value, *units, *within])
    mean = data.agg(F.avg(value).alias("m")).first()["m"] or 0.0
    groups = data.groupBy(*units, *within).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) - F.lit(mean)).alias("d"))
    return _placed(df, groups, units, within, k, rounds, seed, out)


def split_scores(df: DataFrame, split: str, value: str) -> DataFrame:
    """Splits from the most to the least like the whole table: |Δ mean| + |Δ deviation|."""
    whole = df.agg(F.struct(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).alias("w")).scalar()
    return (
        df.filter(F.col(split).isNotNull())
        .groupBy(split)
        .agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
        .select(split, (F.abs(whole["m"] - F.col("__m")) + F.abs(whole["s"] - F.col("__s"))).alias("score"))
        .orderBy("score", split)
    )


def assign_test(
    df: DataFrame, split: str, value: str, country: str | None = None, force: str | None = None,
    force_year: tuple[str, int] | None = None, into: bool = True,
) -> DataFrame:
    """Rename one split to ``test``: the one with (or, ``into=False``, without) the forced country, else the best scored."""
    if force is not None:
        hit = F.col(country) == force
        if force_year:
            hit = hit & (F.col(force_year[0]) == force_year[1])
        per = df.filter(F.col(split).isNotNull()).groupBy(split).agg(F.max(hit.cast("int")).alias("h"))
        chosen = per.filter(F.col("h") == (1 if into else 0)).agg(F.min(split).alias("s")).scalar()
    else:
        chosen = split_scores(df, split, value).agg(F.min_by(split, F.struct("score", split)).alias("s")).scalar()
    return df.withColumn(split, F.when(F.col(split) == chosen, "test").otherwise(F.col(split)))


def rotations(splits: DataFrame, split: str) -> DataFrame:
    """Every split once as test with the next one (by name) as validation: test, val."""
    names = splits.select(split).distinct().agg(F.array_sort(F.collect_set(split)).alias("s"))
    return names.select(F.posexplode("s").alias("i", "test"), "s").select(
        "test", F.get("s", (F.col("i") + 1) % F.size("s")).alias("val")
    )


def best_represented(df: DataFrame, split: str, value: str) -> DataFrame:
    """The two splits most like the whole: test and validation, in one row."""
    ranked = split_scores(df, split, value).limit(2)
    return ranked.agg(
        F.min_by(split, F.struct("score", split)).alias("test"), F.max_by(split, F.struct("score", split)).alias("val")
    )
