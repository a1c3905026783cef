"""Filling missing numbers, and scoring how well it is done on hidden values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.core.stats import correlation
from surveyspark.core.hashing import seeded_unit
from surveyspark.core.namespaces import quoted as q
from surveyspark.core.session import cut_lineage


CROWDED_CELL = 1024
CUT_EVERY = 8  # columns after which a round of chained equations is cut off


def sibling_groups(cols: Sequence[str]) -> dict[str, list[str]]:
    """Columns that answer the same question: all whose name starts with the same base."""
    groups: dict[str, list[str]] = {}
    for c in cols:
        base = c.rsplit(":", 1)
        if base[-1] == " applicable":
            base = base[0].rsplit(":", 1)
        if base[0] not in groups:
            groups[base[0]] = [o for o in cols if o.startswith(base[0])]
    return groups


def rotated_columns(cols: Sequence[str]) -> list[list[str]]:
    """Column sets in which every question is present with one of its columns, each in turn."""
    groups = sibling_groups(cols)
    sets = []
    for i in range(max(len(g) for g in groups.values())):
        drop = {c for g in groups.values() for j, c in enumerate(g) if j != i % len(g)}
        sets.append([c for c in cols if c not in drop])
    return sets


def hide_values(
    df: DataFrame, row_id: Sequence[str], cols: Sequence[str], share: float = 0.2, seed: int = 0, together: bool = False
) -> DataFrame:
    """Known values hidden by a seeded hash of row and column; ``__was_<col>`` keeps them.

    With ``together`` the columns of one question are hidden in the same rows.
    """
    lead = {c: c for c in cols}
    if together:
        for members in sibling_groups(cols).values():
            for c in members:
                lead[c] = members[0]
    out = {}
    for c in cols:
        hidden = seeded_unit(f"{seed}-{lead[c]}", *row_id) < share
        out[f"__was_{c}"] = F.when(hidden, F.col(q(c)).cast("double"))
        out[c] = F.when(~hidden, F.col(q(c)).cast("double"))
    return df.withColumns(out)


def impute_mean(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    means = (fit if fit is not None else df).agg(F.array(*[F.avg(q(c)) for c in cols]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(q(c)).cast("double"), means[i]) for i, c in enumerate(cols)})


def nearest_donors(
    receivers: DataFrame, donors: DataFrame, ident: str, features: Sequence[str], value: str, k: int = 5,
    start: float | None = None, growth: int = 4,
) -> DataFrame:
    """Mean ``value`` of the ``k`` nearest donors of every receiver: ident, value, farthest.

    Features are complete and on a common scale. Donors of equal features are merged to
    (rows, sum). Receivers look into the grid cells around them, on the first two features;
    sizes start where no cell is crowded, so dense regions are searched in small cells. A
    receiver is tried at the first size whose neighbourhood holds ``k`` donors, and is settled
    when its k-th distance is no larger than the cell, since every donor nearer than that
    lies in the neighbourhood. All others go on to larger cells. Donors equally
    far are taken in the order of their features, the last one in parts.
    """
    dims = list(features[:2])
    grp = donors.groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    grp = cut_lineage(grp)
    todo = cut_lineage(receivers.select(ident, *features))
    head = grp.agg(
        F.sum("n").alias("n"), *[F.max(d).alias(f"hi{i}") for i, d in enumerate(dims)], *[F.min(d).alias(f"lo{i}") for i, d in enumerate(dims)]
    ).first()
    if not head["n"]:
        return receivers.select(ident, F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("farthest"))
    k = min(k, head["n"])
    span = max(head[f"hi{i}"] - head[f"lo{i}"] for i in range(len(dims))) or 1.0
    side = start or span / max(2.0, (head["n"] / (2 * k)) ** (1 / len(dims)))
    while start is None and side > span * 1e-9:
        crowd = grp.groupBy(*[F.floor(F.col(q(d)) / side) for d in dims]).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m").alias("m"))
        if crowd.first()["m"] <= CROWDED_CELL:
            break
        side /= growth
    around = "transform(sequence(-1, 1), a -> struct(a, 0 AS b))" if len(dims) == 1 else (
        "flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a, b))))"
    )
    found = []
    for _ in range(64):
        left = todo.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.max(F.greatest(F.abs(F.col(d) - F.lit(float(head[f"lo{i}"]))), F.abs(F.col(d) - F.lit(float(head[f"hi{i}"]))))).alias(f"r{i}") for i, d in enumerate(dims)],
        ).first()
        if not left["n"]:
            break
        whole = side > max([span, *[left[f"r{i}"] for i in range(len(dims))]])

        def cells(df: DataFrame) -> dict[str, Column]:
            out = {f"__{t}": F.floor(F.col(d) / side).cast("bigint") for t, d in zip("ab", dims)}
            return out if len(dims) == 2 else {**out, "__b": F.lit(0).cast("bigint")}

        target = grp.withColumns(cells(grp))
        per_cell = target.groupBy("__a", "__b").agg(F.sum("n").alias("m"))
        seen = todo.withColumns(cells(todo)).withColumn("__o", F.explode(F.expr(around))).withColumns(
            {"__a": F.col("__a") + F.col("__o.a"), "__b": F.col("__b") + F.col("__o.b")}
        ).drop("__o")
        enough = seen.join(per_cell, ["__a", "__b"]).groupBy(ident).agg(F.sum("m").alias("m")).filter(F.col("m") >= k)
        if whole:
            enough = todo.select(ident)
        cand = seen.join(enough.select(ident), ident, "left_semi").alias("r").join(
            target.withColumnsRenamed({f: f"__{f}_d" for f in features}), ["__a", "__b"]
        )
        dist = F.sqrt(sum((F.pow(F.col(q(f)) - F.col(q(f"__{f}_d")), 2) for f in features), F.lit(0.0)))
        item = F.struct(dist.alias("d"), *[F.col(q(f"__{f}_d")).alias(f"f{i}") for i, f in enumerate(features)], F.col("n"), F.col("s"))
        near = _k_smallest(cand.select(ident, item.alias("c")), ident, k)
        near = near.withColumn("sure", F.lit(whole) | (F.col("farthest") <= side))
        near = cut_lineage(near)
        found.append(near.filter("sure").drop("sure"))
        todo = cut_lineage(todo.join(near.filter("sure").select(ident), ident, "left_anti"))
        side *= growth
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _k_smallest(cand: DataFrame, ident: str, k: int) -> DataFrame:
    """Mean over the ``k`` nearest rows of merged donors (struct c with d, n, s)."""
    from pyspark.sql import Window

    w = Window.partitionBy(ident).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    take = cand.withColumn("before", F.coalesce(F.sum("c.n").over(w), F.lit(0))).filter(F.col("before") < k)
    used = F.least(F.col("c.n"), F.lit(k) - F.col("before"))
    return take.groupBy(ident).agg(
        (F.sum(used * F.col("c.s") / F.col("c.n")) / F.sum(used)).alias("value"), F.max("c.d").alias("farthest")
    )


def impute_knn(df: DataFrame, ident: str, target: str, features: Sequence[str], k: int = 5) -> DataFrame:
    """Missing ``target`` filled with the mean of the k nearest rows by known, standardised features.

    Rows are grouped by which features they know; each such group meets the donors that
    know the same features, so distances are over equal sets of columns.
    """
    stats = df.agg(
        F.array(*[F.avg(q(f)) for f in features]).alias("m"), F.array(*[F.stddev_pop(q(f)) for f in features]).alias("s")
    ).first()
    z = {f: ((F.col(q(f)) - F.lit(m)) / F.lit(s or 1.0)) for f, m, s in zip(features, stats["m"], stats["s"])}
    std = df.select(ident, F.col(q(target)).alias("__t"), *[z[f].alias(f) for f in features])
    mask = F.concat(*[F.when(F.col(q(f)).isNull(), "0").otherwise("1") for f in features])
    needy = std.filter("__t IS NULL").withColumn("__mask", mask)
    patterns = [r["__mask"] for r in needy.select("__mask").distinct().collect()]
    filled = None
    for p in patterns:
        have = [f for f, bit in zip(features, p) if bit == "1"]
        if not have:
            continue
        donors = std.filter("__t IS NOT NULL").dropna(subset=have)
        part = nearest_donors(needy.filter(F.col("__mask") == p), donors, ident, have, "__t", k).select(
            F.col(ident).alias("__id"), F.col("value").alias("__v")
        )
        filled = part if filled is None else filled.unionByName(part)
    if filled is None:
        return impute_mean(df, [target])
    out = df.join(filled, df[ident] == filled["__id"], "left").withColumn(target, F.coalesce(F.col(q(target)), "__v"))
    return impute_mean(out.drop("__id", "__v"), [target])


def gram(df: DataFrame, cols: Sequence[str]) -> tuple[float, np.ndarray]:
    """Rows and the matrix of cross products of (1, columns), in one aggregation."""
    xs = [F.lit(1.0)] + [F.col(q(c)).cast("double") for c in cols]
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = df.agg(*[F.sum(xs[i] * xs[j]).alias(f"g{n}") for n, (i, j) in enumerate(pairs)]).first()
    g = np.zeros((k, k))
    for n, (i, j) in enumerate(pairs):
        g[i, j] = g[j, i] = r[f"g{n}"] or 0.0
    return g[0, 0], g


def ridge_from_gram(g: np.ndarray, target: int, inputs: Sequence[int], penalty: float = 0.0) -> np.ndarray:
    """Intercept and coefficients of a least-squares fit from cross products."""
    n = g[0, 0]
    mean = g[0, inputs] / n
    ym = g[0, target] / n
    sxx = g[np.ix_(inputs, inputs)] - n * np.outer(mean, mean)
    sxy = g[inputs, target] - n * mean * ym
    beta = np.linalg.lstsq(sxx + penalty * np.eye(len(inputs)), sxy, rcond=None)[0]
    return np.concatenate([[ym - mean @ beta], beta])


def bayesian_ridge_from_gram(g: np.ndarray, target: int, inputs: Sequence[int], rounds: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Bayesian ridge (MacKay 1992): noise and weight precision re-estimated from the same cross products."""
    n = g[0, 0]
    mean = g[0, inputs] / n
    ym = g[0, target] / n
    sxx = g[np.ix_(inputs, inputs)] - n * np.outer(mean, mean)
    sxy = g[inputs, target] - n * mean * ym
    syy = g[target, target] - n * ym * ym
    ev, vec = np.linalg.eigh(sxx)
    ev = np.clip(ev, 0, None)
    proj = vec.T @ sxy
    alpha, lam = (1.0 / (syy / n) if syy > 0 else 1.0), 1.0
    beta = np.zeros(len(inputs))
    for _ in range(rounds):
        new = vec @ (proj / (ev + lam / alpha))
        gamma = float((alpha * ev / (lam + alpha * ev)).sum())
        rss = max(float(syy - 2 * new @ sxy + new @ sxx @ new), 1e-300)
        lam = (gamma + 2e-6) / (float(new @ new) + 2e-6)
        alpha = (n - gamma + 2e-6) / (rss + 2e-6)
        done = np.abs(new - beta).sum() < tol
        beta = new
        if done:
            break
    return np.concatenate([[ym - mean @ beta], beta])


def impute_chained(
    df: DataFrame, ident: str, cols: Sequence[str], estimator: str = "bayesian", rounds: int = 10, tol: float = 1e-3,
    trees: int = 10, seed: int = 0,
) -> DataFrame:
    """Chained equations: every incomplete column predicted from all others, in rounds.

    Starts from column means; columns go from the least to the most incomplete. The linear
    estimators (``linear``, ``bayesian``) need one aggregation of cross products per column;
    ``forest`` fits a random forest and ``knn`` asks the nearest rows. Stops when no value
    moves by more than ``tol`` times the largest known value.
    """
    miss = df.agg(*[F.sum(F.col(q(c)).isNull().cast("bigint")).alias(f"m{i}") for i, c in enumerate(cols)], F.max(F.greatest(*[F.abs(F.col(q(c)).cast("double")) for c in cols]) if len(cols) > 1 else F.abs(F.col(q(cols[0])))).alias("top")).first()
    order = sorted((c for i, c in enumerate(cols) if miss[f"m{i}"]), key=lambda c: miss[f"m{list(cols).index(c)}"])
    flagged = df.withColumns({f"__gap_{c}": F.col(q(c)).isNull() for c in order})
    state = cut_lineage(impute_mean(flagged, cols))
    limit = tol * (miss["top"] or 1.0)
    centre = state.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = {c: float(centre[f"m{i}"] or 0.0) for i, c in enumerate(cols)}

    def shifted(c: str) -> Column:
        """A column without its offset, so that cross products don't cancel."""
        return F.col(q(c)) - F.lit(centre[c])

    for nr in range(rounds):
        before = state
        for step, c in enumerate(order):
            if step and step % CUT_EVERY == 0:
                state = cut_lineage(state)
            others = [o for o in cols if o != c]
            gap = F.col(q(f"__gap_{c}"))
            if estimator in ("linear", "bayesian"):
                _, g = gram(state.filter(~gap).select(*[shifted(o).alias(o) for o in [*others, c]]), [*others, c])
                fit = ridge_from_gram if estimator == "linear" else bayesian_ridge_from_gram
                beta = fit(g, len(others) + 1, list(range(1, len(others) + 1)))
                guess = F.lit(centre[c] + float(beta[0]))
                for o, b in zip(others, beta[1:]):
                    guess = guess + shifted(o) * F.lit(float(b))
                state = state.withColumn(c, F.when(gap, guess).otherwise(F.col(q(c))))
            elif estimator == "forest":
                state = _forest_step(state, others, c, gap, trees, seed + nr)
            elif estimator == "knn":
                known = state.withColumn(c, F.when(~gap, F.col(q(c))))
                state = impute_knn(known, ident, c, others)
            else:
                raise ValueError(f"unknown estimator {estimator}")
        state = cut_lineage(state)
        old = before.select(F.col(ident).alias("__i"), *[F.col(q(c)).alias(f"__o{i}") for i, c in enumerate(order)])
        moved = [F.max(F.abs(F.col(q(c)) - F.col(f"__o{i}"))).alias(f"d{i}") for i, c in enumerate(order)]
        if not order:
            break
        d = state.join(old, state[ident] == old["__i"]).agg(*moved).first()
        if max((x or 0.0) for x in d) < limit:
            break
    return state.drop(*[f"__gap_{c}" for c in order])


def _forest_step(state: DataFrame, others: Sequence[str], target: str, gap: Column, trees: int, seed: int) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=list(others), outputCol="__x").transform(state)
    model = RandomForestRegressor(featuresCol="__x", labelCol=target, predictionCol="__p", numTrees=trees, seed=seed).fit(
        data.filter(~gap)
    )
    out = model.transform(data)
    return out.withColumn(target, F.when(gap, F.col("__p")).otherwise(F.col(q(target)))).drop("__x", "__p")


def score_imputation(imputed: DataFrame, cols: Sequence[str], imputer: str, fold: Column | None = None) -> DataFrame:
    """RMSE, correlation and R² per column over the hidden values; over all folds and per fold."""
    items = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(q(f"__was_{c}")).alias("a"), F.col(q(c)).cast("double").alias("p"))
                for c in cols
            ]
        )
    )
    tags = F.array(F.lit("overall"), F.concat(F.lit("fold "), fold.cast("string"))) if fold is not None else F.array(F.lit("overall"))
    long = imputed.select(items.alias("i"), F.explode(tags).alias("part")).filter("i.a IS NOT NULL AND i.p IS NOT NULL")
    a, p = F.col("i.a"), F.col("i.p")
    sse = F.sum(F.pow(a - p, 2))
    return long.groupBy("part", "i.column").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.pow(a - p, 2))).alias("rmse"),
        correlation(a, p).alias("correlation"),
        (1 - F.try_divide(sse, F.var_pop(a) * F.count(a))).alias("r2"),
    ).select(F.lit(imputer).alias("imputer"), "part", "column", "n", "rmse", "correlation", "r2")


def availability(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Known share of every column, in long form."""
    shares = df.agg(*[F.avg(F.col(q(c)).isNotNull().cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("available")) for i, c in enumerate(cols)])
    return shares.select(F.explode(items).alias("i")).select("i.*")


def summarise_scores(scores: DataFrame, available: DataFrame, low: int = 0, metrics: Sequence[str] = ("rmse", "correlation", "r2")) -> DataFrame:
    """Mean and deviation of the metrics per imputer: over all columns, by bands of availability
    of ten percent, and weighted by availability (deviation and variance)."""
    from surveyspark.operators.aggregates import weighted_mean, weighted_std, weighted_variance

    data = scores.filter("part = 'overall'").join(available, "column")
    band = F.floor(F.col("available") * 10 + 1e-9) * 10
    tags = F.array_compact(F.array(F.lit("all"), F.when(band >= low, F.concat_ws("-", band.cast("int"), (band + 10).cast("int")))))
    long = data.withColumn("slice", F.explode(tags))
    plain = long.groupBy("imputer", "slice").agg(
        *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    )
    w = F.col("available")
    weighted = data.groupBy("imputer").agg(
        *[
            x
            for m in metrics
            for x in (
                weighted_mean(F.col(m), w).alias(f"{m}_mean"),
                weighted_std(F.col(m), w).alias(f"{m}_std"),
                weighted_variance(F.col(m), w).alias(f"{m}_var"),
            )
        ]
    ).withColumn("slice", F.lit("weighted"))
    return plain.unionByName(weighted, allowMissingColumns=True)


def benchmark_imputers(
    df: DataFrame, ident: str, cols: Sequence[str], imputers: Mapping[str, object], share: float = 0.2, seed: int = 0,
    together: bool = False, rotate: bool = False, fold: Column | None = None,
) -> DataFrame:
    """Hide values, impute with every imputer (a function of frame and columns) and score."""
    from surveyspark.operators.aggregates import mean_over_frames

    hidden = cut_lineage(hide_values(df, [ident], cols, share, seed, together))
    was = hidden.select(ident, *[F.col(q(f"__was_{c}")) for c in cols], *([fold.alias("__fold")] if fold is not None else []))
    out = None
    for name, run in imputers.items():
        sets = rotated_columns(cols) if rotate else [list(cols)]
        frames = [run(hidden.select(ident, *[F.col(q(c)) for c in s]), s) for s in sets]
        done = mean_over_frames(frames, ident) if len(frames) > 1 else frames[0]
        part = score_imputation(done.join(was, ident), cols, name, F.col("__fold") if fold is not None else None)
        out = part if out is None else out.unionByName(part)
    return out
