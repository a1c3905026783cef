"""PCA indices, regression over folds, partial dependence and anomaly flags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.core.hashing import seeded_hash, seeded_unit
from surveyspark.core.namespaces import quoted as q
from surveyspark.core.ordering import exact_quantiles
from surveyspark.core.session import cut_lineage


@dataclass(frozen=True)
class Components:
    """Principal components of standardised columns."""

    cols: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    vectors: np.ndarray  # one row per component
    explained: np.ndarray  # share of variance per component
    matrix: np.ndarray  # correlation or covariance matrix they come from

    def scores(self, n: int = 1) -> list[Column]:
        out = []
        for v in self.vectors[:n]:
            total = F.lit(0.0)
            for c, m, s, w in zip(self.cols, self.mean, self.std, v):
                total = total + (F.col(q(c)).cast("double") - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
            out.append(total)
        return out


def _components(mean: np.ndarray, cov: np.ndarray, cols: Sequence[str], standardise: bool) -> Components:
    std = np.sqrt(np.clip(np.diag(cov), 0, None)) if standardise else np.ones(len(cols))
    std = np.where(std > 0, std, 1.0)
    matrix = cov / np.outer(std, std)
    ev, vec = np.linalg.eigh(matrix)
    order = np.argsort(ev)[::-1]
    ev, vec = np.clip(ev[order], 0, None), vec[:, order].T
    sign = np.sign(vec[np.arange(len(vec)), np.abs(vec).argmax(axis=1)])
    share = ev / ev.sum() if ev.sum() > 0 else ev
    return Components(tuple(cols), mean, std, vec * sign[:, None], share, matrix)


Moments = tuple[int, np.ndarray, np.ndarray]
MOMENTS_DDL = "key string, n long, mean array<double>, products array<double>"
_MOMENTS = pa.schema([("key", pa.string()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


def merged_moments(a: Moments | None, b: Moments) -> Moments:
    """Rows, means and centred cross products of two parts together."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _moment_rows(found: dict[str | None, Moments]) -> pa.RecordBatch:
    rows = [(k, n, m, p.ravel()) for k, (n, m, p) in found.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_MOMENTS.types)], schema=_MOMENTS)


def _task_moments(held: int = 256):
    """Moments of every group in a task, in one pass; handed on whenever many groups are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, Moments] = {}
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                own = x[order[cuts[k] : cuts[k + 1]]]
                mean = own.mean(axis=0)
                found[name] = merged_moments(found.get(name), (len(own), mean, (own - mean).T @ (own - mean)))
            if len(found) > held:
                yield _moment_rows(found)
                found = {}
        yield _moment_rows(found)

    return run


def _group_components(cols: Sequence[str], orient: int | None, standardise: bool):
    """Merges the moments of a group and finds its first component; ``orient`` is a column that it should rise with."""
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("mean", "std", "weights", "explained"))])

    def run(table: pa.Table) -> pa.Table:
        got: Moments | None = None
        for r in table.sort_by([("n", "ascending")]).to_pylist():
            k = len(r["mean"])
            got = merged_moments(got, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
        n, mean, products = got
        comp = _components(mean[: len(cols)], products[: len(cols), : len(cols)] / n, cols, standardise)
        first = comp.vectors[0]
        if orient is not None and (products[orient, : len(cols)] / comp.std) @ first < 0:
            first = -first
        row = [table.column("key")[0].as_py(), n, comp.mean, comp.std, first, comp.explained]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

    return run


def moment_table(df: DataFrame, cols: Sequence[str], key: Column) -> DataFrame:
    """Mergeable moments (key, n, mean, products) of the complete rows of every group, from one scan."""
    data = df.select(key.cast("string").alias("key"), *[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return data.dropna(subset=[f"c{i}" for i in range(len(cols))]).mapInArrow(_task_moments(), MOMENTS_DDL)


def grouped_components(df: DataFrame, cols: Sequence[str], key: Column, orient: str | None = None, standardise: bool = True) -> DataFrame:
    """First component of the columns in every group: key, n, mean, std, weights, explained.

    All groups come from one scan: tasks hand on one row of moments per group, which a second
    task per group merges. A null key is a group too. Signs make the largest weight positive,
    or, with ``orient``, let the component rise with that column.
    """
    every = [*cols, *([orient] if orient and orient not in cols else [])]
    place = every.index(orient) if orient else None
    parts = moment_table(df, every, key)
    ddl = "key string, n long, mean array<double>, std array<double>, weights array<double>, explained array<double>"
    return parts.groupBy("key").applyInArrow(_group_components(cols, place, standardise), ddl)


def component_score(cols: Sequence[str], mean: str = "mean", std: str = "std", weights: str = "weights") -> Column:
    """Score of a row from the component columns of its group; null if a column is."""
    total = F.lit(0.0)
    for i, c in enumerate(cols):
        total = total + (F.col(q(c)).cast("double") - F.get(mean, F.lit(i))) / F.get(std, F.lit(i)) * F.get(weights, F.lit(i))
    return total


def principal_components(df: DataFrame, cols: Sequence[str], standardise: bool = True) -> Components:
    """Components of the complete rows, from one scan. Signs are fixed so that the largest weight of each is positive."""
    got: Moments | None = None
    for r in moment_table(df, cols, F.lit("")).orderBy("n").toLocalIterator():  # a row per task and flush
        k = len(r["mean"])
        got = merged_moments(got, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    n, mean, products = got or (1, np.zeros(len(cols)), np.zeros((len(cols), len(cols))))
    return _components(mean, products / n, cols, standardise)


def pca_index(
    df: DataFrame, cols: Sequence[str], orient: str, out: str = "index", strata: Sequence[Column] | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """First-component index of standardised columns, null for incomplete rows.

    The sign is turned so that the index rises with ``orient``. With ``strata`` (conditions,
    which may overlap) one index per stratum is added, named ``<out> <name>``; all come from
    one scan.
    """
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(q(c)).isNotNull()
    conds = dict(zip(map(str, range(len(names or [""]))), strata or [F.lit(True)]))
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in conds.items()]))
    tagged = df.filter(complete).withColumn("__stratum", F.explode(tags))
    found = {r["key"]: r for r in grouped_components(tagged, cols, F.col("__stratum"), orient).collect()}  # a row per stratum
    new = {}
    for name, (k, cond) in zip(names or [""], conds.items()):
        label = f"{out} {name}".strip()
        if k not in found:
            new[label] = F.lit(None).cast("double")
            continue
        r = found[k]
        score = F.lit(0.0)
        for c, m, s, w in zip(cols, r["mean"], r["std"], r["weights"]):
            score = score + (F.col(q(c)).cast("double") - F.lit(m)) / F.lit(s) * F.lit(w)
        new[label] = F.when(cond & complete, score)
    return df.withColumns(new)


def pca_reduce(df: DataFrame, cols: Sequence[str], explained: float = 0.98, prefix: str = "pc") -> tuple[DataFrame, Components]:
    """Columns replaced by as many components as explain the wanted share of variance."""
    comp = principal_components(df, cols, standardise=False)
    need = int(np.searchsorted(np.cumsum(comp.explained), explained - 1e-12) + 1)
    keep = [F.col(q(c)) for c in df.columns if c not in cols]
    return df.select(*keep, *[s.alias(f"{prefix}{i}") for i, s in enumerate(comp.scores(need))]), comp


def cross_validate(
    df: DataFrame, features: Sequence[str], label: str, ident: str, roles: Sequence[str], model: str = "linear",
    scale_label: bool = False, seed: int = 42,
) -> DataFrame:
    """Predictions of the test and validation rows of every fold: ident, fold, role, Actual, Prediction.

    ``roles`` are the role columns (train, val, test), one per fold.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    data = df.dropna(subset=[*features, label])
    mean, sd = 0.0, 1.0
    if scale_label:
        r = data.agg(F.avg(label), F.stddev_pop(label)).first()
        mean, sd = r[0], r[1] or 1.0
    data = data.withColumn("__y", (F.col(label).cast("double") - mean) / sd)
    data = cut_lineage(data.select(ident, *features, "__y", *roles))
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x")
    out = None
    for nr, role in enumerate(roles):
        if model == "linear":
            est = LinearRegression(featuresCol="__x", labelCol="__y", predictionCol="__p")
        elif model == "boosting":
            est = GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="__p", seed=seed)
        else:
            raise ValueError(f"unknown model {model}")
        fitted = Pipeline(stages=[assembler, est]).fit(data.filter(F.col(role) == "train"))
        part = fitted.transform(data.filter(F.col(role).isin("val", "test"))).select(
            ident, F.lit(nr).alias("fold"), F.col(role).alias("role"),
            (F.col("__y") * sd + mean).alias("Actual"), (F.col("__p") * sd + mean).alias("Prediction"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def partial_dependence(df: DataFrame, predict, features: Sequence[str], points: int = 10) -> DataFrame:
    """Mean prediction when a feature is set to each of its quantile grid values: feature, value, prediction.

    ``predict`` turns a frame with the features into one with a ``prediction`` column. Each
    row is repeated once per grid value, whatever the size of the table.
    """
    probs = {f"p{i}": i / (points - 1) for i in range(points)}
    out = None
    for f in features:
        row = exact_quantiles(df, [], f, probs).first()
        grid = sorted({float(row[p]) for p in probs if row is not None and row[p] is not None})
        if len(grid) <= 1:
            continue
        spread = df.select(*features).withColumn("__grid", F.explode(F.array(*[F.lit(g) for g in grid]))).withColumn(f, F.col("__grid"))
        part = predict(spread).groupBy("__grid").agg(F.avg("prediction").alias("prediction"))
        part = part.select(F.lit(f).alias("feature"), F.col("__grid").alias("value"), "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def linear_predictor(intercept: float, weights: dict[str, float]):
    def predict(df: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for c, w in weights.items():
            total = total + F.col(q(c)) * F.lit(float(w))
        return df.withColumn("prediction", total)

    return predict


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n entries."""
    n = np.asarray(n, float)
    safe = np.where(n > 2, n, 3)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, threshold, left, right, path length at the leaf) of one random tree."""
    nodes: list = []

    def add(part: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            nodes[me] = (-1, 0.0, -1, -1, float(depth + _average_path(len(part))))
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        goes = part[:, f] <= t
        nodes[me] = (f, t, add(part[goes], depth + 1), add(part[~goes], depth + 1), 0.0)
        return me

    add(x, 0)
    return nodes


def isolation_forest(
    df: DataFrame, ident: str, features: Sequence[str], trees: int = 100, max_samples: int = 3500, seed: int = 1,
    out: str = "anomaly",
) -> DataFrame:
    """Rows with ``anomaly_score`` and ``anomaly`` (score above one half), from an isolation forest
    (Liu et al. 2008) on standardised features.

    Every tree grows in its own task on a seeded sample of at most ``max_samples`` rows;
    the trees, whose size does not depend on the table, are sent back to score all rows.
    """
    data = df.dropna(subset=list(features))
    n = data.count()
    size = min(n, max_samples)
    stats = data.agg(F.array(*[F.avg(q(f)) for f in features]).alias("m"), F.array(*[F.stddev_pop(q(f)) for f in features]).alias("s")).first()
    z = [((F.col(q(f)).cast("double") - F.lit(m)) / F.lit(s or 1.0)).alias(f"x{i}") for i, (f, m, s) in enumerate(zip(features, stats["m"], stats["s"]))]
    names = [f"x{i}" for i in range(len(features))]
    std = data.select(F.col(ident), *z)
    # twice the wanted share is drawn, so that the exact number is almost surely reached
    share = min(1.0, 2.0 * size / max(n, 1))
    if share * trees < 1:
        # few of the rows are drawn at all: each goes to one tree
        drawn = std.filter(seeded_unit(seed, ident) < share * trees).withColumn(
            "tree", F.pmod(seeded_hash(f"{seed}-tree", ident), F.lit(trees)).cast("int")
        )
    else:
        drawn = std.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).filter(
            seeded_unit(seed, "tree", ident) < share
        )
    drawn = drawn.withColumn("h", seeded_hash(seed, "tree", ident))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.nsmallest(size, "h")
        t = int(pdf["tree"].iloc[0])
        nodes = _grow(pdf[names].to_numpy(float), np.random.default_rng([seed, t]), limit)
        return pd.DataFrame([(t, i, *nd) for i, nd in enumerate(nodes)], columns=["tree", "node", "f", "t", "l", "r", "len"])

    grown = drawn.select("tree", "h", *names).groupBy("tree").applyInPandas(
        grow, "tree int, node int, f int, t double, l int, r int, len double"
    )
    # at most trees · 2 · max_samples nodes, whatever the table holds
    flat = grown.toPandas().sort_values(["tree", "node"])
    forest = [
        tuple(part[c].to_numpy() for c in ("f", "t", "l", "r", "len")) for _, part in flat.groupby("tree", sort=True)
    ]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = float(_average_path(size)) or 1.0

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in parts:
            cols = cols if isinstance(cols, tuple) else (cols,)
            x = np.column_stack([c.to_numpy(float) for c in cols])
            total = np.zeros(len(x))
            for f, t, left, right, length in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = np.flatnonzero(f[at] >= 0)
                    if len(inner) == 0:
                        break
                    a = at[inner]
                    goes = x[inner, f[a]] <= t[a]
                    at[inner] = np.where(goes, left[a], right[a])
                total += length[at]
            yield pd.Series(2.0 ** (-(total / max(len(shared.value), 1)) / norm))

    z_cols = [((F.col(q(f)).cast("double") - F.lit(m)) / F.lit(s or 1.0)) for f, m, s in zip(features, stats["m"], stats["s"])]
    scored = data.withColumn(f"{out}_score", score(*z_cols))
    return scored.withColumn(out, F.col(f"{out}_score") > 0.5)


def label_codes(df: DataFrame, col: str, drop: float = 0.05, to_other: bool = False, replace: dict | None = None) -> DataFrame:
    """Codes of the categories from the most frequent down; categories at or below the share ``drop``
    are replaced as told, mapped to ``other`` or dropped: category, n, share, code, target."""
    from surveyspark.operators.joins import category_rank

    counts = df.filter(F.col(q(col)).isNotNull()).groupBy(F.col(q(col)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    ranked = counts.join(category_rank(counts, "category", [F.desc("n"), F.asc("category")], "rank"), "category")
    share = F.col("n") / total
    target = F.when(share > drop, F.col("category").cast("string"))
    for old, new in (replace or {}).items():
        target = F.coalesce(target, F.when(F.col("category") == old, F.lit(str(new))))
    if to_other:
        target = F.coalesce(target, F.lit("other"))
    return ranked.select(
        "category", "n", share.alias("share"), F.when(share > drop, F.col("rank")).alias("code"), target.alias("target")
    )
