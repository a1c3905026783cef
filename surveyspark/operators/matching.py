"""Best matches between the answers of two questions, and unification of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(vec: Column) -> Column:
    """Vector scaled to length one."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(vec, lambda v: v.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def token_weights(df: DataFrame, ident: str, tokens: str) -> DataFrame:
    """Binary token vectors of length one: id, token, w, size; equal token sets give equal vectors."""
    return df.select(ident, F.explode(F.array_distinct(tokens)).alias("token"), F.size(F.array_distinct(tokens)).alias("size"))


def set_cosine_join(left: DataFrame, right: DataFrame, ident: str, tokens: str, at_least: float, same: bool = False) -> DataFrame:
    """All pairs of token sets with cosine similarity at least ``at_least``, exactly.

    Prefix filtering (Chaudhuri et al. 2006): tokens are ordered from rare to common and
    only the first ``size - ceil(t² · size) + 1`` tokens of a set are used as join keys,
    since two sets that similar must share one of them. Common tokens are therefore hardly
    ever keys. Sets of equal tokens are reduced to one before the join.
    """
    both = left.select(tokens) if same else left.select(tokens).unionByName(right.select(tokens))
    freq = both.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("f"))

    def sets(df: DataFrame) -> DataFrame:
        return df.select(F.array_sort(F.array_distinct(tokens)).alias("s")).distinct().filter(F.size("s") > 0).withColumn(
            "sid", F.md5(F.array_join("s", "\u0001"))
        )

    def prefixes(s: DataFrame) -> DataFrame:
        ordered = (
            s.select("sid", F.size("s").alias("n"), F.explode("s").alias("token"))
            .join(freq, "token")
            .groupBy("sid", "n")
            .agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("o"))
        )
        keep = F.col("n") - F.ceil(F.lit(at_least * at_least) * F.col("n") - 1e-9) + 1
        return ordered.select("sid", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("p")).select("sid", "p.token")

    ls, rs = sets(left), sets(right)
    cand = (
        prefixes(ls).withColumnRenamed("sid", "l").join(prefixes(rs).withColumnRenamed("sid", "r"), "token")
        .select("l", "r").distinct()
    )
    if same:
        cand = cand.filter(F.col("l") < F.col("r"))
    scored = (
        cand.join(ls.select(F.col("sid").alias("l"), F.col("s").alias("ls")), "l")
        .join(rs.select(F.col("sid").alias("r"), F.col("s").alias("rs")), "r")
        .withColumn(
            "similarity",
            F.size(F.array_intersect("ls", "rs")) / F.sqrt((F.size("ls") * F.size("rs")).cast("double")),
        )
        .filter(F.col("similarity") >= at_least - 1e-12)
    )
    return scored.select("l", "r", "similarity")


def set_ids(df: DataFrame, ident: str, tokens: str) -> DataFrame:
    """Which set every id has: id, sid."""
    return df.filter(F.size(tokens) > 0).select(
        ident, F.md5(F.array_join(F.array_sort(F.array_distinct(tokens)), "\u0001")).alias("sid")
    )


def best_answer_match(
    left: DataFrame, right: DataFrame, ident: str, tokens: str, above: float = 0.85
) -> DataFrame:
    """For every answer of ``left`` the most similar answer of ``right`` above the threshold, else null.

    Ties take the match with the smallest id. Result: id, match, similarity (0 to 100).
    """
    pairs = set_cosine_join(left, right, ident, tokens, above)
    reps = set_ids(right, ident, tokens).groupBy("sid").agg(F.min(ident).alias("match"))
    best = (
        pairs.filter(F.col("similarity") > above)
        .join(reps.withColumnRenamed("sid", "r"), "r")
        .groupBy("l")
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("match"))).alias("b"))
    )
    return (
        left.select(ident, tokens)
        .join(set_ids(left, ident, tokens), ident, "left")
        .join(best.withColumnRenamed("l", "sid"), "sid", "left")
        .select(ident, F.col("b.match").alias("match"), F.round(-F.col("b.s") * 100, 6).alias("similarity"))
    )


# --- Fixed values: rounds of the unification and how shares move the threshold ------------
ROUND_THRESHOLDS = [97, 95, 94, 92, 90, 88, 85]
# ----------------------------------------------------------------------------------------


def share_adjustment(percent: Column, round_nr: int) -> Column:
    """Change of the threshold: rare answers are merged earlier, frequent ones later."""
    r = round_nr
    return (
        F.when(percent < 0.05, -10.0 * r).when(percent < 0.2, -7.0 * r).when(percent < 0.5, -6.0 * r)
        .when(percent < 1, -4.0 * r).when(percent > 20, 4.0 * (7 - r)).when(percent > 15, 3.0 * (7 - r))
        .when(percent > 10, 2.0 * (7 - r)).when(percent > 7, 1.75 * (6 - r)).when(percent > 4, 1.0 * (6 - r))
        .when(percent > 2, 0.5 * (6 - r)).when(percent > 1, 0.25 * (6 - r)).otherwise(0.0)
    )


def unify_answers(
    answers: DataFrame, scores: DataFrame, thresholds: Sequence[float] = ROUND_THRESHOLDS
) -> tuple[DataFrame, DataFrame]:
    """Merge similar answers of each question in rounds of falling thresholds.

    ``answers``: column, answer, percent. ``scores``: column, a, b, score, matched – the
    similarity of candidate pairs (0 to 100) and whether an important word was met.
    Every round offers each remaining answer its most similar more frequent answer and
    merges it if the score beats the threshold adjusted by its share; chains end at their
    first answer. All questions advance together, as joins on (column, answer).

    Result: mapping (column, step, from, to) and the merged shares.
    """
    from surveyspark.core.session import cut_lineage

    current = answers.select("column", "answer", "percent")
    both = scores.select("column", F.col("a").alias("x"), F.col("b").alias("y"), "score", "matched").unionByName(
        scores.select("column", F.col("b").alias("x"), F.col("a").alias("y"), "score", "matched")
    )
    both = cut_lineage(both)
    mapping = None
    for nr, limit in enumerate(thresholds):
        current = cut_lineage(current)
        sizes = current.groupBy("column").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")
        live = current.join(sizes.select("column"), "column", "left_semi")
        x = live.select("column", F.col("answer").alias("x"), F.col("percent").alias("px"))
        y = live.select("column", F.col("answer").alias("y"), F.col("percent").alias("py"))
        earlier = (F.col("py") > F.col("px")) | ((F.col("py") == F.col("px")) & (F.col("y") < F.col("x")))
        best = (
            both.join(x, ["column", "x"]).join(y, ["column", "y"]).filter(earlier)
            .groupBy("column", "x", "px")
            .agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("py")).alias("p"), F.col("y"), F.col("matched"))).alias("b"))
        )
        need = F.lit(float(limit)) + F.when(~F.col("b.matched"), float(10 - nr)).otherwise(0.0) + share_adjustment(F.col("px"), nr)
        merged = cut_lineage(
            best.filter(-F.col("b.s") > need).select("column", F.col("x").alias("from"), F.col("b.y").alias("to"))
        )
        # follow chains to the answer that is not merged itself; pointer doubling
        while True:
            nxt = merged.select("column", F.col("from").alias("to"), F.col("to").alias("__next"))
            step = merged.join(nxt, ["column", "to"], "left")
            open_ = step.filter("__next IS NOT NULL").limit(1).count()
            if not open_:
                break
            merged = cut_lineage(step.select("column", "from", F.coalesce("__next", "to").alias("to")))
        mapping_part = merged.select("column", F.lit(nr + 1).alias("step"), "from", "to")
        mapping = mapping_part if mapping is None else mapping.unionByName(mapping_part)
        current = (
            current.join(merged.withColumnRenamed("from", "answer"), ["column", "answer"], "left")
            .groupBy("column", F.coalesce("to", "answer").alias("answer"))
            .agg(F.sum("percent").alias("percent"))
        )
    return mapping, current
