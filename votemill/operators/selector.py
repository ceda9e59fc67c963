"""Choosing between a problem's two heaviest answers: contrast features, a two-headed utility, nested thresholds.

The heads are logistic regressions with a ridge, fitted to all contested problems by Newton's steps from sums over the rows (no
row reaches the driver); scores are column expressions of the fitted weights. Problems of a fold are scored by weights that were fitted
without them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.votes import by_id, rounded, shifted, valid, weight
from votemill.sources.scratch import written

COLUMNS = (
    "w_share1", "w_share2", "w_gap", "w_ratio", "c_share1", "c_gap", "n_distinct", "lp1_mean", "lp2_mean", "lp_gap", "lp1_var",
    "len1_mean", "len2_mean", "len_gap", "trunc1", "trunc2", "seed_agree",
)
#: Ridge, Newton's steps, bound of a margin, and the deviation up to which a column counts as constant.
L2, STEPS, CLIP, SAME = 1e-3, 8, 30.0, 1e-9
LENGTH = 2048.0


def tally(ballots: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per answer its weight, votes, mean and variance of logp, mean length, truncated votes, and its rank by weight."""
    rows = shifted(ballots, keys).filter(valid()).groupBy(*keys, "ans").agg(
        F.min("pos").alias("f"), rounded(weight()).alias("w"), F.count("*").alias("c"), F.avg("logp").alias("lp"), F.var_pop("logp").alias("lv"),
        F.avg("len").alias("ln"), F.sum(F.col("trunc").cast("int")).alias("tr"),
    )
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), "f")))


def agreement(ballots: DataFrame, top: DataFrame, seed: str = "seed") -> DataFrame:
    """id, agree: the share of seeds with a heaviest answer of their own that gives the problem's (top: id, a1)."""
    own = tally(ballots, (seed, "id")).filter("k = 1").select("id", F.col("ans").alias("own"))
    return own.join(top.select("id", "a1"), "id").groupBy("id").agg(F.avg((F.col("own") == F.col("a1")).cast("double")).alias("agree"))


def features(ballots: DataFrame) -> DataFrame:
    """id, a1, a2 (the two heaviest answers) and COLUMNS, of problems with two answers or more."""
    t = tally(ballots).withColumns({"tw": F.sum("w").over(by_id()), "tc": F.sum("c").over(by_id()), "u": F.count("*").over(by_id())}).filter("k <= 2")
    x = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    picked = t.groupBy("id").agg(*[x(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("ans", "w", "c", "lp", "lv", "ln", "tr")], *[F.max(c).alias(c) for c in ("tw", "tc", "u")])
    picked = picked.filter("ans2 IS NOT NULL").withColumnsRenamed({"ans1": "a1", "ans2": "a2"})
    size = ballots.groupBy("id").agg(F.count("*").alias("n"))
    rows = picked.join(size, "id").join(agreement(ballots, picked), "id", "left")
    c = F.col
    made = {
        "w_share1": c("w1") / c("tw"), "w_share2": c("w2") / c("tw"), "w_gap": (c("w1") - c("w2")) / c("tw"), "w_ratio": c("w2") / c("w1"),
        "c_share1": c("c1") / c("tc"), "c_gap": (c("c1") - c("c2")) / c("tc"), "n_distinct": c("u") / c("n"),
        "lp1_mean": c("lp1"), "lp2_mean": c("lp2"), "lp_gap": c("lp1") - c("lp2"), "lp1_var": c("lv1"),
        "len1_mean": c("ln1") / LENGTH, "len2_mean": c("ln2") / LENGTH, "len_gap": (c("ln1") - c("ln2")) / LENGTH,
        "trunc1": c("tr1") / c("c1"), "trunc2": c("tr2") / c("c2"), "seed_agree": F.coalesce("agree", F.lit(0.5)),
    }
    return rows.select("id", "a1", "a2", *[(F.round(v, 6) + 0.0).alias(k) for k, v in made.items()])


def utility(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """rows with u: 1 if the second answer is right, -1 if the first is, else 0."""
    u = F.when(F.col("a1") == F.col("gold"), -1).when(F.col("a2") == F.col("gold"), 1).otherwise(0)
    return rows.join(gold.select("id", "gold"), "id").withColumn("u", u).drop("gold")


def prepared(rows: DataFrame, folds: int = 5, inner: int = 4) -> DataFrame:
    """id, fold, inner, u and x: COLUMNS as standard scores over all rows, and 1. rows: id, u and COLUMNS."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in COLUMNS for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    score = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > SAME, F.col(f"s_{c}")).otherwise(1.0)
    x = F.array(*[score(c) for c in COLUMNS], F.lit(1.0))
    scaled = rows.join(F.broadcast(stats))  # stats: one row
    return scaled.select("id", (F.col("id") % folds).cast("int").alias("fold"), (F.floor(F.col("id") / folds) % inner).cast("int").alias("inner"), "u", x.alias("x"))


def newton(rows: DataFrame, fits: list[tuple[int, int | None]], steps: int = STEPS) -> np.ndarray:
    """Weights of the logistic regressions of u = 1 against u = -1, one for each fit (fold, inner): over the rows outside both.

    A step sends, for each task and fit, the sums of q x x' and of (p - y) x over the task's rows, which add up; the driver solves one
    system of len(x) equations a fit. No row reaches the driver, and each step reads the table once for all fits.
    """
    size = len(COLUMNS) + 1
    weights = np.zeros((len(fits), size))

    def sums(batches):
        total, n = np.zeros((len(fits), size, size + 1)), np.zeros(len(fits))
        for batch in batches:
            u, fold, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "fold", "inner"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(u), size)
            for f, (k, j) in enumerate(fits):
                at = (u != 0) & (fold != k) & ((own != j) if j is not None else True)
                xs = x[at]
                p = 1 / (1 + np.exp(-np.clip(xs @ weights[f], -CLIP, CLIP)))
                total[f, :, :size] += xs.T @ (xs * (p * (1 - p))[:, None])
                total[f, :, size] += xs.T @ (p - (u[at] == 1))
                n[f] += at.sum()
        values = pa.array(list(np.column_stack([total.reshape(len(fits), -1), n])), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), values], names=["fit", "s"])

    for _ in range(steps):
        parts = rows.select("u", "fold", "inner", "x").mapInArrow(sums, "fit int, s array<double>")
        found = parts.select("fit", F.posexplode("s").alias("i", "v")).groupBy("fit", "i").agg(F.sum("v").alias("v")).collect()  # fits * size * (size + 1) numbers
        whole = np.zeros((len(fits), size * (size + 1) + 1))
        for r in found:
            whole[r["fit"], r["i"]] = r["v"]
        for f in range(len(fits)):
            m, n = whole[f, :-1].reshape(size, size + 1), whole[f, -1]
            if n:
                weights[f] -= np.linalg.solve(m[:, :size] / n + L2 * np.eye(size), m[:, size] / n + L2 * weights[f])
    return weights


def expected(weights: Column) -> Column:
    """P(rescue) - P(harm) of x by weights (arrays): one head is the other's mirror, as neutral rows teach neither."""
    z = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.round(2 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP)))) - 1, 9)


def thresholds(rows: DataFrame, weights: np.ndarray, fits: list[tuple[int, int | None]], folds: int) -> dict[int, int]:
    """For each fold the threshold, in thousandths, from which flipping pays most by the scores of the other folds' inner fits; 1000 if none pays."""
    table = F.array(*[F.array(*map(F.lit, w.tolist())) for w in weights])
    place = F.create_map(*[v for f, (k, j) in enumerate(fits) if j is not None for v in (F.lit(f"{k},{j}"), F.lit(f))])
    each = rows.withColumn("k", F.explode(F.array_remove(F.array(*map(F.lit, range(folds))), F.col("fold"))))
    scored = each.select("k", "u", expected(table[place[F.concat_ws(",", "k", "inner")]]).alias("score"))
    cells = scored.groupBy("k", F.floor(F.col("score") * 1000).alias("cell")).agg(F.sum("u").alias("u"), F.max(F.round(F.col("score") * 1000)).alias("high"), F.min(F.round(F.col("score") * 1000)).alias("low")).collect()
    best = {}
    for k in range(folds):  # 2,001 cells a fold at most
        own = [r for r in cells if r["k"] == k]
        gain, found = 0, 1000
        for c in sorted({int(v) for r in own for v in (r["high"], r["low"])}, reverse=True):
            net = sum(r["u"] for r in own if r["cell"] >= c)
            if net > gain:
                gain, found = net, c
        best[k] = found
    return best


def two_heads(rows: DataFrame, folds: int = 5, inner: int = 4, nested: bool = False) -> DataFrame:
    """id, fold, u, score = P(rescue) - P(harm) by a fit outside the fold; nested: and flip, whether the score reaches the threshold
    that was best inside the other folds. rows: id, u and COLUMNS."""
    rows = written(prepared(rows, folds, inner))
    fits = [(k, None) for k in range(folds)] + [(k, j) for k in range(folds) for j in range(inner) if nested]
    weights = newton(rows, fits)
    own = F.array(*[F.array(*map(F.lit, w.tolist())) for w in weights[:folds]])[F.col("fold")]
    out = rows.select("id", "fold", "u", expected(own).alias("score"))
    if not nested:
        return out
    cut = F.array(*[F.lit(c) for _, c in sorted(thresholds(rows, weights, fits, folds).items())])[F.col("fold")]
    return out.withColumn("flip", F.col("score") * 1000 >= cut)


def flips(scored: DataFrame) -> DataFrame:
    """fold, flips, rescued, harmed, net of the problems whose answer is flipped."""
    f = F.col("flip")
    count = lambda c: F.sum(c.cast("long"))
    return scored.groupBy("fold").agg(count(f).alias("flips"), count(f & (F.col("u") == 1)).alias("rescued"), count(f & (F.col("u") == -1)).alias("harmed"), F.sum(F.when(f, F.col("u")).otherwise(0)).cast("long").alias("net"))
