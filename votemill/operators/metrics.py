"""Accuracy, diversity, truncation and rank metrics over ballots and gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.ranges import running
from votemill.operators.votes import by_id, count, rounded, shifted, valid, weight


def right() -> Column:
    return F.coalesce(F.col("ans") == F.col("gold"), F.lit(False))


def share(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("int")), 9)


def pass_at_n(ballots: DataFrame, gold: DataFrame, ns: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """n, problems, passed: whether the gold answer is among the first n ballots."""
    got = ballots.join(gold, "id").groupBy("id").agg(F.min(F.when(right(), F.col("pos"))).alias("at"))
    grid = got.withColumn("n", F.explode(F.array(*map(F.lit, ns))))
    return grid.groupBy("n").agg(count().alias("problems"), F.sum(F.coalesce(F.col("at") < F.col("n"), F.lit(False)).cast("long")).alias("passed"))


def ranked_answers(ballots: DataFrame, by: str = "votes") -> DataFrame:
    """Tally of each problem's answers: votes, weight, sums of logp and len, truncated ones, and the rank."""
    tally = shifted(ballots).filter(valid()).groupBy("id", "ans").agg(
        F.min("pos").alias("first"), count().alias("votes"), rounded(weight()).alias("weight"), F.round(F.sum("logp"), 6).alias("logp_sum"),
        F.sum("len").alias("len_sum"), F.sum(F.col("trunc").cast("long")).alias("n_trunc"),
    )
    return tally.withColumn("rank", F.row_number().over(by_id().orderBy(F.desc(by), "first")))


def topk_hits(ballots: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    at = ranked_answers(ballots).join(gold, "id").groupBy("id").agg(F.min(F.when(right(), F.col("rank"))).alias("at"))
    grid = at.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return grid.groupBy("k").agg(count().alias("problems"), F.sum(F.coalesce(F.col("at") <= F.col("k"), F.lit(False)).cast("long")).alias("hits"))


def diversity(ballots: DataFrame) -> DataFrame:
    per = ballots.groupBy("id", "ans").agg(count().alias("n")).groupBy("id").agg(F.count("ans").alias("distinct"), F.max(F.when(valid(), F.col("n"))).alias("top"), F.sum(F.when(valid(), F.col("n"))).alias("all"))
    return per.agg(
        count().alias("problems"), F.round(F.avg(F.when(F.col("all") > 0, F.col("distinct"))), 9).alias("distinct_avg"),
        F.round(F.avg(F.col("top") / F.col("all")), 9).alias("top1_share"), F.sum((F.coalesce("all", F.lit(0)) == 0).cast("long")).alias("no_answer"),
    )


def truncation(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """Rates of truncated samples among right and wrong ones, problems that only truncated samples lack, and the ceiling."""
    b = ballots.join(gold, "id")
    per = b.groupBy("id").agg(F.max(right()).alias("any_right"), F.max(F.col("trunc")).alias("any_trunc"), F.min(F.col("trunc")).alias("all_trunc"))
    one = b.agg(share(F.col("trunc")).alias("rate"), F.round(F.avg(F.when(right(), F.col("trunc").cast("int"))), 9).alias("rate_right"), F.round(F.avg(F.when(~right(), F.col("trunc").cast("int"))), 9).alias("rate_wrong"))
    two = per.agg(F.sum((~F.col("any_right") & F.col("any_trunc")).cast("long")).alias("recoverable"), F.sum((F.col("any_right") | F.col("any_trunc")).cast("long")).alias("ceiling"), F.sum(F.col("all_trunc").cast("long")).alias("all_truncated"))
    return one.join(F.broadcast(two))  # one row each


def regions(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """Problems by region: the vote is right, gold is among the ballots but loses, or no ballot is right."""
    tally = ballots.join(gold, "id").groupBy("id", "gold", "ans").agg(F.min("pos").alias("first"), count().alias("n"))
    per = tally.groupBy("id", "gold").agg(F.max_by("ans", F.when(valid(), F.struct("n", -F.col("first")))).alias("answer"), F.max(right()).alias("has"))
    region = F.when(F.col("answer") == F.col("gold"), "vote_correct").when(F.col("has"), "recoverable").otherwise("no_correct")
    return per.groupBy(region.alias("region")).agg(count().alias("problems"))


def shares(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """Weighted share of gold and of the strongest wrong answer, and the number of answers, by problem."""
    tally = shifted(ballots).filter(valid()).join(gold, "id").groupBy("id", "gold", "ans").agg(weight().alias("w"))
    return tally.groupBy("id").agg(
        F.round(F.coalesce(F.sum(F.when(right(), F.col("w"))), F.lit(0.0)) / F.sum("w"), 6).alias("gold_share"),
        F.round(F.coalesce(F.max(F.when(~right(), F.col("w"))), F.lit(0.0)) / F.sum("w"), 6).alias("wrong_share"), count().alias("n_unique"),
    )


def category_accuracy(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """Per category and seed, and over all (rollup): problems, right votes, problems with a right ballot."""
    tally = ballots.join(gold, "id").groupBy("seed", "category", "id", "gold", "ans").agg(F.min("pos").alias("first"), count().alias("n"))
    per = tally.groupBy("seed", "category", "id", "gold").agg(F.max_by("ans", F.when(valid(), F.struct("n", -F.col("first")))).alias("answer"), F.max(right()).alias("has"))
    hit = F.coalesce(F.col("answer") == F.col("gold"), F.lit(False))
    out = per.rollup("category", "seed").agg(count().alias("problems"), F.sum(hit.cast("long")).alias("correct"), F.sum(F.col("has").cast("long")).alias("passed"))
    return out.select(F.coalesce("category", F.lit("ALL")).alias("category"), F.coalesce("seed", F.lit(-1)).alias("seed"), "problems", "correct", "passed")


def cumulative_failures(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """Categories by failures, with the running share of all failures."""
    per = ballots.join(gold, "id").groupBy("category", "id").agg(F.max(right()).alias("has"))
    fails = per.groupBy("category").agg(F.sum((~F.col("has")).cast("long")).alias("failures"))
    order = Window.orderBy(F.desc("failures"), "category")  # one row a category
    total = F.sum("failures").over(Window.partitionBy())
    return fails.select("category", "failures", F.round(F.sum("failures").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total, 9).alias("cum_share"))


def homogeneity(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """How uniform the samples behind gold and behind a wrong winner are: variation of length, deviation of logp."""
    tally = ballots.filter(valid()).join(gold, "id").groupBy("id", "gold", "ans").agg(
        F.min("pos").alias("first"), count().alias("n"), (F.stddev_samp("len") / F.avg("len")).alias("cv"), F.stddev_samp("logp").alias("sd")
    )
    ranked = tally.withColumn("rank", F.row_number().over(by_id().orderBy(F.desc("n"), "first"))).filter(F.col("n") >= 2)
    kind = F.when(right(), "gold").when(F.col("rank") == 1, "wrong_winner")
    return ranked.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("kind").agg(count().alias("groups"), F.round(F.avg("cv"), 6).alias("len_cv"), F.round(F.avg("sd"), 6).alias("logp_sd"))


def moments(ballots: DataFrame) -> DataFrame:
    """Mean, variance and deviations of logp, and the correlation of logp with length, by problem size."""
    per = ballots.withColumn("size", F.count("*").over(by_id()))
    return per.groupBy("size").agg(
        F.round(F.avg("logp"), 9).alias("mean"), F.round(F.var_pop("logp"), 9).alias("var_pop"), F.round(F.stddev_samp("logp"), 9).alias("sd"), F.round(F.stddev_pop("logp"), 9).alias("pstdev"), F.round(F.corr("logp", "len"), 6).alias("corr")
    )


def histogram(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """Problems by number of right ballots."""
    per = ballots.join(gold, "id").groupBy("id").agg(F.sum(right().cast("long")).alias("n_right"))
    return per.groupBy("n_right").agg(count().alias("problems"))


def index_quantile(values: DataFrame, column: str, q: float) -> DataFrame:
    """The value at index floor(n q) of the sorted column (no interpolation): counts by value, then a running sum."""
    by_value = values.filter(F.col(column).isNotNull()).groupBy(column).agg(count().alias("n"))
    run = running(by_value, [F.col(column)], {"upto": F.col("n")})
    total = by_value.agg(F.sum("n").alias("total"))
    return run.join(F.broadcast(total)).filter(F.col("upto") > F.floor(F.col("total") * q)).agg(F.min(column).alias("quantile"), F.max("total").alias("n"))  # total: one row


def auc(rows: DataFrame, score: str, label: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mann-Whitney AUC with ties at one half, from counts by score: no pair of rows is formed."""
    y = label.cast("long")
    by_score = rows.groupBy(*keys, score).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    if keys:
        below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        by_score = running(by_score, [F.col(score)], {"upto": F.col("q")})
        below = F.col("upto") - F.col("q")
    won = by_score.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    total = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return total.select(*keys, "n_pos", "n_neg", F.round(F.when(pairs > 0, F.col("won") / pairs), 9).alias("auc"))


def gain_curve(rows: DataFrame, score: str) -> DataFrame:
    """Rows by falling score with running counts of rescued and harmed and their difference."""
    run = running(rows, [-F.col(score), F.col("id")], {"rescued_cum": F.col("rescued"), "harmed_cum": F.col("harmed")})
    return run.withColumn("net", F.col("rescued_cum") - F.col("harmed_cum"))


def gap_correlation(ballots: DataFrame, gold: DataFrame, value: str = "logp") -> DataFrame:
    """Over problems where gold and the strongest wrong answer have two votes or more each: their number, and the Pearson
    correlation of the gap of mean lengths with the gap of the mean of `value` (null without spread)."""
    t = ballots.filter("ans IS NOT NULL").join(gold.select("id", "gold"), "id").groupBy("id", "ans", (F.col("ans") == F.col("gold")).alias("ok")).agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.avg("len").alias("l"), F.avg(value).alias("v")
    )
    side = lambda ok: F.max_by(F.struct("n", "l", "v"), F.when(F.col("ok") == ok, F.struct("n", -F.col("first"))))
    p = t.groupBy("id").agg(side(True).alias("g"), side(False).alias("w")).filter("g.n >= 2 AND w.n >= 2")
    x, y = F.col("g.l") - F.col("w.l"), F.col("g.v") - F.col("w.v")
    spread = (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    return p.agg(F.count("*").alias("problems"), F.round(F.avg(x), 6).alias("length_gap"), F.round(F.avg(y), 6).alias("value_gap"), F.round(F.when(spread, F.corr(x, y)), 6).alias("correlation"))
