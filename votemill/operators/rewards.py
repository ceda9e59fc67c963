"""Advantages, shaped rewards and token-level confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.votes import by_id, elect, rounded, shifted, valid


def grpo(ballots: DataFrame, gold: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Reward 1 for the gold answer, and the advantage: its standard score within the problem (0 without spread)."""
    r = F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("double")
    rows = ballots.join(gold, "id").withColumn("reward", r)
    sd = F.stddev_pop("reward").over(by_id())
    adv = F.when(sd > 1e-12, (F.col("reward") - F.avg("reward").over(by_id())) / (sd + eps)).otherwise(0.0)
    return rows.withColumn("advantage", adv)


def edas(advantages: DataFrame, alpha: float = 0.4, beta: float = 0.2, kappa: float = 2.0) -> DataFrame:
    """Advantages of wrong ballots shifted by how common their error is among the problem's errors.

    Missing answers are an error class of their own. With K classes among N wrong ballots, mean |advantage| S and
    entropy H, the shift is alpha S (-ln share - H) / ln N, or -beta S if all err alike; it is clipped to |A| / kappa.
    """
    wrong = F.col("reward") == 0
    rows = advantages.withColumns({"w": wrong, "cls": F.coalesce("ans", F.lit("NONE"))})
    by_class = Window.partitionBy("id", "w", "cls")
    by_side = Window.partitionBy("id", "w")
    rows = rows.withColumns({"n_c": F.count("*").over(by_class), "n_w": F.count("*").over(by_side), "s": F.avg(F.abs("advantage")).over(by_side), "lo": F.min("cls").over(by_side), "hi": F.max("cls").over(by_side)})
    share = F.col("n_c") / F.col("n_w")
    rows = rows.withColumn("h", F.sum(-F.log(share) / F.col("n_w")).over(by_side))  # each ballot adds its class's part
    delta = F.when(F.col("n_w") <= 1, 0.0).when(F.col("lo") == F.col("hi"), -beta * F.col("s")).otherwise(alpha * F.col("s") * (-F.log(share) - F.col("h")) / F.log("n_w"))
    clipped = F.signum(delta) * F.least(F.abs(delta), F.abs("advantage") / kappa)
    return rows.select("id", "pos", F.round("advantage", 6).alias("advantage"), F.round(F.when(F.col("w"), F.col("advantage") + clipped).otherwise(F.col("advantage")), 6).alias("shaped"))


def marginal_credit(ballots: DataFrame, gold: DataFrame) -> DataFrame:
    """M(S) - M(S without i), M = votes for gold less the most votes of a wrong answer.

    Closed form: a gold ballot is worth 1; a wrong one -1 if its answer leads the wrong ones alone, else 0.
    """
    rows = ballots.join(gold, "id")
    n = F.count("*").over(Window.partitionBy("id", "ans"))
    is_gold = F.coalesce(F.col("ans") == F.col("gold"), F.lit(False))
    rows = rows.withColumns({"n": n, "is_gold": is_gold})
    side = valid() & ~F.col("is_gold")
    top = F.max(F.when(side, F.col("n"))).over(by_id())
    rows = rows.withColumns({"top": top, "sets": F.collect_set(F.when(side, F.struct("n", "ans"))).over(by_id())})
    tied = F.size(F.filter("sets", lambda x: x["n"] == F.col("top")))
    credit = F.when(F.col("is_gold"), 1.0).when(side & (F.col("n") == F.col("top")) & (tied == 1), -1.0).otherwise(0.0)
    rows = rows.withColumn("credit", credit)
    sd = F.stddev_pop("credit").over(by_id())
    return rows.select("id", "pos", "credit", F.round(F.when(sd > 1e-12, (F.col("credit") - F.avg("credit").over(by_id())) / sd).otherwise(0.0), 6).alias("advantage"))


def format_reward(texts: DataFrame, answer: Column, gold: Column) -> DataFrame:
    """1 for the gold answer and a tenth for using the answer box."""
    return texts.withColumn("reward", F.when(answer == gold, 1.0).otherwise(0.0) + F.when(F.contains(F.col("text"), F.lit("boxed")), 0.1).otherwise(0.0))


# Token log-probabilities: arrays in the column `tlp`.


def worst_mean(q: float) -> Column:
    """Mean of the lowest share q of the tokens (one at least)."""
    k = F.greatest(F.lit(1), F.floor(F.size("tlp") * q)).cast("int")
    return mean_of(F.slice(F.sort_array("tlp"), F.lit(1), k))


def tail_mean(m: int) -> Column:
    return mean_of(F.slice("tlp", F.greatest(F.lit(1), F.size("tlp") - m + 1), F.lit(m)))


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def window_confidence(a: float, b: float) -> Column:
    """exp of the mean over the tokens from share a to share b, one token at least."""
    i = F.floor(F.size("tlp") * a).cast("int")
    j = F.greatest(F.floor(F.size("tlp") * b).cast("int"), i + 1)
    return F.exp(mean_of(F.slice("tlp", i + 1, j - i)))


def with_tokens(ballots: DataFrame, n: int = 8) -> DataFrame:
    """Ballots with an array of token log-probabilities made from their logp and position."""
    tlp = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("logp") * (1 + ((i * 7 + F.col("pos") * 3 + F.col("len")) % 5) / 4.0))
    return ballots.withColumn("tlp", tlp)


def token_vote(ballots: DataFrame, key: Column, scale: float = 2.0) -> DataFrame:
    rows = ballots.withColumn("key", key)
    rows = rows.withColumn("shift", F.col("key") - F.max(F.when(valid(), F.col("key"))).over(by_id()))
    return elect(rows, F.sum(F.exp(F.col("shift") * scale)), default=None)


def prefix_pick(ballots: DataFrame, p: int) -> DataFrame:
    """The answer of the sample with the most confident first p tokens."""
    mean = rounded(mean_of(F.slice("tlp", 1, p)))
    return ballots.groupBy("id").agg(F.max_by("ans", F.when(valid(), F.struct(mean.alias("m"), (-F.col("pos")).alias("p")))).alias("answer"))


def dynamics_vote(ballots: DataFrame, alpha: float = 0.5, beta: float = 1.0) -> DataFrame:
    """votes**alpha times the mean of confidence plus beta times its rise from the first to the last tenth."""
    rise = window_confidence(0.9, 1.0) - window_confidence(0.0, 0.1)
    rows = ballots.withColumn("c", F.exp(mean_of(F.col("tlp"))) + beta * rise)
    return elect(rows, F.pow(F.count("*"), F.lit(alpha)) * F.avg("c"), default=None)


def half_worst(q: float) -> Column:
    """Half the mean log-probability and half that of the worst share q of the tokens."""
    return 0.5 * F.col("logp") + 0.5 * worst_mean(q)


def token_sweep(ballots: DataFrame, gold: DataFrame, keys: dict[str, Column], scales: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """key, scale, correct: the best scale of each token key (the smallest of equal ones), one tally for all of them."""
    rows = ballots.filter(valid()).withColumn("k", F.explode(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("v")) for n, v in keys.items()]))).select("id", "pos", "ans", "k.*")
    shift = F.col("v") - F.max("v").over(Window.partitionBy("id", "key"))
    tally = rows.withColumn("shift", shift).groupBy("id", "key", "ans").agg(F.min("pos").alias("first"), *[rounded(F.sum(F.exp(F.col("shift") * s))).alias(f"w{i}") for i, s in enumerate(scales)])
    won = tally.groupBy("id", "key").agg(*[F.max_by("ans", F.struct(f"w{i}", -F.col("first"))).alias(f"a{i}") for i in range(len(scales))]).join(gold, "id")
    right = won.groupBy("key").agg(F.array(*[F.struct(F.sum((F.col(f"a{i}") == F.col("gold")).cast("long")).alias("correct"), F.lit(-s).alias("s")) for i, s in enumerate(scales)]).alias("all"))
    best = F.array_max("all")
    return right.select("key", (-best["s"]).alias("scale"), best["correct"].alias("correct"))


def implicit_reward(ballots: DataFrame, policy: Column, reference: Column, tokens: Column) -> DataFrame:
    """The answers of five forms of an implicit reward (log-probability under the policy less that under a reference):
    best and softmax vote by its sum and by its mean over tokens, and the mean's vote times softmax(2 logp)."""
    rows = shifted(ballots).filter(valid()).withColumn("sum_", policy - reference)
    rows = rows.withColumn("mean_", F.col("sum_") / F.greatest(F.lit(1), tokens))
    e = lambda c: F.exp(F.col(c) - F.max(c).over(by_id()))
    rows = rows.withColumns({"es": e("sum_"), "em": e("mean_"), "c": F.exp(F.col("shift") * 2)})
    tally = rows.groupBy("id", "ans").agg(
        F.min("pos").alias("first"), *[F.max(F.struct(rounded(F.col(c)).alias("r"), -F.col("pos"))).alias(k) for c, k in (("sum_", "bs"), ("mean_", "bm"))],
        rounded(F.sum("es")).alias("vs"), rounded(F.sum("em")).alias("vm"), rounded(F.sum(F.col("em") * F.col("c"))).alias("vc"),
    )
    vote = lambda c: F.max_by("ans", F.struct(c, -F.col("first")))
    return tally.groupBy("id").agg(F.max_by("ans", "bs").alias("sum_best"), F.max_by("ans", "bm").alias("mean_best"), vote("vs").alias("sum_vote"), vote("vm").alias("mean_vote"), vote("vc").alias("mean_conf"))


def dynamics_rules(ballots: DataFrame, alpha: float = 0.5, beta: float = 1.0, a: float = 1.0) -> DataFrame:
    """The answers of the confidence-dynamics family: votes**alpha times mean confidence (sqrt_conf), times confidence plus
    beta times its rise (cdg), the last tenth less a times the early part (consilience), and that times votes**alpha."""
    conf, rise = F.exp(mean_of(F.col("tlp"))), window_confidence(0.9, 1.0) - window_confidence(0.0, 0.1)
    rows = ballots.filter(valid()).withColumns({"c_": conf, "g_": conf + beta * rise, "s_": window_confidence(0.9, 1.0) - a * window_confidence(0.05, 0.15)})
    root = F.pow(F.count("*"), F.lit(alpha))
    scores = {"sqrt_conf": root * F.avg("c_"), "cdg": root * F.avg("g_"), "consilience": F.avg("s_"), "consilience_sqrt": root * F.avg("s_")}
    tally = rows.groupBy("id", "ans").agg(F.min("pos").alias("first"), *[rounded(v).alias(k) for k, v in scores.items()])
    return tally.groupBy("id").agg(*[F.max_by("ans", F.struct(k, -F.col("first"))).alias(k) for k in scores])
