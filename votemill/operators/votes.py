"""Vote aggregation: rules that turn the sampled answers of a problem into one answer.

A rule is a mask (which ballots count, and in what order ties resolve) followed by an election. Masks set `ans` to
null where a ballot does not count and may replace `pos`, so problems without any valid ballot stay in the result
with the default answer. Everything of one problem is computed after a single exchange on `id`: windows, the
tally by (id, ans) and the election all accept that partitioning.

Answers are canonical integer texts, so that they may have any number of digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_id():
    return Window.partitionBy("id")

INT64_MAX = "9223372036854775807"


def rounded(score: Column) -> Column:
    """Sums of floats differ in their last bits with the order of rows; ties are taken at nine digits."""
    return F.round(score.cast("double"), 9)


def valid() -> Column:
    return F.col("ans").isNotNull()


def elect(ballots: DataFrame, *scores: Column, default: str | None = "0", keys: tuple[str, ...] = ("id",), carry: dict[str, Column] | None = None) -> DataFrame:
    """The answer with the highest scores (aggregates over its ballots); ties go to the answer seen first."""
    named = [s.alias(f"s{i}") for i, s in enumerate(scores)]
    tally = ballots.groupBy(*keys, "ans").agg(F.min("pos").alias("first"), *named)
    order = F.when(valid(), F.struct(*[rounded(F.col(f"s{i}")).alias(f"s{i}") for i in range(len(scores))], (-F.col("first")).alias("f")))
    answer = F.max_by("ans", order)
    extra = [c.alias(k) for k, c in (carry or {}).items()]
    return tally.groupBy(*keys).agg((F.coalesce(answer, F.lit(default)) if default is not None else answer).alias("answer"), *extra)


def count() -> Column:
    return F.count("*")


def weight(scale: float = 2.0) -> Column:
    """Sum of exp(scale * (logp - the problem's highest logp)), to be used after shifted()."""
    return F.sum(F.exp(F.col("shift") * scale))


def shifted(ballots: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return ballots.withColumn("shift", F.col("logp") - F.max(F.when(valid(), F.col("logp"))).over(Window.partitionBy(*keys)))


def masked(ballots: DataFrame, keep: Column) -> DataFrame:
    return ballots.withColumn("ans", F.when(keep, F.col("ans")))


def prefix(ballots: DataFrame, n: int) -> DataFrame:
    return ballots.filter(F.col("pos") < n)


def drop_truncated(ballots: DataFrame) -> DataFrame:
    """Without truncated samples, unless all are."""
    return masked(ballots, ~F.col("trunc") | ~F.max(~F.col("trunc")).over(by_id()))


def drop_truncated_answered(ballots: DataFrame) -> DataFrame:
    """Without truncated samples, unless no other has an answer."""
    return masked(ballots, ~F.col("trunc") | ~F.coalesce(F.max(~F.col("trunc") & valid()).over(by_id()), F.lit(False)))


def digits(ans: Column) -> Column:
    return F.length(F.regexp_replace(ans, "^-?0*", ""))


def fits_int64(ans: Column) -> Column:
    """Whether |ans| is at most 2**63 - 1, by digits, so that longer numbers do not overflow."""
    return fits_within(ans, INT64_MAX)


def fits_within(ans: Column, most: str) -> Column:
    """Whether |ans| is at most `most`, by digits."""
    bare = F.regexp_replace(ans, "^-?0*", "")
    return (F.length(bare) < len(most)) | ((F.length(bare) == len(most)) & (bare <= most))


def plausible_only(ballots: DataFrame) -> DataFrame:
    """Without answers above 10**12 in absolute value, unless that leaves none."""
    fine = fits_within(F.col("ans"), "1000000000000")
    return masked(ballots, fine | ~F.coalesce(F.max(F.when(valid(), fine)).over(by_id()), F.lit(False)))


def trim_lowconf(ballots: DataFrame, frac: float = 0.25, least: int = 2, floor: int = 4) -> DataFrame:
    """The most confident share of at least `floor` valid ballots, which then count in order of confidence."""
    n = F.count("ans").over(by_id())
    rank = F.row_number().over(by_id().orderBy(F.col("ans").isNull(), F.desc("logp"), "pos"))
    marked = ballots.withColumns({"n_": n, "r_": rank})
    trimmed = F.col("n_") >= floor
    keep = ~trimmed | (F.col("r_") <= F.greatest(F.lit(least), F.floor(F.col("n_") * (1 - frac))))
    return masked(marked, keep).withColumn("pos", F.when(trimmed, F.col("r_")).otherwise(F.col("pos"))).drop("n_", "r_")


def lengths() -> Column:
    return F.sort_array(F.collect_list(F.when(valid(), F.col("len"))).over(by_id()))


def length_trim(ballots: DataFrame, low: int = 10, high: int = 90) -> DataFrame:
    """Ballots within two index percentiles of length; all of them if fewer than 4, or if fewer than 2 are left."""
    marked = ballots.withColumn("l_", lengths()).withColumn("n_", F.size("l_"))
    at = lambda p: F.element_at("l_", F.greatest(F.lit(1), F.least(F.floor(F.col("n_") * p / 100), F.col("n_") - 1).cast("int") + 1))
    inside = F.when(F.col("n_") > 0, F.col("len").between(at(low), at(high))).otherwise(False)
    marked = marked.withColumn("in_", inside)
    kept = F.sum((F.col("in_") & valid()).cast("int")).over(by_id())
    return masked(marked.withColumn("k_", kept), F.col("in_") | (F.col("n_") < 4) | (F.col("k_") < 2)).drop("l_", "n_", "in_", "k_")


def len_trim(ballots: DataFrame, share: float = 0.2) -> DataFrame:
    """Without the shortest share of five ballots or more."""
    marked = ballots.withColumn("l_", lengths()).withColumn("n_", F.size("l_"))
    cut = F.when(F.col("n_") >= 5, F.element_at("l_", F.floor(F.col("n_") * share).cast("int"))).otherwise(0)
    return masked(marked, F.col("len") >= cut).drop("l_", "n_")


def short_half(ballots: DataFrame) -> DataFrame:
    rank = F.row_number().over(by_id().orderBy(F.col("ans").isNull(), "len", "pos"))
    marked = ballots.withColumns({"n_": F.count("ans").over(by_id()), "r_": rank})
    return masked(marked, F.col("r_") <= F.greatest(F.lit(1), F.floor(F.col("n_") / 2))).withColumn("pos", F.col("r_")).drop("n_", "r_")


def majority(ballots: DataFrame, default: str | None = "0") -> DataFrame:
    return elect(ballots, count(), default=default)


def weighted(ballots: DataFrame, scale: float = 2.0, default: str | None = "0", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return elect(shifted(ballots, keys), weight(scale), default=default, keys=keys)


def prefer_short(ballots: DataFrame) -> DataFrame:
    return elect(ballots, count(), -F.avg("len"))


def tiebreak_conf(ballots: DataFrame) -> DataFrame:
    return elect(ballots, count(), F.max("logp"))


def first_finish(ballots: DataFrame) -> DataFrame:
    """The answer of the shortest complete sample, null included; of the shortest one if all are truncated."""
    return ballots.groupBy("id").agg(F.min_by("ans", F.struct("trunc", "len", "pos")).alias("answer"))


def trim_fallback(ballots: DataFrame, min_votes: int = 3) -> DataFrame:
    """The trimmed winner, or the plain one if fewer than min_votes agree on it."""
    both = trim_lowconf(ballots.withColumns({"all_": F.col("ans"), "at_": F.col("pos")}))
    full = both.filter("all_ IS NOT NULL").groupBy("id", "all_").agg(
        F.count("*").alias("n"), F.min("at_").alias("first"), F.count("ans").alias("k"), F.min(F.when(valid(), F.col("pos"))).alias("k_first")
    )
    plain = F.max_by("all_", F.struct("n", -F.col("first")))
    trimmed = F.max_by("all_", F.when(F.col("k") > 0, F.struct("k", -F.col("k_first"))))
    got = full.groupBy("id").agg(F.when((F.max("k") < min_votes), plain).otherwise(trimmed).alias("answer"))
    return ballots.select("id").distinct().join(got, "id", "left").select("id", F.coalesce("answer", F.lit("0")).alias("answer"))


def conditional(ballots: DataFrame, thresh: int = 1, scale: float = 2.0) -> DataFrame:
    """Majority where it leads by more than thresh votes (99 for a single answer), else the weighted vote."""
    tally = shifted(ballots).filter(valid()).groupBy("id", "ans").agg(F.min("pos").alias("first"), count().alias("n"), rounded(weight(scale)).alias("w"))
    top = F.sort_array(F.collect_list("n"), False)
    gap = F.when(F.size(top) < 2, 99).otherwise(top[0] - F.try_element_at(top, F.lit(2)))
    plain, heavy = F.max_by("ans", F.struct("n", -F.col("first"))), F.max_by("ans", F.struct("w", -F.col("first")))
    return tally.groupBy("id").agg(gap.cast("long").alias("margin"), F.when(gap > thresh, plain).otherwise(heavy).alias("answer"))


def int64_safe(ballots: DataFrame) -> DataFrame:
    """The majority answer, or the majority of those that fit 64 bits if it does not; with the reason."""
    tally = ballots.groupBy("id", "ans").agg(F.min("pos").alias("first"), count().alias("n"))
    order = F.struct("n", -F.col("first"))
    got = tally.groupBy("id").agg(F.max_by("ans", F.when(valid(), order)).alias("a"), F.max_by("ans", F.when(valid() & fits_int64(F.col("ans")), order)).alias("s"))
    fine = F.col("a").isNull() | fits_int64(F.col("a"))
    reason = F.when(fine, "none").when(F.col("s").isNull(), "all_oversized").otherwise(F.concat(F.lit("oversized_"), digits(F.col("a")).cast("string"), F.lit("d")))
    return got.select("id", F.coalesce(F.when(fine, F.col("a")).otherwise(F.col("s")), F.lit("0")).alias("answer"), reason.alias("reason"))


def plausibility(mode: str, k: float) -> Column:
    size = F.abs(F.col("ans").cast("double"))
    if mode == "log":
        return 1 / (1 + F.log10(1 + size) / k)
    if mode == "digits":
        d = F.greatest(F.lit(1), digits(F.col("ans")))
        return F.when(d <= k, 1.0).otherwise(F.pow(F.lit(0.5), d - k))
    if mode == "hardcap":
        return F.when(size <= 10**k, 1.0).otherwise(0.05)
    return F.lit(1.0)


def answer_prior(ballots: DataFrame, mode: str = "log", k: float = 3.0, zero_pen: float = 0.5, scale: float = 2.0) -> DataFrame:
    """Confidence weights times the plausibility of the answer's size."""
    p = plausibility(mode, k) * F.when(F.col("ans") == "0", zero_pen).otherwise(1.0)
    return elect(shifted(ballots), F.sum(F.exp(F.col("shift") * scale) * p), default=None)


def sharpened(ballots: DataFrame, power: float = 3.0) -> DataFrame:
    """Weights raised to a power: the winner, its share and its margin over the second."""
    tally = shifted(ballots).filter(valid()).groupBy("id", "ans").agg(F.min("pos").alias("first"), F.sum(F.pow(F.exp("shift"), F.lit(power))).alias("w"))
    share = tally.withColumn("share", F.col("w") / F.sum("w").over(by_id()))
    rank = F.row_number().over(by_id().orderBy(F.desc(rounded(F.col("share"))), "first"))
    share = share.withColumn("r", rank).filter("r <= 2")
    one = F.max(F.when(F.col("r") == 1, F.col("share")))
    two = F.coalesce(F.max(F.when(F.col("r") == 2, F.col("share"))), F.lit(0.0))
    return share.groupBy("id").agg(F.max(F.when(F.col("r") == 1, F.col("ans"))).alias("answer"), F.round(one, 6).alias("share"), F.round(one - two, 6).alias("margin"))


def score_vote(ballots: DataFrame, score: str = "score") -> DataFrame:
    """A scorer's weighted vote and its single best sample, each with the majority as fallback."""
    n = F.when(valid(), F.col(score))
    best = ballots.groupBy("id").agg(F.max_by("ans", F.when(valid(), F.struct(n, -F.col("pos")))).alias("best_of_1"))
    voted = elect(ballots, F.sum(score)).withColumnRenamed("answer", "score_weighted")
    return voted.join(best, "id").join(majority(ballots).withColumnRenamed("answer", "m"), "id").select("id", "score_weighted", F.coalesce("best_of_1", "m").alias("best_of_1"))


def verdict_vote(ballots: DataFrame, yes: Column) -> DataFrame:
    """By approvals alone (majority where nothing is approved), and by votes plus approvals."""
    k = F.sum(yes.cast("int"))
    tally = ballots.filter(valid()).groupBy("id", "ans").agg(F.min("pos").alias("first"), count().alias("n"), k.alias("k"))
    plain = F.max_by("ans", F.struct("n", -F.col("first")))
    approved = F.max_by("ans", F.struct("k", -F.col("first")))
    both = F.max_by("ans", F.struct(F.col("n") + F.col("k"), -F.col("first")))
    return tally.groupBy("id").agg(F.when(F.max("k") > 0, approved).otherwise(plain).alias("verdict"), both.alias("hybrid"))


def reward_vote(ballots: DataFrame, score: str = "score") -> DataFrame:
    """Best single reward, softmax(reward) vote, and softmax(reward) * softmax(2 logp) vote."""
    rows = shifted(ballots).filter(valid())
    rows = rows.withColumn("e", F.exp(F.col(score) - F.max(score).over(by_id()))).withColumn("c", F.exp(F.col("shift") * 2))
    rows = rows.withColumns({"e": F.col("e") / F.sum("e").over(by_id()), "c": F.col("c") / F.sum("c").over(by_id())})
    tally = rows.groupBy("id", "ans").agg(F.min("pos").alias("first"), F.max(F.struct(score, -F.col("pos"))).alias("b"), rounded(F.sum("e")).alias("v"), rounded(F.sum(F.col("e") * F.col("c"))).alias("p"))
    pick = lambda c: F.max_by("ans", F.struct(c, -F.col("first")))
    return tally.groupBy("id").agg(F.max_by("ans", "b").alias("rm_best"), pick("v").alias("rm_vote"), pick("p").alias("rm_conf_vote"))


def best_representative(ballots: DataFrame) -> DataFrame:
    """Of each answer the position of its most confident sample."""
    return ballots.filter(valid()).groupBy("id", "ans").agg(F.max_by("pos", F.struct("logp", -F.col("pos"))).alias("best_pos"))


def tournament(ballots: DataFrame, judged_a: Column, margin: int = 1) -> DataFrame:
    """Where the two leaders are at most margin apart, a judge's votes (A wins ties) decide; else the majority stays."""
    tally = ballots.filter(valid()).groupBy("id", "ans").agg(F.min("pos").alias("first"), count().alias("n"))
    ranked = tally.withColumn("r", F.row_number().over(by_id().orderBy(F.desc("n"), "first"))).filter("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    top = ranked.groupBy("id").agg(pick(1, "ans").alias("a"), pick(2, "ans").alias("b"), (pick(1, "n") - pick(2, "n")).alias("gap"))
    judge = ballots.groupBy("id").agg(F.sum(judged_a.cast("int")).alias("va"), count().alias("vn"))
    contested = F.col("b").isNotNull() & (F.col("gap") <= margin)
    wins_b = contested & (2 * F.col("va") < F.col("vn"))
    return top.join(judge, "id").select("id", contested.alias("contested"), F.when(wins_b, F.col("b")).otherwise(F.col("a")).alias("answer"))


def mix(a: DataFrame, b: DataFrame, k_a: int, k_b: int) -> DataFrame:
    """The first k_a ballots of one policy and the first k_b of another, renumbered in that order."""
    both = prefix(a, k_a).withColumn("src", F.lit(0)).unionByName(prefix(b, k_b).withColumn("src", F.lit(1)))
    return both.withColumn("pos", F.row_number().over(by_id().orderBy("src", "pos")) - 1)


def merge(parts: list[DataFrame]) -> DataFrame:
    """All ballots of several dumps, renumbered by dump and position."""
    both = reduce(DataFrame.unionByName, [p.withColumn("src", F.lit(i)) for i, p in enumerate(parts)])
    return both.withColumn("pos", F.row_number().over(by_id().orderBy("src", "pos")) - 1)


def adaptive(ballots: DataFrame, n: int = 2, enough: int = 1, more: int = 4) -> DataFrame:
    """Majority of the first n ballots; where no answer has more than `enough` votes, of `more` further ones too."""
    marked = ballots.withColumn("in_", F.col("pos") < n)
    tally = marked.filter(valid() & (F.col("pos") < n + more)).groupBy("id", "ans").agg(F.min("pos").alias("first"), F.sum(F.col("in_").cast("int")).alias("k"), count().alias("n"))
    order = lambda c: F.max_by("ans", F.when(F.col(c) > 0, F.struct(c, -F.col("first"))))
    settled = F.max("k") > enough
    votes = ballots.groupBy("id").agg(F.least(count(), F.lit(n)).alias("short"), F.least(count(), F.lit(n + more)).alias("long"))
    got = tally.groupBy("id").agg(settled.alias("settled"), F.when(settled, order("k")).otherwise(order("n")).alias("answer"))
    cost = F.when(F.coalesce("settled", F.lit(False)), F.col("short")).otherwise(F.col("long"))
    return votes.join(got, "id", "left").select("id", F.coalesce("answer", F.lit("0")).alias("answer"), cost.cast("long").alias("votes"))


def ranked_ballots(ballots: DataFrame) -> DataFrame:
    """Each ballot's ranking of up to three distinct answers: its own, then its others."""
    r = F.array_distinct(F.array("ans", F.col("other").cast("string"), ((F.col("other") + 1) % 5).cast("string")))
    return ballots.filter(valid()).withColumn("rank", F.slice(r, 1, 3))


def ranked_vote(ballots: DataFrame, scheme: str, confident: bool = False) -> DataFrame:
    """First places, Borda (K - i points for place i of K) or reciprocal ranks (1 / (i + 1)); each may be weighted by confidence."""
    rows = shifted(ballots).select("id", "pos", "shift", F.size("rank").alias("k"), F.posexplode("rank").alias("i", "ans"))
    points = {"top1": (F.col("i") == 0).cast("double"), "borda": F.col("k") - F.col("i"), "mrr": 1 / (F.col("i") + 1)}[scheme]
    if scheme == "top1":
        rows = rows.filter("i = 0")
    rows = rows.withColumn("pos", F.col("pos") * 10 + F.col("i"))
    return elect(rows, F.sum(points * F.exp(F.col("shift") * 2) if confident else points), default=None)


def runoff(ranks: list[list[str]]) -> str | None:
    """The winner of one problem's rankings, in the order of its ballots."""
    live = list(dict.fromkeys(a for r in ranks for a in r))
    while live:
        first = {a: 0 for a in live}
        for r in ranks:
            top = next((a for a in r if a in first), None)
            if top is not None:
                first[top] += 1
        best = max(live, key=first.get)
        if len(live) == 1 or 2 * first[best] > sum(first.values()):
            return best
        live.remove(max(live, key=lambda a: (-first[a], int(a))))
    return None


def instant_runoff(ballots: DataFrame) -> DataFrame:
    """The answer with the fewest first choices leaves (of equal ones the numerically largest) until one has a majority.

    Rounds depend on each other, so they run in Python, on the rankings of one problem at a time and many a batch.
    """
    @F.pandas_udf("string")
    def winner(votes: pd.Series) -> pd.Series:
        return pd.Series([runoff([list(x["rank"]) for x in v]) for v in votes])

    packed = ballots.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("votes"))  # a problem's samples
    return packed.select("id", winner("votes").alias("answer"))


def cohesion_vote(vectors: DataFrame, gamma: float) -> DataFrame:
    """sqrt(n) * w**gamma by answer, w the mean clipped cosine of its members' pairs (0.9 for a single one).

    vectors: id, ans, pos, v (normalised). The mean over pairs comes from sums of squares only when no cosine is
    negative, so pairs are formed, within an answer of one problem.
    """
    a, b = vectors.alias("a"), vectors.alias("b")
    dot = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    on = (F.col("a.id") == F.col("b.id")) & (F.col("a.ans") == F.col("b.ans")) & (F.col("a.pos") < F.col("b.pos"))
    pairs = a.join(b, on).groupBy(F.col("a.id").alias("id"), F.col("a.ans").alias("ans")).agg(F.avg(F.greatest(F.lit(0.0), dot)).alias("w"))
    tally = vectors.groupBy("id", "ans").agg(count().alias("n"), F.min("pos").alias("first")).join(pairs, ["id", "ans"], "left")
    score = F.sqrt("n") * F.pow(F.coalesce("w", F.lit(0.9)), F.lit(gamma))
    return tally.groupBy("id").agg(F.max_by("ans", F.struct(F.round(score, 6), -F.col("first"))).alias("answer"))


Rule = Callable[[DataFrame], DataFrame]
#: Rules by name: frame of ballots in, (id, answer) out. Callers may add their own.
RULES: dict[str, Rule] = {
    "majority": majority,
    "weighted2": weighted,
    "weighted1": lambda b: weighted(b, 1.0),
    "weighted4": lambda b: weighted(b, 4.0),
    "drop_trunc": lambda b: majority(drop_truncated(b)),
    "drop_trunc_weighted": lambda b: weighted(drop_truncated(b)),
    "plausible": lambda b: majority(plausible_only(b)),
    "len_trim20": lambda b: majority(len_trim(b)),
    "short_half": lambda b: weighted(short_half(b)),
    "prefer_short": prefer_short,
    "tiebreak_conf": tiebreak_conf,
}
RULES |= {f"trim{p}": lambda b, p=p: majority(trim_lowconf(b, p / 100)) for p in (10, 20, 25, 30, 40, 50)}
RULES |= {f"trim{p}_weighted": lambda b, p=p: weighted(trim_lowconf(b, p / 100)) for p in (10, 20, 25, 30, 40, 50)}
RULES |= {f"trunc_trim{p}": lambda b, p=p: majority(trim_lowconf(drop_truncated(b), p / 100)) for p in (10, 25, 40)}
RULES |= {name: lambda b, x=x: majority(length_trim(b, *x)) for name, x in (("length_trim", (10, 90)), ("length_trim_5_95", (5, 95)), ("length_trim_20_80", (20, 80)))}
RULES |= {name: lambda b, x=x: trim_fallback(b, x) for name, x in (("trim_fallback2", 2), ("trim_fallback", 3), ("trim_fallback4", 4))}
