"""Selections of problems by their votes, slices, compliance and small score functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.corpus import draw
from votemill.operators.votes import by_id, elect, valid


def mid_difficulty(samples: DataFrame, gold: DataFrame, n: int, seed: str = "11") -> DataFrame:
    """n problems: those with one or two right samples first, then others, each in hash order; no sample counts as 0."""
    right = samples.join(gold, "id").filter("ans = gold").groupBy("id").agg(F.count("*").alias("right"))
    rows = gold.select("id").join(right, "id", "left").select("id", F.coalesce("right", F.lit(0)).alias("right"))
    return rows.withColumn("first", F.col("right").between(1, 2)).orderBy(F.desc("first"), draw(seed, "id"), "id").limit(n)


def recoverable(samples: DataFrame, gold: DataFrame, least: int = 2, n: int = 50) -> DataFrame:
    """The first n problems whose vote is wrong though gold has votes enough, and so has the rest."""
    tally = samples.filter(valid()).join(gold, "id").groupBy("id", "gold", "ans").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    hit = F.col("ans") == F.col("gold")
    per = tally.groupBy("id", "gold").agg(F.max_by("ans", F.struct("n", -F.col("first"))).alias("answer"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("right"), F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("wrong"))
    return per.filter((F.col("answer") != F.col("gold")) & (F.col("right") >= least) & (F.col("wrong") >= least)).orderBy("id").limit(n)


def no_consensus(samples: DataFrame, most: int) -> DataFrame:
    """Problems no answer of which has more than `most` votes."""
    top = samples.groupBy("id", "ans").agg(F.count("*").alias("n")).groupBy("id").agg(F.coalesce(F.max(F.when(valid(), F.col("n"))), F.lit(0)).alias("top"))
    return top.filter(F.col("top") <= most)


def complete_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce("partial", F.lit(False)))


def sliced(rows: DataFrame, offset: int, limit: int, key: str = "id") -> DataFrame:
    """Rows offset..offset+limit in key order: what one of several workers takes."""
    return rows.orderBy(key).offset(offset).limit(limit)


def compliance(ranks: DataFrame, first: Column) -> DataFrame:
    """Shares of ballots with a ranking, with two places or more, and whose first place is not the answer given."""
    size = F.size("ranks")
    return ranks.agg(
        F.count("*").alias("n"), F.round(F.avg((size > 0).cast("int")), 9).alias("ranked"), F.round(F.avg((size >= 2).cast("int")), 9).alias("two_or_more"),
        F.round(F.avg(F.when((size > 0) & first.isNotNull(), (F.get("ranks", F.lit(0)) != first).cast("int"))), 9).alias("contradicts"),
    )


def low_confidence(ballots: DataFrame, cut: float) -> DataFrame:
    """Share of tokens below a cut, and the deviation of their places (as shares of the length)."""
    low = F.filter(F.transform("tlp", lambda x, i: F.when(x < cut, i / F.size("tlp"))), lambda x: x.isNotNull())
    rows = ballots.select("id", "pos", F.size("tlp").alias("n"), low.alias("at"))
    mean = F.aggregate("at", F.lit(0.0), lambda s, x: s + x) / F.size("at")
    spread = F.sqrt(F.aggregate("at", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size("at"))
    return rows.select("id", "pos", F.round(F.size("at") / F.col("n"), 6).alias("share"), F.round(F.when(F.size("at") > 0, spread), 6).alias("spread"))


def capped_subset(kept: DataFrame, take: int, seed: str = "5", key: str = "doc_id") -> DataFrame:
    return kept.orderBy(draw(seed, key), key).limit(take)


def softmax(rows: DataFrame, score: str, scale: float = 1.0) -> DataFrame:
    e = F.exp((F.col(score) - F.max(score).over(by_id())) * scale)
    return rows.withColumn("e_", e).withColumn("p", F.col("e_") / F.sum("e_").over(by_id())).drop("e_")


def judge_vote(letters: DataFrame) -> DataFrame:
    """A or B by the judges' first letters; A wins ties."""
    up = F.upper(F.ltrim("letter"))
    return letters.groupBy("id").agg(F.when(F.sum(F.startswith(up, F.lit("B")).cast("int")) > F.sum(F.startswith(up, F.lit("A")).cast("int")), "B").otherwise("A").alias("winner"))


def contrastive(rows: DataFrame, lam: float = 0.5, alpha: float = 0.1) -> DataFrame:
    """(1 + lam) base - lam amateur for each candidate whose base probability is at least alpha of the best; null for others."""
    best = F.max("base").over(by_id())
    return rows.withColumn("score", F.when(F.exp("base") >= alpha * F.exp(best), (1 + lam) * F.col("base") - lam * F.col("amateur")))


def log_softmax(x: Column) -> Column:
    top = F.max(x).over(by_id())
    return x - top - F.log(F.sum(F.exp(x - top)).over(by_id()))


def nucleus(given: DataFrame, free: DataFrame, omega: float = 1.5, tau: float = 1.5, temperature: float = 0.7, top_p: float = 0.8, floor: float = -30.0) -> DataFrame:
    """id, token, mixed and p of the tokens that stay of two weighted lists (id, token, x), one with and one without the condition.

    The lists are aligned by token (one that a list lacks has weight `floor` there). Where the conditional distribution's entropy is
    above tau, scores are (1 - omega) free + omega given, else given. Tokens stay in order of probability until those before them
    hold more than top_p; p adds up to 1 over those that stay. Equal probabilities go by token.
    """
    both = given.select("id", "token", F.col("x").alias("g")).join(free.select("id", "token", F.col("x").alias("f")), ["id", "token"], "full")
    rows = both.select("id", "token", log_softmax(F.coalesce("g", F.lit(floor))).alias("g"), log_softmax(F.coalesce("f", F.lit(floor))).alias("f"))
    rows = rows.withColumn("mixed", F.round(-F.sum(F.exp("g") * F.col("g")).over(by_id()), 9) > tau)
    score = F.when(F.col("mixed"), (1 - omega) * F.col("f") + omega * F.col("g")).otherwise(F.col("g")) / temperature
    rows = rows.withColumn("p", F.round(F.exp(log_softmax(score)), 12))
    before = F.sum("p").over(by_id().orderBy(F.desc("p"), "token").rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
    kept = rows.withColumn("before_", before).filter(F.round("before_", 9) <= top_p)
    return kept.select("id", "token", "mixed", (F.col("p") / F.sum("p").over(by_id())).alias("p"))


def entropy(rows: DataFrame, p: str = "p") -> DataFrame:
    return rows.groupBy("id").agg(F.round(-F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(p)).otherwise(0.0)), 6).alias("entropy"))


def router(ballots: DataFrame, gold: DataFrame, base: str, other: str) -> DataFrame:
    """Leave one seed out: categories in which the other system gains on the remaining seeds go to it on that seed."""
    won = elect(ballots, F.count("*"), keys=("id", "seed", "system")).join(gold, "id")
    ok = (F.col("answer") == F.col("gold")).cast("long")
    both = won.groupBy("seed", "category", "id").agg(F.max(F.when(F.col("system") == base, ok)).alias("x"), F.max(F.when(F.col("system") == other, ok)).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    cells = both.groupBy("seed", "category").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    net = F.sum(F.col("y") - F.col("x")).over(Window.partitionBy("category")) - (F.col("y") - F.col("x"))
    routed = cells.withColumn("take", net > 0)
    return routed.groupBy("seed").agg(F.sum("n").alias("n"), F.sum("x").alias("base"), F.sum(F.when(F.col("take"), F.col("y")).otherwise(F.col("x"))).alias("routed"), F.sum(F.col("take").cast("long")).alias("cells"))
