"""Systems compared on the same problems: rescue and harm, oracles, wrong-answer agreement, families, specialists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.sweeps import answers
from votemill.operators.votes import by_id, elect


def flag(c: Column) -> Column:
    return F.sum(c.cast("long"))


def answers_by_system(ballots: DataFrame, gold: DataFrame, system: str = "system") -> DataFrame:
    """id, system, answer, gold, ok: each system's majority on the problems that it has ballots for."""
    won = elect(ballots.withColumnRenamed(system, "sys"), F.count("*"), keys=("id", "sys"))
    return won.join(gold, "id").select("id", F.col("sys").alias("system"), "answer", "gold", "category", (F.col("answer") == F.col("gold")).alias("ok"))


def covered(answers: DataFrame, least: int) -> DataFrame:
    """Only systems with enough problems, and only problems that all of these have.

    Problems are told by a window over the answers of each, so that one sort does what joins of the table with itself did.
    """
    kept = answers.groupBy("system").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("system")
    n = kept.agg(F.count("*").alias("k_"))
    own = answers.join(small_cells(kept.join(F.broadcast(n))), "system").select(*answers.columns, "k_")
    return own.withColumn("c_", F.size(F.collect_set("system").over(by_id()))).filter("c_ = k_ AND id IS NOT NULL").drop("c_", "k_")


def with_base(answers: DataFrame, base: str) -> DataFrame:
    """answers (a row a problem and system) with b_answer and b_ok, the base's on the same problem; only problems that the base has."""
    of_base = F.max(F.when(F.col("system") == base, F.struct("answer", "ok"))).over(by_id())
    return answers.withColumn("b_", of_base).filter("b_ IS NOT NULL AND id IS NOT NULL").select(*answers.columns, F.col("b_.answer").alias("b_answer"), F.col("b_.ok").alias("b_ok"))


def rescue_harm(answers: DataFrame, base: str) -> DataFrame:
    """Against a base system: problems that only the other solves, that only the base solves, and different answers."""
    both = with_base(answers, base).filter(F.col("system") != base)
    return both.groupBy("system").agg(
        F.count("*").alias("n"), flag(F.col("ok") & ~F.col("b_ok")).alias("rescued"), flag(~F.col("ok") & F.col("b_ok")).alias("harmed"), flag(F.col("answer") != F.col("b_answer")).alias("differing")
    )


def union_oracle(answers: DataFrame) -> DataFrame:
    per = answers.groupBy("id").agg(F.max("ok").alias("any"), F.min("ok").alias("every"))
    return per.agg(F.count("*").alias("n"), flag(F.col("any")).alias("any_right"), flag(F.col("every")).alias("all_right"))


def greedy_cover(answers: DataFrame, steps: int = 6) -> DataFrame:
    """step, system, gain: each step takes the system that solves most problems not solved yet (ties: the larger name).

    One aggregate counts problems by the set of systems that solve them; each step then reads only these counts, of
    which there are as many as different sets.
    """
    spark = answers.sparkSession
    solved = answers.filter("ok").groupBy("id").agg(F.array_sort(F.collect_set("system")).alias("systems"))  # a problem's systems
    sets = solved.groupBy("systems").agg(F.count("*").alias("n")).persist()
    out: list[tuple[int, str, int]] = []
    for step in range(1, steps + 1):
        left = sets.filter(~F.arrays_overlap("systems", F.array(*[F.lit(s) for _, s, _ in out]))) if out else sets
        best = left.select(F.explode("systems").alias("system"), "n").groupBy("system").agg(F.sum("n").alias("gain")).orderBy(F.desc("gain"), F.desc("system")).first()
        if best is None:
            break
        out.append((step, best["system"], best["gain"]))
    sets.unpersist()
    return spark.createDataFrame(out, "step int, system string, gain long")


def wrong_agreement(answers: DataFrame) -> DataFrame:
    """For every ordered pair of systems: problems both fail, and the share on which they give the same wrong answer.

    Pairs are of systems on one problem, of which there are few.
    """
    wrong = answers.filter(~F.col("ok")).select("id", "system", "answer")
    a, b = wrong.toDF("id", "a", "x"), wrong.toDF("id", "b", "y")
    return a.join(b, "id").filter("a != b").groupBy("a", "b").agg(F.count("*").alias("both_wrong"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 9).alias("same"))


def pair_scores(answers: DataFrame, base: str, contrast: float = 0.08) -> DataFrame:
    """How well each system contrasts with the base: agreement in error less twice the share of its rescues."""
    both = with_base(answers, base).filter(F.col("system") != base)
    wrong = ~F.col("ok") & ~F.col("b_ok")
    wa = F.sum((wrong & (F.col("answer") == F.col("b_answer"))).cast("double")) / F.sum(wrong.cast("double"))
    rr = F.avg((F.col("ok") & ~F.col("b_ok")).cast("int"))
    gap = F.avg(F.col("b_ok").cast("int")) - F.avg(F.col("ok").cast("int"))
    return both.groupBy("system").agg(F.round(wa, 6).alias("wrong_same"), F.round(rr, 6).alias("rescue_rate"), F.round(wa - 2 * rr, 6).alias("score"), (gap >= contrast).alias("contrasts"))


def family_vote(ballots: DataFrame, gold: DataFrame, family: str, k: int = 5) -> DataFrame:
    """Families pool their ballots to one answer with its weighted share; families then vote, one column a weighting.

    equal: 1 each; reliable: accuracy on the other folds; odds: its log-odds, 0 at least; diverse: accuracy times one
    less the mean agreement with the other families; confident: accuracy times the family's share.
    """
    keys = Window.partitionBy("id", "fam")
    rows = ballots.withColumn("fam", F.col(family)).filter("ans IS NOT NULL")
    rows = rows.withColumn("w", F.exp((F.col("logp") - F.max("logp").over(keys)) * 2))
    tally = rows.groupBy("id", "fam", "ans").agg(F.min("pos").alias("first"), F.round(F.sum("w"), 9).alias("w"))
    pooled = tally.groupBy("id", "fam").agg(F.max_by("ans", F.struct("w", -F.col("first"))).alias("ans"), (F.max("w") / F.sum("w")).alias("share"))
    pooled = pooled.join(gold, "id").withColumns({"ok": (F.col("ans") == F.col("gold")).cast("int"), "fold": (F.col("id") % k).cast("int")})
    cells = pooled.groupBy("fam", "fold").agg(F.sum("ok").alias("c"), F.count("*").alias("n"))
    every = Window.partitionBy("fam")
    rel = (F.sum("c").over(every) - F.col("c")) / F.nullif(F.sum("n").over(every) - F.col("n"), F.lit(0))
    cells = cells.select("fam", "fold", F.coalesce(rel, F.lit(0.0)).alias("rel")).join(diversity(pooled), "fam", "left")
    weights = small_cells(cells)
    pooled = pooled.join(weights, ["fam", "fold"])
    pooled = pooled.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("fam")))
    p = F.least(F.greatest(F.col("rel"), F.lit(1e-3)), F.lit(1 - 1e-3))
    scores = {
        "equal": F.lit(1.0),
        "reliable": F.col("rel"),
        "odds": F.greatest(F.log(p / (1 - p)), F.lit(0.0)),
        "diverse": F.col("rel") * F.coalesce("diversity", F.lit(1.0)),
        "confident": F.col("rel") * F.col("share"),
    }
    votes = pooled.groupBy("id", "ans").agg(F.min("pos").alias("first"), *[F.round(F.sum(v), 9).alias(c) for c, v in scores.items()])
    return votes.groupBy("id").agg(*[F.max_by("ans", F.struct(c, -F.col("first"))).alias(c) for c in scores])


def small_cells(cells: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast if counted to be few."""
    return F.broadcast(cells) if cells.limit(most + 1).count() <= most else cells


def diversity(pooled: DataFrame) -> DataFrame:
    """fam, diversity: one less the mean, over other families, of the correlation of being right on common problems.

    Pairs are of families on one problem, of which there are few.
    """
    a, b = pooled.select("id", F.col("fam").alias("fam"), F.col("ok").alias("x")), pooled.select("id", F.col("fam").alias("other"), F.col("ok").alias("y"))
    pairs = a.join(b, "id").filter("fam != other").groupBy("fam", "other").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for c, k in ((F.col("x"), "sx"), (F.col("y"), "sy"), (F.col("x") * F.col("y"), "sxy"))])
    spread = F.sqrt((F.col("n") * F.col("sx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("sy") - F.col("sy") * F.col("sy")).cast("double"))
    corr = F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
    return pairs.groupBy("fam").agg((1 - F.avg(corr)).alias("diversity"))


def specialists(answers: DataFrame, base: str, least: int = 15, splits: int = 3) -> DataFrame:
    """Per category and system: size, net gain over the base, net gain a problem against that of the rest, and whether the
    net gains of all `splits` parts of the problems (by id) have the sign of the whole."""
    net = (F.col("ok").cast("int") - F.col("b_ok").cast("int")).cast("long")
    parts = with_base(answers, base).filter(F.col("system") != base).groupBy("category", "system", (F.col("id") % splits).alias("part")).agg(F.count("*").alias("n"), F.sum(net).alias("net"))
    sides = F.min(F.signum("net")).alias("low"), F.max(F.signum("net")).alias("high")
    cells = parts.groupBy("category", "system").agg(F.sum("n").alias("n"), F.sum("net").alias("net"), *sides)
    cells = cells.withColumn("agree", (F.col("low") == F.col("high")) & (F.col("low") == F.signum("net")) & (F.col("net") != 0)).drop("low", "high")
    w = Window.partitionBy("system")
    rest = (F.sum("net").over(w) - F.col("net")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0))
    return cells.withColumn("diff", F.round(F.col("net") / F.col("n") - F.coalesce(rest, F.lit(0.0)), 6)).filter(F.col("n") >= least)


def mcnemar(answers: DataFrame, a: str, b: str) -> DataFrame:
    """Problems only a solves, only b solves, their difference, the corrected z and the smallest detectable difference."""
    both = with_base(answers, b).filter(F.col("system") == a)
    got = both.agg(flag(F.col("ok") & ~F.col("b_ok")).alias("b"), flag(~F.col("ok") & F.col("b_ok")).alias("c"))
    n, d = F.col("b") + F.col("c"), F.col("b") - F.col("c")
    return got.select("b", "c", d.alias("diff"), F.round(F.when(n > 0, (F.abs(d) - 1) / F.sqrt(n)), 6).alias("z"), F.round(1.96 * F.sqrt(n) + 1, 6).alias("mdd"))


def mcnemar_p(z: float | None) -> float | None:
    """The two-sided p-value of a corrected z."""
    import math

    return None if z is None else math.erfc(max(0.0, z) / math.sqrt(2))


def paired_seed_gate(ballots: DataFrame, gold: DataFrame, rule: str, base_rule: str, least: float = 3.0) -> DataFrame:
    """Per seed the right answers of two named rules; accepted if the new one gains on every seed and by `least` on average."""
    won = answers(ballots, (rule, base_rule), ("seed", "id")).join(gold, "id")
    right = lambda r: flag((F.col("rule") == r) & (F.col("answer") == F.col("gold")))
    both = won.groupBy("seed").agg(right(base_rule).alias("base"), right(rule).alias("new")).withColumn("gain", F.col("new") - F.col("base"))
    w = Window.partitionBy()  # a row a seed
    return both.select("seed", "base", "new", "gain", ((F.min("gain").over(w) > 0) & (F.avg("gain").over(w) >= least)).alias("accepted"))


def corrected(answers: DataFrame, key: DataFrame, gate: int) -> DataFrame:
    """Rescored under a corrected key (id, truth): its truth replaces gold where it has the id; a null truth is never right."""
    rows = answers.join(key.withColumn("known", F.lit(True)), "id", "left")
    truth = F.when(F.col("known"), F.col("truth")).otherwise(F.col("gold"))
    right = F.coalesce(F.col("answer") == truth, F.lit(False))
    return rows.groupBy("system").agg(F.count("*").alias("n"), flag(F.col("ok")).alias("raw"), flag(right).alias("corrected")).withColumn("passed", F.col("corrected") >= gate)


def strata_gate(base: DataFrame, new: DataFrame, strata: DataFrame) -> DataFrame:
    """Per stratum the change of gold's and the strongest wrong answer's share, net and harmed problems, and GO.

    base, new: id, gold_share, wrong_share, ok. GO: gold up, wrong down, net at least 2, harm at most 2.
    """
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in ("gold_share", "wrong_share", "ok")])
    rows = base.join(n, "id").join(strata, "id")
    out = rows.groupBy("stratum").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("n_gold_share") - F.col("gold_share")), 6).alias("gold_change"), F.round(F.avg(F.col("n_wrong_share") - F.col("wrong_share")), 6).alias("wrong_change"),
        F.sum(F.col("n_ok").cast("long") - F.col("ok").cast("long")).alias("net"), flag(F.col("ok") & ~F.col("n_ok")).alias("harm"),
    )
    return out.withColumn("go", (F.col("gold_change") > 0) & (F.col("wrong_change") < 0) & (F.col("net") >= 2) & (F.col("harm") <= 2))
