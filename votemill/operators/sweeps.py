"""Many vote rules at once: one stage of windows, one tally and one election for all of them.

A rule is a form: which ballots count, in what order ties resolve, and scores over the ballots that count. The forms of a
sweep become columns of one tally by (id, ans) and of one election by id, so that a sweep costs one exchange, whatever
the number of rules. Rules that callers give as functions run by themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.votes import RULES, elect, fits_within, rounded, valid

KEYS = ("id",)


@dataclass(frozen=True)
class Form:
    """mask: ballots that count (of those with an answer); pos: their order; scores: aggregates given the mask.
    fallback: with fewer votes than this for the winner, the answer of the second form stands instead."""

    mask: Column | None
    pos: Column
    scores: tuple[Callable[[Column], Column], ...]
    fallback: int = 0


def votes(m: Column) -> Column:
    return F.count(F.when(m, 1))


def heavy(scale: float, top: str) -> Callable[[Column], Column]:
    return lambda m: F.sum(F.when(m, F.exp((F.col("logp") - F.col(top)) * scale)))


def widened(ballots: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """ballots with what the forms need: counts and ranks among valid and among complete ballots, lengths, tops."""
    w = Window.partitionBy(*keys)
    plausible = fits_within(F.col("ans"), "1000000000000")
    complete = ~F.col("trunc") | ~F.max(~F.col("trunc")).over(w)
    rows = ballots.withColumns({
        "n_": F.count("ans").over(w),
        "d_": valid() & complete,
        "p_": plausible | ~F.coalesce(F.max(F.when(valid(), plausible)).over(w), F.lit(False)),
        "top_": F.max(F.when(valid(), F.col("logp"))).over(w),
    })
    first = lambda *order: F.row_number().over(w.orderBy(*order, "pos"))
    rows = rows.withColumns({
        "r_": first(~valid(), F.desc("logp")),
        "rd_": first(~F.col("d_"), F.desc("logp")),
        "h_": first(~valid(), "len"),
        "nd_": F.count(F.when(F.col("d_"), 1)).over(w),
        "topd_": F.max(F.when(F.col("d_"), F.col("logp"))).over(w),
    })
    ranked = lambda k: F.max(F.when(valid() & (F.col("h_") == k), F.col("len"))).over(w)  # noqa: E731  the k-th shortest valid length
    cuts = {f"cut{p}_": ranked(F.least(F.floor(F.col("n_") * p / 100), F.col("n_") - 1) + 1) for band in BANDS for p in band}
    rows = rows.withColumns({**cuts, "cut_": ranked(F.greatest(F.lit(1), F.floor(F.col("n_") * 0.2)))})
    half = F.col("h_") <= F.greatest(F.lit(1), F.floor(F.col("n_") / 2))
    inside = {f"in{low}_": between(low, high) for low, high in BANDS}
    rows = rows.withColumns({"half_": half, "toph_": F.max(F.when(valid() & half, F.col("logp"))).over(w), **inside})
    return rows.withColumns({f"k{low}_": F.sum((F.col(f"in{low}_") & valid()).cast("int")).over(w) for low, _ in BANDS})


BANDS = ((10, 90), (5, 95), (20, 80))


def between(low: int, high: int) -> Column:
    return F.when(F.col("n_") > 0, F.col("len").between(F.col(f"cut{low}_"), F.col(f"cut{high}_"))).otherwise(False)


def trimmed(frac: float, n: str = "n_", r: str = "r_") -> Column:
    return (F.col(n) < 4) | (F.col(r) <= F.greatest(F.lit(2), F.floor(F.col(n) * (1 - frac))))


def forms() -> dict[str, Form]:
    """The named rules; their names are those of votes.RULES."""
    pos = F.col("pos")
    by_conf = lambda n="n_", r="r_": F.when(F.col(n) >= 4, F.col(r)).otherwise(pos)
    out = {
        "majority": Form(None, pos, (votes,)),
        "weighted1": Form(None, pos, (heavy(1.0, "top_"),)),
        "weighted2": Form(None, pos, (heavy(2.0, "top_"),)),
        "weighted4": Form(None, pos, (heavy(4.0, "top_"),)),
        "drop_trunc": Form(F.col("d_"), pos, (votes,)),
        "drop_trunc_weighted": Form(F.col("d_"), pos, (heavy(2.0, "topd_"),)),
        "prefer_short": Form(None, pos, (votes, lambda m: -F.avg(F.when(m, F.col("len"))))),
        "tiebreak_conf": Form(None, pos, (votes, lambda m: F.max(F.when(m, F.col("logp"))))),
        "plausible": Form(F.col("p_"), pos, (votes,)),
        "short_half": Form(F.col("half_"), F.col("h_"), (heavy(2.0, "toph_"),)),
        "len_trim20": Form(F.col("len") >= F.when(F.col("n_") >= 5, F.col("cut_")).otherwise(0), pos, (votes,)),
    }
    for p in (10, 20, 25, 30, 40, 50):
        out[f"trim{p}"] = Form(trimmed(p / 100), by_conf(), (votes,))
        out[f"trim{p}_weighted"] = Form(trimmed(p / 100), by_conf(), (heavy(2.0, "top_"),))
    for p in (10, 25, 40):
        out[f"trunc_trim{p}"] = Form(F.col("d_") & trimmed(p / 100, "nd_", "rd_"), by_conf("nd_", "rd_"), (votes,))
    for (low, high), name in zip(BANDS, ("length_trim", "length_trim_5_95", "length_trim_20_80")):
        out[name] = Form(F.col(f"in{low}_") | (F.col("n_") < 4) | (F.col(f"k{low}_") < 2), pos, (votes,))
    for least, name in ((2, "trim_fallback2"), (3, "trim_fallback"), (4, "trim_fallback4")):
        out[name] = Form(trimmed(0.25), by_conf(), (votes,), least)
    return out


def answers(ballots: DataFrame, rules: tuple[str, ...], keys: tuple[str, ...] = KEYS, default: str = "0") -> DataFrame:
    """keys, rule, answer: each rule's answer, one pass over the ballots."""
    known = forms()
    used = {r: known[r] for r in rules}
    wide = widened(ballots, keys)
    columns, order = [F.count("ans").alias("all_n"), F.min("pos").alias("all_first")], {}
    for i, form in enumerate(used.values()):
        m = valid() if form.mask is None else valid() & F.coalesce(form.mask, F.lit(False))
        columns.append(F.min(F.when(m, form.pos)).alias(f"f{i}"))
        columns += [score(m).alias(f"s{i}_{j}") for j, score in enumerate(form.scores)]
        order[i] = F.when(F.col(f"f{i}").isNotNull(), F.struct(*[rounded(F.col(f"s{i}_{j}")).alias(f"s{j}") for j in range(len(form.scores))], (-F.col(f"f{i}")).alias("f")))
    tally = wide.groupBy(*keys, "ans").agg(*columns)
    plain = F.max_by("ans", F.when(valid(), F.struct("all_n", -F.col("all_first"))))
    won = []
    for i, (rule, form) in enumerate(used.items()):
        answer = F.max_by("ans", order[i])
        if form.fallback:
            answer = F.when(F.max(f"s{i}_0") < form.fallback, plain).otherwise(answer)
        won.append(F.struct(F.lit(rule).alias("rule"), F.coalesce(answer, F.lit(default)).alias("answer")))
    got = tally.groupBy(*keys).agg(F.array(*won).alias("won"))
    return got.select(*keys, F.explode("won").alias("w")).select(*keys, "w.rule", "w.answer")


def sweep(ballots: DataFrame, gold: DataFrame, rules: dict | None = None) -> DataFrame:
    """rule, n, correct of every rule over the same ballots. Rules that are not among the named ones run by themselves."""
    rules = RULES if rules is None else rules
    known = forms()
    named = tuple(r for r, f in rules.items() if r in known and f is RULES.get(r))
    parts = [answers(ballots, named)] if named else []
    parts += [f(ballots).select("id", F.lit(r).alias("rule"), "answer") for r, f in rules.items() if r not in named]
    won = reduce(DataFrame.unionByName, parts)
    return won.join(gold, "id").groupBy("rule").agg(F.count("*").alias("n"), F.sum((F.col("answer") == F.col("gold")).cast("long")).alias("correct"))


MEMBERS = ("majority", "weighted2", "weighted1", "weighted4", "trim25", "drop_trunc", "len_trim20")


def rule_ensemble(ballots: DataFrame, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """The answer that most member rules give; of tied ones the weighted rule's, or else the first member's."""
    place = F.array_position(F.array(*map(F.lit, members)), F.col("rule")).cast("int")
    won = answers(ballots, members).select("id", place.alias("pos"), F.col("answer").alias("ans"))
    strong = F.max(F.when(F.col("pos") == members.index("weighted2") + 1, F.col("ans"))).over(Window.partitionBy("id"))
    won = won.withColumn("own", (F.col("ans") == strong).cast("int"))
    return elect(won, F.count("*"), F.max("own"))


def category_stability(ballots: DataFrame, gold: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Per category the best rule of each seed, whether all seeds agree on it, and the right answers of the best ones."""
    won = answers(ballots, rules, ("seed", "id")).join(gold, "id")
    cells = won.groupBy("category", "rule", "seed").agg(F.sum((F.col("answer") == F.col("gold")).cast("long")).alias("correct"))
    best = F.row_number().over(Window.partitionBy("category", "seed").orderBy(F.desc("correct"), "rule"))
    top = cells.withColumn("r", best).filter("r = 1")
    return top.groupBy("category").agg(F.min("rule").alias("winner"), (F.countDistinct("rule") == 1).alias("stable"), F.sum("correct").alias("correct"))
