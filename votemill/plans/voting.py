"""Vote rules over the ballots of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import sweeps, votes
from votemill.plans.registry import query
from votemill.sources.adapters import BALLOTS_SQL, GOLD_SQL, ballots, gold

IDS = "ids AS (SELECT DISTINCT id FROM b)"
W = "PARTITION BY id"


def election(ctes: list[str], source: str, *scores: str, default: str | None = "0") -> str:
    t = f"t AS (SELECT id, ans, min(pos) AS first, {', '.join(f'round(({s})::DOUBLE, 9) AS s{i}' for i, s in enumerate(scores))} FROM {source} WHERE ans IS NOT NULL GROUP BY id, ans)"
    r = f"r AS (SELECT id, ans, row_number() OVER ({W} ORDER BY {', '.join(f's{i} DESC' for i in range(len(scores)))}, first) AS k FROM t)"
    answer = f"coalesce(ans, '{default}')" if default is not None else "ans"
    return f"WITH {', '.join([BALLOTS_SQL, *ctes, IDS, t, r])} SELECT id, {answer} AS answer FROM ids LEFT JOIN (SELECT id, ans FROM r WHERE k = 1) USING (id)"


SHIFT = "{0} AS (SELECT *, logp - max(CASE WHEN ans IS NOT NULL THEN logp END) OVER (PARTITION BY id) AS shift FROM {1})"
MASK = "{0} AS (SELECT * REPLACE (CASE WHEN {2} THEN ans END AS ans) FROM {1})"
DROP_TRUNC = MASK.format("d", "b", "NOT trunc OR NOT bool_or(NOT trunc) OVER (PARTITION BY id)")


def trim_sql(name: str, source: str, frac: float = 0.25) -> str:
    return (
        f"{name}0 AS (SELECT *, count(ans) OVER ({W}) AS n_, row_number() OVER ({W} ORDER BY ans IS NULL, logp DESC, pos) AS r_ FROM {source}), "
        f"{name} AS (SELECT * EXCLUDE (n_, r_) REPLACE (CASE WHEN n_ < 4 OR r_ <= greatest(2, floor(n_ * {1 - frac})) THEN ans END AS ans, CASE WHEN n_ >= 4 THEN r_ ELSE pos END AS pos) FROM {name}0)"
    )




def length_trim_sql(low: int, high: int) -> str:
    at = lambda p: f"l_[1 + least(floor(len(l_) * {p} / 100), len(l_) - 1)::INT]"
    return (
        f'l0 AS (SELECT *, coalesce(list_sort(list("len") FILTER (ans IS NOT NULL) OVER ({W})), []) AS l_ FROM b), '
        f'l1 AS (SELECT *, len(l_) AS n_, "len" BETWEEN {at(low)} AND {at(high)} AS in_ FROM (SELECT * FROM l0)), '
        f"l2 AS (SELECT *, sum((coalesce(in_, false) AND ans IS NOT NULL)::INT) OVER ({W}) AS k_ FROM l1), "
        "l AS (SELECT * REPLACE (CASE WHEN in_ OR n_ < 4 OR k_ < 2 THEN ans END AS ans) FROM l2)"
    )


def fallback_sql(least: int) -> str:
    return f"""WITH {BALLOTS_SQL}, {IDS}, {trim_sql('x', 'b')},
  k AS (SELECT id, ans, count(*) AS n, min(pos) AS f FROM x WHERE ans IS NOT NULL GROUP BY ALL),
  k1 AS (SELECT id, ans, max(n) OVER ({W}) AS top, row_number() OVER ({W} ORDER BY n DESC, f) AS r FROM k),
  m AS (SELECT id, ans, count(*) AS n, min(pos) AS f FROM b WHERE ans IS NOT NULL GROUP BY ALL),
  m1 AS (SELECT id, ans, row_number() OVER ({W} ORDER BY n DESC, f) AS r FROM m)
  SELECT ids.id, coalesce(CASE WHEN k1.top < {least} THEN m1.ans ELSE k1.ans END, '0') AS answer FROM ids LEFT JOIN k1 ON ids.id = k1.id AND k1.r = 1 LEFT JOIN m1 ON ids.id = m1.id AND m1.r = 1"""


LEN_TRIM = f"""l0 AS (SELECT *, list_sort(list("len") FILTER (ans IS NOT NULL) OVER ({W})) AS l_ FROM b),
  l AS (SELECT * REPLACE (CASE WHEN "len" >= CASE WHEN len(l_) >= 5 THEN l_[floor(len(l_) * 0.2)::INT] ELSE 0 END THEN ans END AS ans) FROM l0)"""
SHORT_HALF = f"""h0 AS (SELECT *, count(ans) OVER ({W}) AS n_, row_number() OVER ({W} ORDER BY ans IS NULL, "len", pos) AS r_ FROM b),
  h AS (SELECT * EXCLUDE (n_, r_) REPLACE (CASE WHEN r_ <= greatest(1, n_ // 2) THEN ans END AS ans, r_ AS pos) FROM h0)"""
PLAUSIBLE_TEST = "(length(regexp_replace(ans, '^-?0*', '')) <= 12 OR regexp_replace(ans, '^-?0*', '') = '1000000000000')"
PLAUSIBLE = MASK.format("p", "b", f"{PLAUSIBLE_TEST} OR NOT coalesce(bool_or({PLAUSIBLE_TEST}) OVER (PARTITION BY id), false)")
WEIGHT = "sum(exp(shift * {0}))"

RULE_SQL = {
    "majority": election([], "b", "count(*)"),
    "weighted2": election([SHIFT.format("s", "b")], "s", WEIGHT.format(2)),
    "weighted1": election([SHIFT.format("s", "b")], "s", WEIGHT.format(1)),
    "weighted4": election([SHIFT.format("s", "b")], "s", WEIGHT.format(4)),
    "drop_trunc": election([DROP_TRUNC], "d", "count(*)"),
    "drop_trunc_weighted": election([DROP_TRUNC, SHIFT.format("s", "d")], "s", WEIGHT.format(2)),
    "plausible": election([PLAUSIBLE], "p", "count(*)"),
    "len_trim20": election([LEN_TRIM], "l", "count(*)"),
    "short_half": election([SHORT_HALF, SHIFT.format("s", "h")], "s", WEIGHT.format(2)),
    "prefer_short": election([], "b", "count(*)", '-avg("len")'),
    "tiebreak_conf": election([], "b", "count(*)", "max(logp)"),
}
RULE_SQL |= {f"trim{p}": election([trim_sql("x", "b", p / 100)], "x", "count(*)") for p in (10, 20, 25, 30, 40, 50)}
RULE_SQL |= {f"trim{p}_weighted": election([trim_sql("x", "b", p / 100), SHIFT.format("s", "x")], "s", WEIGHT.format(2)) for p in (10, 20, 25, 30, 40, 50)}
RULE_SQL |= {f"trunc_trim{p}": election([DROP_TRUNC, trim_sql("x", "d", p / 100)], "x", "count(*)") for p in (10, 25, 40)}
RULE_SQL |= {f"length_trim{n}": election([length_trim_sql(a, b)], "l", "count(*)") for n, a, b in (("", 10, 90), ("_5_95", 5, 95), ("_20_80", 20, 80))}
RULE_SQL |= {f"trim_fallback{n}": fallback_sql(k) for n, k in (("2", 2), ("", 3), ("4", 4))}


def of_seed(sql: str, seed: int) -> str:
    """A query over all ballots, over those of one seed."""
    return sql.replace(BALLOTS_SQL, f"b0{BALLOTS_SQL[1:]}, b AS (SELECT * FROM b0 WHERE seed = {seed})")


for _rule, _f in votes.RULES.items():
    query(f"vote_{_rule}", RULE_SQL[_rule])(lambda s, d, f=_f: f(ballots(s, d)))


@query("vote_weighted_acc", f"WITH won AS ({RULE_SQL['weighted2']}), {GOLD_SQL} SELECT count(*) AS n, sum((answer = gold)::INT)::BIGINT AS correct, round(avg((answer = gold)::INT), 9) AS accuracy FROM won JOIN g USING (id)")
def vote_weighted_acc(spark, d):
    won = votes.weighted(ballots(spark, d)).join(gold(spark, d), "id")
    hit = (F.col("answer") == F.col("gold")).cast("long")
    return won.agg(F.count("*").alias("n"), F.sum(hit).alias("correct"), F.round(F.avg(hit), 9).alias("accuracy"))


@query(
    "rule_sweep",
    f"WITH {GOLD_SQL}, won AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM ({v})" for k, v in RULE_SQL.items()) + ") SELECT rule, count(*) AS n, sum((answer = gold)::INT)::BIGINT AS correct FROM won JOIN g USING (id) GROUP BY rule",
)
def rule_sweep(spark, d):
    return sweeps.sweep(ballots(spark, d), gold(spark, d))




@query(
    "vote_rule_ensemble",
    "WITH v AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, '{k}' AS rule, id, answer AS ans FROM ({RULE_SQL[k]})" for i, k in enumerate(sweeps.MEMBERS)) + "), "
    "o AS (SELECT *, (ans = max(CASE WHEN rule = 'weighted2' THEN ans END) OVER (PARTITION BY id))::INT AS own FROM v), "
    "t AS (SELECT id, ans, count(*) AS n, max(own) AS own, min(pos) AS f FROM o GROUP BY id, ans) "
    "SELECT id, ans AS answer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, own DESC, f) AS r FROM t) WHERE r = 1",
)
def vote_rule_ensemble(spark, d):
    return sweeps.rule_ensemble(ballots(spark, d))


@query(
    "vote_conditional",
    f"""WITH {BALLOTS_SQL}, {SHIFT.format('s', 'b')}, t AS (SELECT id, ans, min(pos) AS f, count(*) AS n, round(sum(exp(shift * 2)), 9) AS w FROM s WHERE ans IS NOT NULL GROUP BY id, ans),
  r AS (SELECT *, row_number() OVER ({W} ORDER BY n DESC, f) AS rn, row_number() OVER ({W} ORDER BY w DESC, f) AS rw, count(*) OVER ({W}) AS c FROM t),
  m AS (SELECT id, max(CASE WHEN rn = 1 THEN ans END) AS a, max(CASE WHEN rw = 1 THEN ans END) AS h, CASE WHEN max(c) = 1 THEN 99 ELSE max(CASE WHEN rn = 1 THEN n END) - max(CASE WHEN rn = 2 THEN n END) END AS margin FROM r GROUP BY id)
  SELECT id, margin::BIGINT AS margin, CASE WHEN margin > 1 THEN a ELSE h END AS answer FROM m""",
)
def vote_conditional(spark, d):
    return votes.conditional(ballots(spark, d))


def oversized(b):
    """Ballots whose '3' became a number of 25 digits and whose '4' is the largest that fits."""
    return b.withColumn("ans", F.when(F.col("ans") == "3", F.lit("9" * 25)).when(F.col("ans") == "4", F.lit(votes.INT64_MAX)).otherwise(F.col("ans")))


OVERSIZED = f"o AS (SELECT * REPLACE (CASE ans WHEN '3' THEN '{'9' * 25}' WHEN '4' THEN '{votes.INT64_MAX}' ELSE ans END AS ans) FROM b)"


@query(
    "vote_int64_safe",
    f"""WITH {BALLOTS_SQL}, {IDS}, {OVERSIZED}, t AS (SELECT id, ans, TRY_CAST(ans AS BIGINT) IS NOT NULL AS fine, count(*) AS n, min(pos) AS f FROM o WHERE ans IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, row_number() OVER ({W} ORDER BY n DESC, f) AS k, row_number() OVER (PARTITION BY id, fine ORDER BY n DESC, f) AS kf FROM t),
  m AS (SELECT id, max(CASE WHEN k = 1 THEN ans END) AS a, bool_or(k = 1 AND fine) AS ok, max(CASE WHEN kf = 1 AND fine THEN ans END) AS s FROM r GROUP BY id)
  SELECT ids.id, coalesce(CASE WHEN ok THEN a ELSE s END, '0') AS answer, CASE WHEN a IS NULL OR ok THEN 'none' WHEN s IS NULL THEN 'all_oversized' ELSE 'oversized_' || length(a) || 'd' END AS reason FROM ids LEFT JOIN m USING (id)""",
)
def vote_int64_safe(spark, d):
    return votes.int64_safe(oversized(ballots(spark, d)))


PRIOR = {
    "log": "1 / (1 + log10(1 + abs(ans::DOUBLE)) / 3.0)",
    "digits": "CASE WHEN length(ltrim(ans, '-')) <= 5 THEN 1.0 ELSE pow(0.5, length(ltrim(ans, '-')) - 5) END",
    "hardcap": "CASE WHEN abs(ans::DOUBLE) <= 1e5 THEN 1.0 ELSE 0.05 END",
}
for _mode, _k in (("log", 3.0), ("digits", 5), ("hardcap", 5.0)):
    query(
        f"vote_answer_prior_{_mode}",
        election([OVERSIZED, SHIFT.format("s", "o")], "s", f"sum(exp(shift * 2) * ({PRIOR[_mode]}) * CASE WHEN ans = '0' THEN 0.5 ELSE 1.0 END)", default=None),
    )(lambda s, d, m=_mode, k=_k: votes.answer_prior(oversized(ballots(s, d)), m, k))


@query("first_finish", f'WITH {BALLOTS_SQL} SELECT id, ans AS answer FROM (SELECT *, row_number() OVER ({W} ORDER BY trunc, "len", pos) AS r FROM b) WHERE r = 1')
def first_finish(spark, d):
    return votes.first_finish(ballots(spark, d))


@query(
    "vote_sharpened",
    f"""WITH {BALLOTS_SQL}, {SHIFT.format('s', 'b')}, t AS (SELECT id, ans, min(pos) AS f, sum(pow(exp(shift), 3)) AS w FROM s WHERE ans IS NOT NULL GROUP BY id, ans),
  q AS (SELECT *, w / sum(w) OVER ({W}) AS share FROM t), r AS (SELECT *, row_number() OVER ({W} ORDER BY round(share, 9) DESC, f) AS k FROM q)
  SELECT id, max(CASE WHEN k = 1 THEN ans END) AS answer, round(max(CASE WHEN k = 1 THEN share END), 6) AS share, round(max(CASE WHEN k = 1 THEN share END) - coalesce(max(CASE WHEN k = 2 THEN share END), 0), 6) AS margin FROM r GROUP BY id""",
)
def vote_sharpened(spark, d):
    return votes.sharpened(ballots(spark, d))


@query(
    "verifier_weighted",
    f"""WITH {BALLOTS_SQL}, {IDS}, t AS (SELECT id, ans, min(pos) AS f, count(*) AS n, round(sum(score), 9) AS s FROM b WHERE ans IS NOT NULL GROUP BY id, ans),
  r AS (SELECT *, row_number() OVER ({W} ORDER BY s DESC, f) AS k, row_number() OVER ({W} ORDER BY n DESC, f) AS m FROM t),
  o AS (SELECT id, ans, row_number() OVER ({W} ORDER BY score DESC, pos) AS k FROM b WHERE ans IS NOT NULL)
  SELECT ids.id, coalesce((any_value(r.ans) FILTER (r.k = 1)), '0') AS score_weighted, coalesce(any_value(o.ans), any_value(r.ans) FILTER (r.m = 1), '0') AS best_of_1
  FROM ids LEFT JOIN r USING (id) LEFT JOIN o ON ids.id = o.id AND o.k = 1 GROUP BY ids.id""",
)
def verifier_weighted(spark, d):
    return votes.score_vote(ballots(spark, d))


@query(
    "verdict_hybrid",
    f"""WITH {BALLOTS_SQL}, t AS (SELECT id, ans, min(pos) AS f, count(*) AS n, sum((score >= 0.04)::INT) AS k FROM b WHERE ans IS NOT NULL GROUP BY id, ans),
  r AS (SELECT *, max(k) OVER ({W}) AS top, row_number() OVER ({W} ORDER BY k DESC, f) AS rk, row_number() OVER ({W} ORDER BY n DESC, f) AS rn, row_number() OVER ({W} ORDER BY n + k DESC, f) AS rh FROM t)
  SELECT id, max(CASE WHEN (top > 0 AND rk = 1) OR (top = 0 AND rn = 1) THEN ans END) AS verdict, max(CASE WHEN rh = 1 THEN ans END) AS hybrid FROM r GROUP BY id""",
)
def verdict_hybrid(spark, d):
    return votes.verdict_vote(ballots(spark, d), F.col("score") >= 0.04)


@query(
    "reward_vote",
    f"""WITH {BALLOTS_SQL}, {SHIFT.format('s', 'b')}, v AS (SELECT *, exp(score - max(score) OVER ({W})) AS e, exp(shift * 2) AS c FROM s WHERE ans IS NOT NULL),
  n AS (SELECT *, e / sum(e) OVER ({W}) AS en, c / sum(c) OVER ({W}) AS cn, row_number() OVER ({W} ORDER BY score DESC, pos) AS b1 FROM v),
  t AS (SELECT id, ans, min(pos) AS f, min(b1) AS b1, round(sum(en), 9) AS v, round(sum(en * cn), 9) AS p FROM n GROUP BY id, ans),
  r AS (SELECT *, row_number() OVER ({W} ORDER BY v DESC, f) AS rv, row_number() OVER ({W} ORDER BY p DESC, f) AS rp FROM t)
  SELECT id, max(CASE WHEN b1 = 1 THEN ans END) AS rm_best, max(CASE WHEN rv = 1 THEN ans END) AS rm_vote, max(CASE WHEN rp = 1 THEN ans END) AS rm_conf_vote FROM r GROUP BY id""",
)
def reward_vote(spark, d):
    return votes.reward_vote(ballots(spark, d))


@query("best_representative", f"WITH {BALLOTS_SQL} SELECT id, ans, pos AS best_pos FROM (SELECT *, row_number() OVER (PARTITION BY id, ans ORDER BY logp DESC, pos) AS r FROM b WHERE ans IS NOT NULL) WHERE r = 1")
def best_representative(spark, d):
    return votes.best_representative(ballots(spark, d))


@query(
    "tournament_overlay",
    f"""WITH {BALLOTS_SQL}, t AS (SELECT id, ans, min(pos) AS f, count(*) AS n FROM b WHERE ans IS NOT NULL GROUP BY id, ans), r AS (SELECT *, row_number() OVER ({W} ORDER BY n DESC, f) AS k FROM t),
  p AS (SELECT id, max(CASE WHEN k = 1 THEN ans END) AS a, max(CASE WHEN k = 2 THEN ans END) AS b, max(CASE WHEN k = 1 THEN n END) - max(CASE WHEN k = 2 THEN n END) AS gap FROM r GROUP BY id),
  j AS (SELECT id, sum((score < 0.04)::INT) AS va, count(*) AS vn FROM b GROUP BY id)
  SELECT id, b IS NOT NULL AND gap <= 1 AS contested, CASE WHEN b IS NOT NULL AND gap <= 1 AND 2 * va < vn THEN b ELSE a END AS answer FROM p JOIN j USING (id)""",
)
def tournament_overlay(spark, d):
    return votes.tournament(ballots(spark, d), F.col("score") < 0.04)


def mix_sql(a: int, b: int) -> str:
    return (
        f"m0 AS (SELECT * FROM (SELECT * REPLACE (row_number() OVER ({W} ORDER BY pos) - 1 AS pos), 0 AS src FROM b WHERE system = 'O') WHERE pos < {a} UNION ALL "
        f"SELECT * FROM (SELECT * REPLACE (row_number() OVER ({W} ORDER BY pos) - 1 AS pos), 1 AS src FROM b WHERE system = 'F') WHERE pos < {b}), "
        f"m AS (SELECT * REPLACE (row_number() OVER ({W} ORDER BY src, pos) - 1 AS pos) FROM m0)"
    )


def one_system(b, system: str):
    own = b.filter(F.col("system") == system)
    return own.withColumn("pos", F.row_number().over(votes.by_id().orderBy("pos")) - 1)


for _a, _b in ((2, 2), (3, 1), (1, 3)):
    query(
        f"policy_mix_{_a}_{_b}",
        election([mix_sql(_a, _b), SHIFT.format("s", "m")], "s", WEIGHT.format(2)).replace("ids AS (SELECT DISTINCT id FROM b)", "ids AS (SELECT DISTINCT id FROM m)"),
    )(lambda s, d, a=_a, b=_b: votes.weighted(votes.mix(one_system(ballots(s, d), "O"), one_system(ballots(s, d), "F"), a, b)))


@query(
    "dump_merge",
    election([f"m AS (SELECT * REPLACE (row_number() OVER ({W} ORDER BY seed, pos) - 1 AS pos) FROM b)"], "m", "count(*)"),
)
def dump_merge(spark, d):
    b = ballots(spark, d)
    return votes.majority(votes.merge([b.filter(F.col("seed") == i) for i in range(3)]))


@query(
    "adaptive_budget",
    f"""WITH {BALLOTS_SQL}, {IDS}, t AS (SELECT id, ans, min(pos) AS f, sum((pos < 2)::INT) AS k, count(*) AS n FROM b WHERE ans IS NOT NULL AND pos < 6 GROUP BY id, ans),
  r AS (SELECT *, max(k) OVER ({W}) > 1 AS settled, row_number() OVER ({W} ORDER BY k DESC, f) AS rk, row_number() OVER ({W} ORDER BY n DESC, f) AS rn FROM t),
  m AS (SELECT id, bool_or(settled) AS settled, max(CASE WHEN (settled AND rk = 1) OR (NOT settled AND rn = 1) THEN ans END) AS ans FROM r GROUP BY id), c AS (SELECT id, count(*) AS c FROM b GROUP BY id)
  SELECT c.id, coalesce(ans, '0') AS answer, least(c, CASE WHEN coalesce(settled, false) THEN 2 ELSE 6 END)::BIGINT AS votes FROM c LEFT JOIN m USING (id)""",
)
def adaptive_budget(spark, d):
    return votes.adaptive(ballots(spark, d))


@query(
    "temp_mixture",
    f"""WITH {BALLOTS_SQL}, {GOLD_SQL}, e AS (SELECT id, seed::VARCHAR AS config, pos, ans, logp FROM b UNION ALL SELECT id, 'pooled', pos, ans, logp FROM b),
  s AS (SELECT *, logp - max(CASE WHEN ans IS NOT NULL THEN logp END) OVER (PARTITION BY config, id) AS shift FROM e),
  t AS (SELECT config, id, ans, min(pos) AS f, round(sum(exp(shift * 2)), 9) AS w FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY config, id ORDER BY ans IS NULL, w DESC, f) AS k FROM t)
  SELECT config, count(*) AS n, sum((coalesce(ans, '0') = gold)::INT)::BIGINT AS correct FROM r JOIN g USING (id) WHERE k = 1 GROUP BY config""",
)
def temp_mixture(spark, d):
    b = ballots(spark, d).withColumn("config", F.explode(F.array(F.col("seed").cast("string"), F.lit("pooled"))))
    won = votes.weighted(b, keys=("config", "id")).join(gold(spark, d), "id")
    return won.groupBy("config").agg(F.count("*").alias("n"), F.sum((F.col("answer") == F.col("gold")).cast("long")).alias("correct"))


RANKED = "k0 AS (SELECT id, pos, unnest(list_distinct_ordered) AS ans, generate_subscripts(list_distinct_ordered, 1) - 1 AS i FROM (SELECT id, pos, list_filter([ans, other::VARCHAR, ((other + 1) % 5)::VARCHAR], lambda x, j: list_position([ans, other::VARCHAR, ((other + 1) % 5)::VARCHAR], x) = j) AS list_distinct_ordered FROM b WHERE ans IS NOT NULL))"
POINTS = {"top1": "(i = 0)::INT", "borda": "k - i", "mrr": "1 / (i + 1)"}
for _scheme, _points in POINTS.items():
    for _conf in (False, True):
        query(
            f"vote_{_scheme}{'_weighted' if _conf else ''}",
            f"WITH {BALLOTS_SQL}, {RANKED}, {SHIFT.format('s', 'b')}, k1 AS (SELECT k0.*, count(*) OVER (PARTITION BY k0.id, k0.pos) AS k, exp(shift * 2) AS w FROM k0 JOIN s ON k0.id = s.id AND k0.pos = s.pos), "
            f"t AS (SELECT id, ans, round(sum(({_points}){' * w' if _conf else ''})::DOUBLE, 9) AS s, min(pos * 10 + i) AS f FROM k1 {'WHERE i = 0' if _scheme == 'top1' else ''} GROUP BY id, ans) SELECT id, ans AS answer FROM (SELECT *, row_number() OVER ({W} ORDER BY s DESC, f) AS r FROM t) WHERE r = 1",
        )(lambda s, d, x=_scheme, c=_conf: votes.ranked_vote(votes.ranked_ballots(ballots(s, d)), x, c))


def runoff_sql(rounds: int) -> str:
    """Rounds unrolled: live answers, first choices among them, the winner or who leaves."""
    parts = [BALLOTS_SQL, RANKED, "l0 AS (SELECT id, ans, min(pos * 10 + i) AS o FROM k0 GROUP BY id, ans)"]
    for r in range(rounds):
        parts.append(f"f{r} AS (SELECT k0.id, pos, arg_min(k0.ans, i) AS ans FROM k0 JOIN l{r} USING (id, ans) GROUP BY k0.id, pos)")
        parts.append(f"n{r} AS (SELECT l.id, l.ans, l.o, count(f.ans) AS n FROM l{r} l LEFT JOIN f{r} f ON l.id = f.id AND l.ans = f.ans GROUP BY ALL)")
        parts.append(f"w{r} AS (SELECT *, count(*) OVER ({W}) AS live, sum(n) OVER ({W}) AS total, row_number() OVER ({W} ORDER BY n DESC, o) AS best, row_number() OVER ({W} ORDER BY n, ans::INT DESC) AS worst, max(n) OVER ({W}) AS most FROM n{r})")
        parts.append(f"l{r + 1} AS (SELECT id, ans, o FROM w{r} WHERE live > 1 AND 2 * most <= total AND worst > 1)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT id, ans AS answer FROM w{r} WHERE best = 1 AND (live = 1 OR 2 * most > total)" for r in range(rounds))


@query("vote_irv", runoff_sql(5))
def vote_irv(spark, d):
    return votes.instant_runoff(votes.ranked_ballots(ballots(spark, d)))
