"""Systems (a supplier line's seed stands for one) on the problems of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import metrics, systems, votes
from votemill.plans.evaluation import BG
from votemill.plans.registry import query
from votemill.plans.voting import RULE_SQL, SHIFT, of_seed
from votemill.sources.adapters import GOLD_SQL, ballots, dealt, gold
from votemill.sources.scratch import written

A = f"{BG}, a AS (SELECT id, 's' || seed AS system, coalesce(arg_max(ans, ROW(n, -f)) FILTER (ans IS NOT NULL), '0') AS answer, any_value(gold) AS gold, any_value(category) AS category FROM (SELECT id, seed, ans, gold, category, count(*) AS n, min(pos) AS f FROM j GROUP BY ALL) GROUP BY id, seed), k AS (SELECT *, answer = gold AS ok FROM a), s AS (SELECT * FROM k WHERE id IN (SELECT id FROM k GROUP BY id HAVING count(*) = 3))"


def by_seed(spark, d):
    b = ballots(spark, d).withColumn("system", F.concat(F.lit("s"), F.col("seed").cast("string")))
    answers = written(systems.answers_by_system(b, gold(spark, d)))  # read several times over, so that a task need not vote as often
    return systems.covered(dealt(answers, "id"), 50)


@query("system_rescue_harm", f"WITH {A} SELECT x.system, count(*) AS n, sum((x.ok AND NOT y.ok)::INT)::BIGINT AS rescued, sum((NOT x.ok AND y.ok)::INT)::BIGINT AS harmed, sum((x.answer <> y.answer)::INT)::BIGINT AS differing FROM s x JOIN s y ON x.id = y.id AND y.system = 's0' AND x.system <> 's0' GROUP BY x.system")
def system_rescue_harm(spark, d):
    return systems.rescue_harm(by_seed(spark, d), "s0")


@query("union_oracle", f"WITH {A}, p AS (SELECT id, bool_or(ok) AS x, bool_and(ok) AS y FROM s GROUP BY id) SELECT count(*) AS n, sum(x::INT)::BIGINT AS any_right, sum(y::INT)::BIGINT AS all_right FROM p")
def union_oracle(spark, d):
    return systems.union_oracle(by_seed(spark, d))


def cover_sql(steps: int) -> str:
    parts, taken = [A, "o AS (SELECT DISTINCT id, system FROM s WHERE ok)"], "SELECT NULL AS system WHERE false"
    for i in range(1, steps + 1):
        parts.append(f"c{i} AS (SELECT {i}::INT AS step, system, count(*) AS gain FROM o WHERE id NOT IN (SELECT id FROM o WHERE system IN ({taken})) GROUP BY system ORDER BY gain DESC, system DESC LIMIT 1)")
        taken = " UNION ALL ".join(f"SELECT system FROM c{k}" for k in range(1, i + 1))
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, steps + 1))


@query("greedy_cover", cover_sql(6))
def greedy_cover(spark, d):
    return systems.greedy_cover(by_seed(spark, d))


@query("wrong_agreement", f"WITH {A} SELECT x.system AS a, y.system AS b, count(*) AS both_wrong, round(avg((x.answer = y.answer)::INT), 9) AS same FROM s x JOIN s y ON x.id = y.id AND x.system <> y.system AND NOT x.ok AND NOT y.ok GROUP BY ALL")
def wrong_agreement(spark, d):
    return systems.wrong_agreement(by_seed(spark, d))


@query(
    "amateur_score",
    f"""WITH {A}, p AS (SELECT x.system, sum((NOT x.ok AND NOT y.ok AND x.answer = y.answer)::INT) / sum((NOT x.ok AND NOT y.ok)::INT) AS wa, avg((x.ok AND NOT y.ok)::INT) AS rr, avg(y.ok::INT) - avg(x.ok::INT) AS gap FROM s x JOIN s y ON x.id = y.id AND y.system = 's0' AND x.system <> 's0' GROUP BY x.system)
  SELECT system, round(wa, 6) AS wrong_same, round(rr, 6) AS rescue_rate, round(wa - 2 * rr, 6) AS score, gap >= 0.08 AS contrasts FROM p""",
)
def amateur_score(spark, d):
    return systems.pair_scores(by_seed(spark, d), "s0")


@query(
    "family_vote",
    f"""WITH {BG}, w AS (SELECT *, seed AS fam, exp((logp - max(logp) OVER (PARTITION BY id, seed)) * 2) AS w FROM j WHERE ans IS NOT NULL), t AS (SELECT id, fam, ans, gold, min(pos) AS f, round(sum(w), 9) AS w FROM w GROUP BY ALL),
  p AS (SELECT id, fam, any_value(gold) AS gold, arg_max(ans, ROW(w, -f)) AS ans, max(w) / sum(w) AS share FROM t GROUP BY id, fam), c AS (SELECT fam, id % 5 AS fold, sum((ans = gold)::INT) AS c, count(*) AS n FROM p GROUP BY ALL),
  r AS (SELECT fam, fold, (sum(c) OVER (PARTITION BY fam) - c) / (sum(n) OVER (PARTITION BY fam) - n) AS rel FROM c),
  e AS (SELECT x.fam, y.fam AS other, coalesce(corr((x.ans = x.gold)::INT, (y.ans = y.gold)::INT), 0) AS k FROM p x JOIN p y ON x.id = y.id AND x.fam <> y.fam GROUP BY ALL), v AS (SELECT fam, 1 - avg(k) AS diversity FROM e GROUP BY fam),
  q AS (SELECT p.*, rel, least(greatest(rel, 1e-3), 1 - 1e-3) AS b, diversity, row_number() OVER (PARTITION BY id ORDER BY p.fam) AS pos FROM p JOIN r ON p.fam = r.fam AND p.id % 5 = r.fold LEFT JOIN v ON p.fam = v.fam),
  s AS (SELECT id, ans, min(pos) AS f, round(count(*)::DOUBLE, 9) AS s0, round(sum(rel), 9) AS s1, round(sum(greatest(ln(b / (1 - b)), 0)), 9) AS s2, round(sum(rel * coalesce(diversity, 1)), 9) AS s3, round(sum(rel * share), 9) AS s4 FROM q GROUP BY id, ans)
  SELECT id, arg_max(ans, ROW(s0, -f)) AS equal, arg_max(ans, ROW(s1, -f)) AS reliable, arg_max(ans, ROW(s2, -f)) AS odds, arg_max(ans, ROW(s3, -f)) AS diverse, arg_max(ans, ROW(s4, -f)) AS confident FROM s GROUP BY id""",
)
def family_vote(spark, d):
    return systems.family_vote(ballots(spark, d), gold(spark, d), "seed")


@query(
    "specialist_cells",
    f"""WITH {A}, p AS (SELECT x.category, x.system, x.id % 3 AS part, count(*) AS n, sum(x.ok::INT - y.ok::INT)::BIGINT AS net FROM s x JOIN s y ON x.id = y.id AND y.system = 's0' AND x.system <> 's0' GROUP BY ALL),
  c AS (SELECT category, system, sum(n)::BIGINT AS n, sum(net)::BIGINT AS net, sum(net) <> 0 AND min(sign(net)) = max(sign(net)) AND min(sign(net)) = sign(sum(net)) AS agree FROM p GROUP BY category, system)
  SELECT category, system, n, net, agree, round(net / n - coalesce((sum(net) OVER (PARTITION BY system) - net) / nullif(sum(n) OVER (PARTITION BY system) - n, 0), 0), 6) AS diff FROM c QUALIFY n >= 15""",
)
def specialist_cells(spark, d):
    return systems.specialists(by_seed(spark, d), "s0")


@query("mcnemar", f"WITH {A}, p AS (SELECT sum((x.ok AND NOT y.ok)::INT)::BIGINT AS b, sum((NOT x.ok AND y.ok)::INT)::BIGINT AS c FROM s x JOIN s y ON x.id = y.id AND x.system = 's0' AND y.system = 's1') SELECT b, c, b - c AS diff, round((abs(b - c) - 1) / sqrt(b + c), 6) AS z, round(1.96 * sqrt(b + c) + 1, 6) AS mdd FROM p")
def mcnemar(spark, d):
    return systems.mcnemar(by_seed(spark, d), "s0", "s1")


@query(
    "marginal_se",
    f"WITH won AS ({RULE_SQL['weighted2']}), {GOLD_SQL} SELECT count(*) AS n, round(avg((answer = gold)::INT), 9) AS p, round(sqrt(avg((answer = gold)::INT) * (1 - avg((answer = gold)::INT)) / count(*)), 9) AS se FROM won JOIN g USING (id)",
)
def marginal_se(spark, d):
    hit = (F.col("answer") == F.col("gold")).cast("int")
    p = F.avg(hit)
    return votes.weighted(ballots(spark, d)).join(gold(spark, d), "id").agg(F.count("*").alias("n"), F.round(p, 9).alias("p"), F.round(F.sqrt(p * (1 - p) / F.count("*")), 9).alias("se"))


@query(
    "paired_seed_gate",
    f"WITH {GOLD_SQL}, w AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {k} AS seed, * FROM ({of_seed(RULE_SQL[r], k)})" for r in ("majority", "trim25") for k in range(3)) + "), "
    "c AS (SELECT seed, sum((rule = 'majority' AND answer = gold)::INT)::BIGINT AS base, sum((rule = 'trim25' AND answer = gold)::INT)::BIGINT AS new FROM w JOIN g USING (id) GROUP BY seed) "
    "SELECT seed::BIGINT AS seed, base, new, new - base AS gain, min(new - base) OVER () > 0 AND avg(new - base) OVER () >= 3 AS accepted FROM c",
)
def paired_seed_gate(spark, d):
    return systems.paired_seed_gate(ballots(spark, d), gold(spark, d), "trim25", "majority")


@query(
    "corrected_rescore",
    f"WITH {A} SELECT system, count(*) AS n, sum(ok::INT)::BIGINT AS raw, sum(coalesce(answer = CASE WHEN id % 9 = 0 THEN CASE WHEN id % 18 = 0 THEN NULL ELSE '1' END ELSE gold END, false)::INT)::BIGINT AS corrected, sum(coalesce(answer = CASE WHEN id % 9 = 0 THEN CASE WHEN id % 18 = 0 THEN NULL ELSE '1' END ELSE gold END, false)::INT) >= 383 AS passed FROM s GROUP BY system",
)
def corrected_rescore(spark, d):
    key = gold(spark, d).filter("id % 9 = 0").select("id", F.when(F.col("id") % 18 != 0, "1").alias("truth"))
    return systems.corrected(by_seed(spark, d), key, 383)


def sharesql(name: str, where: str) -> str:
    return f"""{name}0 AS (SELECT * FROM j WHERE {where}), {SHIFT.format(name + '1', name + '0')}, {name}2 AS (SELECT id, gold, ans, sum(exp(shift * 2)) AS w, count(*) AS n, min(pos) AS f FROM {name}1 WHERE ans IS NOT NULL GROUP BY ALL),
  {name} AS (SELECT id, coalesce(sum(w) FILTER (ans = gold), 0) / sum(w) AS gs, coalesce(max(w) FILTER (ans <> gold), 0) / sum(w) AS ws, coalesce(arg_max(ans, ROW(n, -f)) = any_value(gold), false) AS ok FROM {name}2 GROUP BY id)"""


@query(
    "strata_gate",
    f"""WITH {BG}, {sharesql('x', "system = 'O'")}, {sharesql('y', "system = 'F'")}
  SELECT id % 3 AS stratum, count(*) AS n, round(avg(round(y.gs, 6) - round(x.gs, 6)), 6) + 0.0 AS gold_change, round(avg(round(y.ws, 6) - round(x.ws, 6)), 6) + 0.0 AS wrong_change, sum(y.ok::INT - x.ok::INT)::BIGINT AS net, sum((x.ok AND NOT y.ok)::INT)::BIGINT AS harm,
  round(avg(round(y.gs, 6) - round(x.gs, 6)), 6) > 0 AND round(avg(round(y.ws, 6) - round(x.ws, 6)), 6) < 0 AND sum(y.ok::INT - x.ok::INT) >= 2 AND sum((x.ok AND NOT y.ok)::INT) <= 2 AS go FROM x JOIN y USING (id) GROUP BY id % 3""",
)
def strata_gate(spark, d):
    b, g = ballots(spark, d), gold(spark, d)

    def side(s):
        own = b.filter(F.col("system") == s)
        ok = votes.majority(own, None).join(g, "id").select("id", F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).alias("ok"))
        return metrics.shares(own, g).join(ok, "id")

    return systems.strata_gate(side("O"), side("F"), g.select("id", (F.col("id") % 3).alias("stratum")))
