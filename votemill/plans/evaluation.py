"""Accuracy, ranks, shares, rewards and token confidence over the ballots of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import metrics, rewards, selector, sweeps, votes
from votemill.plans.registry import query
from votemill.plans.voting import RULE_SQL, SHIFT, W, of_seed
from votemill.sources.adapters import BALLOTS_SQL, GOLD_SQL, ballots, gold

BG = f"{BALLOTS_SQL}, {GOLD_SQL}, j AS (SELECT b.*, gold, category, coalesce(ans = gold, false) AS hit FROM b JOIN g USING (id))"
TALLY = "t AS (SELECT id, gold, ans, count(*) AS n, min(pos) AS f FROM j WHERE ans IS NOT NULL GROUP BY id, gold, ans), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS r FROM t)"


def both(spark, d):
    return ballots(spark, d), gold(spark, d)


@query("pass_at_n", f"WITH {BG}, a AS (SELECT id, min(CASE WHEN hit THEN pos END) AS at_ FROM j GROUP BY id) SELECT n, count(*) AS problems, sum(coalesce(at_ < n, false)::INT)::BIGINT AS passed FROM a, (VALUES (1), (2), (4), (8)) v(n) GROUP BY n")
def pass_at_n(spark, d):
    return metrics.pass_at_n(*both(spark, d))


@query("topk_hit", f"WITH {BG}, {TALLY}, a AS (SELECT id, min(CASE WHEN ans = gold THEN r END) AS at_ FROM k GROUP BY id) SELECT k, count(*) AS problems, sum(coalesce(at_ <= k, false)::INT)::BIGINT AS hits FROM a, (VALUES (1), (2), (3), (5)) v(k) GROUP BY k")
def topk_hit(spark, d):
    return metrics.topk_hits(*both(spark, d))


@query(
    "diversity",
    f"""WITH {BALLOTS_SQL}, c AS (SELECT id, ans, count(*) AS n FROM b GROUP BY id, ans), p AS (SELECT id, count(ans) AS d, max(n) FILTER (ans IS NOT NULL) AS top, sum(n) FILTER (ans IS NOT NULL) AS every FROM c GROUP BY id)
  SELECT count(*) AS problems, round(avg(d) FILTER (every > 0), 9) AS distinct_avg, round(avg(top / every), 9) AS top1_share, count(*) FILTER (coalesce(every, 0) = 0) AS no_answer FROM p""",
)
def diversity(spark, d):
    return metrics.diversity(ballots(spark, d))


@query(
    "truncation_report",
    f"""WITH {BG}, p AS (SELECT id, bool_or(hit) AS h, bool_or(trunc) AS t, bool_and(trunc) AS a FROM j GROUP BY id),
  x AS (SELECT round(avg(trunc::INT), 9) AS rate, round(avg(trunc::INT) FILTER (hit), 9) AS rate_right, round(avg(trunc::INT) FILTER (NOT hit), 9) AS rate_wrong FROM j)
  SELECT x.*, (SELECT count(*) FROM p WHERE NOT h AND t) AS recoverable, (SELECT count(*) FROM p WHERE h OR t) AS ceiling, (SELECT count(*) FROM p WHERE a) AS all_truncated FROM x""",
)
def truncation_report(spark, d):
    return metrics.truncation(*both(spark, d))


@query(
    "answer_tally",
    f"""WITH {BALLOTS_SQL}, {SHIFT.format('s', 'b')}, t AS (SELECT id, ans, min(pos) AS first, count(*) AS votes, round(sum(exp(shift * 2)), 9) AS weight, round(sum(logp), 6) AS logp_sum, sum("len")::BIGINT AS len_sum, sum(trunc::INT)::BIGINT AS n_trunc FROM s WHERE ans IS NOT NULL GROUP BY id, ans)
  SELECT * REPLACE (round(weight, 6) AS weight), row_number() OVER ({W} ORDER BY t.weight DESC, first)::INT AS rank FROM t""",
)
def answer_tally(spark, d):
    return metrics.ranked_answers(ballots(spark, d), "weight").withColumn("weight", F.round("weight", 6))


@query(
    "region_counts",
    f"WITH {BG}, {TALLY}, p AS (SELECT id, max(CASE WHEN hit THEN 1 ELSE 0 END) AS has FROM j GROUP BY id) SELECT CASE WHEN k.ans = k.gold THEN 'vote_correct' WHEN has = 1 THEN 'recoverable' ELSE 'no_correct' END AS region, count(*) AS problems FROM p LEFT JOIN k ON p.id = k.id AND k.r = 1 GROUP BY 1",
)
def region_counts(spark, d):
    return metrics.regions(*both(spark, d))


@query(
    "share_stats",
    f"""WITH {BG}, {SHIFT.format('s', 'j')}, t AS (SELECT id, gold, ans, sum(exp(shift * 2)) AS w FROM s WHERE ans IS NOT NULL GROUP BY ALL)
  SELECT id, round(coalesce(sum(w) FILTER (ans = gold), 0) / sum(w), 6) AS gold_share, round(coalesce(max(w) FILTER (ans <> gold), 0) / sum(w), 6) AS wrong_share, count(*) AS n_unique FROM t GROUP BY id""",
)
def share_stats(spark, d):
    return metrics.shares(*both(spark, d))


PER_SEED = """v AS (SELECT seed, category, id, gold, ans, count(*) AS n, min(pos) AS f FROM j GROUP BY ALL), q AS (SELECT seed, category, id, gold, arg_max(ans, ROW(n, -f)) FILTER (ans IS NOT NULL) AS answer, bool_or(coalesce(ans = gold, false)) AS has FROM v GROUP BY seed, category, id, gold)"""


@query(
    "category_accuracy",
    f"WITH {BG}, {PER_SEED} SELECT coalesce(category, 'ALL') AS category, coalesce(seed, -1) AS seed, count(*) AS problems, sum(coalesce(answer = gold, false)::INT)::BIGINT AS correct, sum(has::INT)::BIGINT AS passed FROM q GROUP BY ROLLUP (category, seed)",
)
def category_accuracy(spark, d):
    return metrics.category_accuracy(*both(spark, d))


@query(
    "cum_failures",
    f"""WITH {BG}, p AS (SELECT category, id, bool_or(hit) AS h FROM j GROUP BY category, id), f AS (SELECT category, sum((NOT h)::INT)::BIGINT AS failures FROM p GROUP BY category)
  SELECT category, failures, round(sum(failures) OVER (ORDER BY failures DESC, category ROWS UNBOUNDED PRECEDING) / sum(failures) OVER (), 9) AS cum_share FROM f""",
)
def cum_failures(spark, d):
    return metrics.cumulative_failures(*both(spark, d))


RULES = ("majority", "weighted2", "trim25", "drop_trunc")


@query(
    "category_rule_stability",
    f"WITH {GOLD_SQL}, w AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {k} AS seed, * FROM ({of_seed(RULE_SQL[r], k)})" for r in RULES for k in range(3)) + "), "
    "c AS (SELECT category, rule, seed, sum((answer = gold)::INT)::BIGINT AS correct FROM w JOIN g USING (id) GROUP BY ALL), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY category, seed ORDER BY correct DESC, rule) = 1) "
    "SELECT category, min(rule) AS winner, count(DISTINCT rule) = 1 AS stable, sum(correct)::BIGINT AS correct FROM t GROUP BY category",
)
def category_rule_stability(spark, d):
    return sweeps.category_stability(*both(spark, d), RULES)


@query(
    "error_homogeneity",
    f"""WITH {BG}, t AS (SELECT id, gold, ans, min(pos) AS f, count(*) AS n, stddev_samp("len") / avg("len") AS cv, stddev_samp(logp) AS sd FROM j WHERE ans IS NOT NULL GROUP BY id, gold, ans),
  k AS (SELECT *, row_number() OVER ({W} ORDER BY n DESC, f) AS r FROM t), q AS (SELECT *, CASE WHEN ans = gold THEN 'gold' WHEN r = 1 THEN 'wrong_winner' END AS kind FROM k WHERE n >= 2)
  SELECT kind, count(*) AS groups, round(avg(cv), 6) AS len_cv, round(avg(sd), 6) AS logp_sd FROM q WHERE kind IS NOT NULL GROUP BY kind""",
)
def error_homogeneity(spark, d):
    return metrics.homogeneity(*both(spark, d))


@query("right_histogram", f"WITH {BG}, p AS (SELECT id, sum(hit::INT)::BIGINT AS n_right FROM j GROUP BY id) SELECT n_right, count(*) AS problems FROM p GROUP BY n_right")
def right_histogram(spark, d):
    return metrics.histogram(*both(spark, d))


@query(
    "logp_moments",
    f"""WITH {BALLOTS_SQL}, s AS (SELECT *, count(*) OVER ({W}) AS size FROM b) SELECT size, round(avg(logp), 9) AS mean, round(var_pop(logp), 9) AS var_pop, round(stddev_samp(logp), 9) AS sd, round(stddev_pop(logp), 9) AS pstdev, round(corr(logp, "len"), 6) AS corr FROM s GROUP BY size HAVING count(*) > 20""",
)
def logp_moments(spark, d):
    out = metrics.moments(ballots(spark, d).withColumn("one", F.lit(1)))
    sizes = ballots(spark, d).groupBy("id").agg(F.count("*").alias("size")).groupBy("size").agg((F.count("*") * F.col("size")).alias("rows")).filter("rows > 20")
    return out.join(F.broadcast(sizes.select("size")), "size")  # a row for each size of a problem


@query("length_quantile", f"""WITH {BALLOTS_SQL}, s AS (SELECT "len" AS l, row_number() OVER (ORDER BY "len") - 1 AS i, count(*) OVER () AS n FROM b) SELECT max(l) AS quantile, max(n) AS n FROM s WHERE i = floor(n * 0.9)""")
def length_quantile(spark, d):
    return metrics.index_quantile(ballots(spark, d), "len", 0.9)


@query(
    "auc_global",
    f"""WITH {BG}, v AS (SELECT round(logp, 6) AS s, hit FROM j WHERE ans IS NOT NULL), k AS (SELECT s, hit, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM v)
  SELECT sum(hit::INT)::BIGINT AS n_pos, sum((NOT hit)::INT)::BIGINT AS n_neg, round((sum(r) FILTER (hit) - sum(hit::INT) * (sum(hit::INT) + 1) / 2.0) / (sum(hit::INT) * sum((NOT hit)::INT)), 9) AS auc FROM k""",
)
def auc_global(spark, d):
    b, g = both(spark, d)
    return metrics.auc(b.filter(votes.valid()).join(g, "id").withColumn("s", F.round("logp", 6)), "s", metrics.right())


@query(
    "auc_paired",
    f"""WITH {BG}, v AS (SELECT id, round(logp, 6) AS s, hit FROM j WHERE ans IS NOT NULL), p AS (SELECT a.id, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM v a JOIN v b ON a.id = b.id AND a.hit AND NOT b.hit GROUP BY a.id)
  SELECT count(*) AS problems, round(avg(auc), 9) AS auc FROM p""",
)
def auc_paired(spark, d):
    b, g = both(spark, d)
    per = metrics.auc(b.filter(votes.valid()).join(g, "id").withColumn("s", F.round("logp", 6)), "s", metrics.right(), ("id",))
    return per.filter("auc IS NOT NULL").agg(F.count("*").alias("problems"), F.round(F.avg("auc"), 9).alias("auc"))


CURVE = f"""WITH {BG}, {TALLY}, p AS (SELECT id, gold, max(CASE WHEN r = 1 THEN ans END) AS a, max(CASE WHEN r = 2 THEN ans END) AS b, max(CASE WHEN r = 1 THEN n END) - max(CASE WHEN r = 2 THEN n END) AS gap FROM k GROUP BY id, gold),
  q AS (SELECT id, -gap AS score, (a <> gold AND b = gold)::INT AS rescued, (a = gold AND b <> gold)::INT AS harmed FROM p WHERE b IS NOT NULL),
  c AS (SELECT *, row_number() OVER o AS k, sum(rescued) OVER o AS rescued_cum, sum(harmed) OVER o AS harmed_cum FROM q WINDOW o AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))"""


def contested(spark, d):
    b, g = both(spark, d)
    k = metrics.ranked_answers(b).join(g, "id").filter("rank <= 2")
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    p = k.groupBy("id", "gold").agg(pick(1, "ans").alias("a"), pick(2, "ans").alias("b"), (pick(1, "votes") - pick(2, "votes")).alias("gap")).filter("b IS NOT NULL")
    return p.select("id", (-F.col("gap")).alias("score"), ((F.col("a") != F.col("gold")) & (F.col("b") == F.col("gold"))).cast("int").alias("rescued"), ((F.col("a") == F.col("gold")) & (F.col("b") != F.col("gold"))).cast("int").alias("harmed"))


@query("net_gain_curve", f"{CURVE} SELECT id, k, rescued_cum::BIGINT AS rescued_cum, harmed_cum::BIGINT AS harmed_cum, (rescued_cum - harmed_cum)::BIGINT AS net FROM c")
def net_gain_curve(spark, d):
    return metrics.gain_curve(contested(spark, d), "score").select("id", "k", "rescued_cum", "harmed_cum", "net")


@query("precision_at_k", f"{CURVE} SELECT k, rescued_cum::BIGINT AS rescued, round(rescued_cum / k, 9) AS precision FROM c WHERE k IN (10, 25, 50, 100, 250)")
def precision_at_k(spark, d):
    return metrics.gain_curve(contested(spark, d), "score").filter(F.col("k").isin(10, 25, 50, 100, 250)).select("k", F.col("rescued_cum").alias("rescued"), F.round(F.col("rescued_cum") / F.col("k"), 9).alias("precision"))


ADV = f"""{BG}, r AS (SELECT *, hit::INT::DOUBLE AS reward FROM j), m AS (SELECT *, avg(reward) OVER ({W}) AS mu, stddev_pop(reward) OVER ({W}) AS sd FROM r),
  a AS (SELECT *, CASE WHEN sd > 1e-12 THEN (reward - mu) / (sd + 1e-8) ELSE 0 END AS adv FROM m)"""


@query("grpo_advantage", f"WITH {ADV} SELECT id, pos, reward, round(adv, 6) AS advantage FROM a")
def grpo_advantage(spark, d):
    return rewards.grpo(*both(spark, d)).select("id", "pos", "reward", F.round("advantage", 6).alias("advantage"))


@query(
    "edas_shaping",
    f"""WITH {ADV}, w AS (SELECT *, coalesce(ans, 'NONE') AS cls FROM a WHERE reward = 0), c AS (SELECT *, count(*) OVER (PARTITION BY id, cls) AS nc, count(*) OVER ({W}) AS nw, avg(abs(adv)) OVER ({W}) AS s, min(cls) OVER ({W}) = max(cls) OVER ({W}) AS one FROM w),
  e AS (SELECT id, -sum(p * ln(p)) AS h FROM (SELECT DISTINCT id, cls, nc / nw AS p FROM c) GROUP BY id),
  d AS (SELECT c.*, CASE WHEN nw <= 1 THEN 0 WHEN one THEN -0.2 * s ELSE 0.4 * s * (-ln(nc / nw) - h) / ln(nw) END AS delta FROM c JOIN e USING (id))
  SELECT id, pos, round(adv, 6) AS advantage, round(adv + sign(delta) * least(abs(delta), abs(adv) / 2.0), 6) AS shaped FROM d UNION ALL SELECT id, pos, round(adv, 6), round(adv, 6) FROM a WHERE reward <> 0""",
)
def edas_shaping(spark, d):
    return rewards.edas(rewards.grpo(*both(spark, d)))


@query(
    "sc_marginal_credit",
    f"""WITH {BG}, c AS (SELECT id, ans, count(*) AS n, bool_or(hit) AS is_gold FROM j WHERE ans IS NOT NULL GROUP BY id, ans),
  m AS (SELECT id, coalesce(sum(n) FILTER (is_gold), 0) - coalesce(max(n) FILTER (NOT is_gold), 0) AS base FROM c GROUP BY id),
  w AS (SELECT a.id, a.ans, coalesce(sum(CASE WHEN x.is_gold THEN x.n - (x.ans = a.ans)::INT END), 0) - coalesce(max(CASE WHEN NOT x.is_gold THEN x.n - (x.ans = a.ans)::INT END), 0) AS less FROM c a JOIN c x USING (id) GROUP BY a.id, a.ans),
  r AS (SELECT j.id, j.pos, coalesce(m.base - w.less, 0)::DOUBLE AS credit FROM j LEFT JOIN m ON j.id = m.id LEFT JOIN w ON j.id = w.id AND j.ans = w.ans),
  z AS (SELECT *, avg(credit) OVER ({W}) AS mu, stddev_pop(credit) OVER ({W}) AS sd FROM r)
  SELECT id, pos, credit, round(CASE WHEN sd > 1e-12 THEN (credit - mu) / sd ELSE 0 END, 6) AS advantage FROM z""",
)
def sc_marginal_credit(spark, d):
    return rewards.marginal_credit(*both(spark, d))


TOKENS = 'k AS (SELECT *, list_transform(range(8), lambda i: logp * (1 + ((i * 7 + pos * 3 + "len") % 5) / 4.0)) AS tlp FROM b)'
MEAN = "list_sum({0}) / len({0})"
KEYS = {
    "worst": MEAN.format("list_sort(tlp)[1:greatest(1, floor(len(tlp) * 0.25)::INT)]"),
    "tail": MEAN.format("tlp[greatest(1, len(tlp) - 2):]"),
    "min": "list_min(tlp)",
}
for _key, _sql in KEYS.items():
    query(
        f"token_conf_vote_{_key}",
        f"""WITH {BALLOTS_SQL}, {TOKENS}, q AS (SELECT *, {_sql} AS key FROM k WHERE ans IS NOT NULL), s AS (SELECT *, key - max(key) OVER ({W}) AS shift FROM q), t AS (SELECT id, ans, min(pos) AS f, round(sum(exp(shift * 2)), 9) AS w FROM s GROUP BY id, ans),
  r AS (SELECT *, row_number() OVER ({W} ORDER BY w DESC, f) AS n FROM t) SELECT id, r.ans AS answer FROM (SELECT DISTINCT id FROM b) LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (id)""",
    )(lambda s, d, k=_key: rewards.token_vote(rewards.with_tokens(ballots(s, d)), {"worst": rewards.worst_mean(0.25), "tail": rewards.tail_mean(3), "min": F.array_min("tlp")}[k]))


@query("prefix_conf", f"WITH {BALLOTS_SQL}, {TOKENS}, q AS (SELECT *, row_number() OVER ({W} ORDER BY round({MEAN.format('tlp[1:3]')}, 9) DESC, pos) AS r FROM k WHERE ans IS NOT NULL) SELECT id, q.ans AS answer FROM (SELECT DISTINCT id FROM b) LEFT JOIN (SELECT * FROM q WHERE r = 1) q USING (id)")
def prefix_conf(spark, d):
    return rewards.prefix_pick(rewards.with_tokens(ballots(spark, d)), 3)


@query(
    "cdg_vote",
    f"""WITH {BALLOTS_SQL}, {TOKENS}, q AS (SELECT *, exp({MEAN.format('tlp')}) + exp(tlp[8]) - exp(tlp[1]) AS c FROM k WHERE ans IS NOT NULL), t AS (SELECT id, ans, min(pos) AS f, round(pow(count(*), 0.5) * avg(c), 9) AS w FROM q GROUP BY id, ans),
  r AS (SELECT *, row_number() OVER ({W} ORDER BY w DESC, f) AS n FROM t) SELECT id, r.ans AS answer FROM (SELECT DISTINCT id FROM b) LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (id)""",
)
def cdg_vote(spark, d):
    return rewards.dynamics_vote(rewards.with_tokens(ballots(spark, d)))


SWEEP_KEYS = {
    "worst05": MEAN.format("list_sort(tlp)[1:greatest(1, floor(len(tlp) * 0.05)::INT)]"),
    "worst25": KEYS["worst"],
    "tail3": KEYS["tail"],
    "min": KEYS["min"],
    "half": f"0.5 * logp + 0.5 * ({KEYS['worst']})",
}
SCALES = (0.5, 1.0, 2.0, 4.0)


@query(
    "token_conf_sweep",
    f"""WITH {BALLOTS_SQL}, {GOLD_SQL}, {TOKENS}, q AS ({' UNION ALL '.join(f"SELECT '{k}' AS key, id, pos, ans, {v} AS v FROM k WHERE ans IS NOT NULL" for k, v in SWEEP_KEYS.items())}),
  s AS (SELECT *, v - max(v) OVER (PARTITION BY id, key) AS shift FROM q), t AS (SELECT key, scale, id, ans, min(pos) AS f, round(sum(exp(shift * scale)), 9) AS w FROM s, (VALUES {', '.join(f'({x}::DOUBLE)' for x in SCALES)}) x(scale) GROUP BY ALL),
  w AS (SELECT key, scale, id, arg_max(ans, ROW(w, -f)) AS ans FROM t GROUP BY key, scale, id), c AS (SELECT key, scale, sum((ans = gold)::INT)::BIGINT AS correct FROM w JOIN g USING (id) GROUP BY ALL)
  SELECT key, scale, correct FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY correct DESC, scale) = 1""",
)
def token_conf_sweep(spark, d):
    b, g = both(spark, d)
    keys = {"worst05": rewards.worst_mean(0.05), "worst25": rewards.worst_mean(0.25), "tail3": rewards.tail_mean(3), "min": F.array_min("tlp"), "half": rewards.half_worst(0.25)}
    return rewards.token_sweep(rewards.with_tokens(b), g, keys, SCALES)


@query(
    "implicit_reward",
    f"""WITH {BALLOTS_SQL}, {SHIFT.format('h', 'b')}, r AS (SELECT *, (logp + score) * "len" / 100 AS s, (logp + score) * "len" / 100 / greatest(1, "len" // 40) AS m FROM h WHERE ans IS NOT NULL),
  e AS (SELECT *, exp(s - max(s) OVER ({W})) AS es, exp(m - max(m) OVER ({W})) AS em, exp(shift * 2) AS c FROM r),
  t AS (SELECT id, ans, min(pos) AS f, max(ROW(round(s, 9), -pos)) AS bs, max(ROW(round(m, 9), -pos)) AS bm, round(sum(es), 9) AS vs, round(sum(em), 9) AS vm, round(sum(em * c), 9) AS vc FROM e GROUP BY id, ans)
  SELECT id, arg_max(ans, bs) AS sum_best, arg_max(ans, bm) AS mean_best, arg_max(ans, ROW(vs, -f)) AS sum_vote, arg_max(ans, ROW(vm, -f)) AS mean_vote, arg_max(ans, ROW(vc, -f)) AS mean_conf FROM t GROUP BY id""",
)
def implicit_reward(spark, d):
    n = F.col("len") / 100
    return rewards.implicit_reward(ballots(spark, d), F.col("logp") * n, -F.col("score") * n, F.floor(F.col("len") / 40))


EARLY = "exp({0})".format(MEAN.format("tlp[1 + floor(len(tlp) * 0.05)::INT:greatest(floor(len(tlp) * 0.15)::INT, floor(len(tlp) * 0.05)::INT + 1)]"))


@query(
    "dynamics_rules",
    f"""WITH {BALLOTS_SQL}, {TOKENS}, q AS (SELECT *, exp({MEAN.format('tlp')}) AS c, exp({MEAN.format('tlp')}) + exp(tlp[8]) - exp(tlp[1]) AS g, exp(tlp[8]) - {EARLY} AS s FROM k WHERE ans IS NOT NULL),
  t AS (SELECT id, ans, min(pos) AS f, round(sqrt(count(*)) * avg(c), 9) AS s1, round(sqrt(count(*)) * avg(g), 9) AS s2, round(avg(s), 9) AS s3, round(sqrt(count(*)) * avg(s), 9) AS s4 FROM q GROUP BY id, ans)
  SELECT id, arg_max(ans, ROW(s1, -f)) AS sqrt_conf, arg_max(ans, ROW(s2, -f)) AS cdg, arg_max(ans, ROW(s3, -f)) AS consilience, arg_max(ans, ROW(s4, -f)) AS consilience_sqrt FROM t GROUP BY id""",
)
def dynamics_rules(spark, d):
    return rewards.dynamics_rules(rewards.with_tokens(ballots(spark, d)))


@query(
    "gap_correlation",
    f"""WITH {BG}, t AS (SELECT id, ans, ans = gold AS ok, count(*) AS n, min(pos) AS f, avg("len") AS l, avg(logp) AS v FROM j WHERE ans IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id, ok ORDER BY n DESC, f) AS r FROM t),
  p AS (SELECT a.l - b.l AS x, a.v - b.v AS y FROM k a JOIN k b ON a.id = b.id AND a.ok AND NOT b.ok AND a.r = 1 AND b.r = 1 AND a.n >= 2 AND b.n >= 2) SELECT count(*) AS problems, round(avg(x), 6) AS length_gap, round(avg(y), 6) AS value_gap, round(corr(x, y), 6) AS correlation FROM p""",
)
def gap_correlation(spark, d):
    return metrics.gap_correlation(*both(spark, d))


def tally_sql(name: str, keys: str) -> str:
    return (
        f"{name}0 AS (SELECT *, logp - max(CASE WHEN ans IS NOT NULL THEN logp END) OVER (PARTITION BY {keys}) AS shift FROM b), "
        f"{name}1 AS (SELECT {keys}, ans, min(pos) AS f, round(sum(exp(shift * 2)), 9) AS w, count(*) AS c, avg(logp) AS lp, var_pop(logp) AS lv, avg(\"len\") AS ln, sum(trunc::INT) AS tr FROM {name}0 WHERE ans IS NOT NULL GROUP BY ALL), "
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY w DESC, f) AS k, sum(w) OVER (PARTITION BY {keys}) AS tw, sum(c) OVER (PARTITION BY {keys}) AS tc, count(*) OVER (PARTITION BY {keys}) AS u FROM {name}1)"
    )


FEATURE_SQL = {
    "w_share1": "x.w / x.tw", "w_share2": "y.w / x.tw", "w_gap": "(x.w - y.w) / x.tw", "w_ratio": "y.w / x.w", "c_share1": "x.c / x.tc", "c_gap": "(x.c - y.c) / x.tc", "n_distinct": "x.u / n.n",
    "lp1_mean": "x.lp", "lp2_mean": "y.lp", "lp_gap": "x.lp - y.lp", "lp1_var": "x.lv", "len1_mean": "x.ln / 2048", "len2_mean": "y.ln / 2048", "len_gap": "(x.ln - y.ln) / 2048", "trunc1": "x.tr / x.c", "trunc2": "y.tr / y.c", "seed_agree": "coalesce(s.agree, 0.5)",
}


@query(
    "meta_features",
    f"""WITH {BALLOTS_SQL}, {tally_sql('t', 'id')}, {tally_sql('o', 'seed, id')}, n AS (SELECT id, count(*) AS n FROM b GROUP BY id), s AS (SELECT o.id, avg((o.ans = t.ans)::INT) AS agree FROM o JOIN t ON o.id = t.id AND o.k = 1 AND t.k = 1 GROUP BY o.id)
  SELECT x.id, x.ans AS a1, y.ans AS a2, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in FEATURE_SQL.items())} FROM t x JOIN t y ON x.id = y.id AND x.k = 1 AND y.k = 2 JOIN n ON n.id = x.id LEFT JOIN s ON s.id = x.id""",
)
def meta_features(spark, d):
    """Contrast of the two heaviest answers of each contested problem."""
    return selector.features(ballots(spark, d))


@query("seed_agreement", f"WITH {BALLOTS_SQL}, {tally_sql('t', 'id')}, {tally_sql('o', 'seed, id')} SELECT o.id, round(avg((o.ans = t.ans)::INT), 6) AS agree FROM o JOIN t ON o.id = t.id AND o.k = 1 AND t.k = 1 GROUP BY o.id")
def seed_agreement(spark, d):
    b = ballots(spark, d)
    top = selector.tally(b).filter("k = 1").select("id", F.col("ans").alias("a1"))
    return selector.agreement(b, top).select("id", F.round("agree", 6).alias("agree"))
