"""Resampling and iterative estimators over the ballots of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import resampling, retrieval, rewards, selector, sweeps, votes
from votemill.plans.evaluation import MEAN, TOKENS
from votemill.plans import registry
from votemill.plans.registry import query
from votemill.plans.systems import A as SYSTEMS
from votemill.plans.systems import by_seed
from votemill.plans.voting import RULE_SQL
from votemill.sources.adapters import BALLOTS_SQL, GOLD_SQL, ballots, gold, table


def correct(spark, d):
    won = votes.weighted(ballots(spark, d)).join(gold(spark, d), "id")
    return won.select("id", "category", (F.col("answer") == F.col("gold")).cast("double").alias("v"))


UNIFORM = "('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0"
HITS = f"won AS ({RULE_SQL['weighted2']}), {GOLD_SQL}, u AS (SELECT id, category, (answer = gold)::INT::DOUBLE AS v FROM won JOIN g USING (id))"
TRIALS = 2000


def parts_sql(source: str, n: int, seed: str, digits: int) -> str:
    """Rows of source by n replicates with hexadecimal digits h, several replicates an md5."""
    each = 32 // digits
    blocks = f"SELECT *, md5('{seed}|' || block || '|' || id) AS md5 FROM {source}, range({-(-n // each)}) t(block)"
    return f"SELECT * FROM (SELECT * EXCLUDE (md5), block * {each} + j AS rep, substr(md5, (j * {digits} + 1)::INT, {digits}) AS h FROM ({blocks}), range({each}) s(j)) WHERE rep < {n}"


@query(
    "bootstrap_ci",
    f"""WITH {HITS}, r AS ({parts_sql('u', TRIALS, 'b', 4)}), w AS (SELECT rep, v, {' + '.join(f"(h >= '{s}')::INT" for s in resampling.POISSON)} AS w FROM r),
  m AS (SELECT rep, sum(v * w) / sum(w) AS m FROM w GROUP BY rep), o AS (SELECT m, row_number() OVER (ORDER BY m, rep) - 1 AS i FROM m)
  SELECT count(*) AS n, round(avg(v), 6) AS mean, round((SELECT m FROM o WHERE i = {int(TRIALS * 0.025)}), 6) AS low, round((SELECT m FROM o WHERE i = {int(TRIALS * 0.975) - 1}), 6) AS high FROM u""",
)
def bootstrap_ci(spark, d):
    return resampling.bootstrap_ci(correct(spark, d), "v", TRIALS).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


#: Terms of a binomial distribution for k of m, and draws by inversion: the number of its running sums below u.
MASS = "exp(lgamma({0} + 1) - lgamma(k + 1) - lgamma({0} - k + 1) + k * ln({1}) + ({0} - k) * ln(1 - {1}))"


@query(
    "permutation_max",
    f"""WITH {HITS}, c AS (SELECT category AS cell, v, count(*) AS c FROM u GROUP BY ALL), o AS (SELECT max(m) AS m FROM (SELECT sum((v - 0.25) * c) / sum(c) AS m FROM c GROUP BY cell)),
  d AS (SELECT cell, v, k, sum({MASS.format('c', '0.5')}) OVER (PARTITION BY cell, v ORDER BY k) AS f FROM (SELECT *, unnest(range(c + 1)) AS k FROM c)),
  r AS (SELECT c.*, rep, {UNIFORM.format("'p|' || rep || '|' || cell || '|' || (v - 0.25)")} AS x FROM c, range({TRIALS}) t(rep)),
  k AS (SELECT r.cell, r.v, rep, any_value(c) AS c, count(*) FILTER (f < x) AS k FROM r JOIN d ON r.cell = d.cell AND r.v = d.v GROUP BY r.cell, r.v, rep),
  t AS (SELECT rep, max(m) AS top FROM (SELECT rep, cell, sum((v - 0.25) * (2 * k - c)) / sum(c) AS m FROM k GROUP BY rep, cell) GROUP BY rep)
  SELECT round(any_value(o.m), 6) AS observed, count(*) AS trials, round((count(*) FILTER (round(top, 12) >= round(o.m, 12)) + 1) / (count(*) + 1), 6) AS p FROM t, o""",
)
def permutation_max(spark, d):
    units = correct(spark, d).select("id", F.col("category").alias("cell"), (F.col("v") - 0.25).alias("v"))
    return resampling.permutation_max(units, TRIALS).select(F.round("observed", 6).alias("observed"), "trials", F.round("p", 6).alias("p"))


def normal_sql(p: str) -> str:
    """The rational approximation of the normal quantile, as in the operator."""

    def horner(coefficients, x: str) -> str:
        out = repr(coefficients[0])
        for k in coefficients[1:]:
            out = f"({out} * {x} + {k!r})"
        return out.replace("e-", "e-")

    a, b, c, d = resampling.NORMAL
    tail = lambda y: f"({horner(c, f'sqrt(-2 * ln({y}))')} / {horner(d, f'sqrt(-2 * ln({y}))')})"
    q = f"({p} - 0.5)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 1 - 0.02425 THEN -{tail(f'(1 - {p})')} ELSE {q} * {horner(a, f'({q} * {q})')} / {horner(b, f'({q} * {q})')} END"


def power_sql(trials: int = 4000) -> str:
    u = UNIFORM.format("concat_ws('|', 'w', rep, a, b, delta)")
    mass = "exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p))"
    return f"""WITH {SYSTEMS}, rates AS (SELECT x.system AS a, y.system AS b, count(*) AS n, avg((x.ok <> y.ok)::INT) AS d FROM s x JOIN s y ON x.id = y.id AND x.system < y.system GROUP BY ALL),
  grid AS (SELECT *, round_even(n * d, 0)::BIGINT AS m, 0.5 + delta / (2 * d) AS p FROM rates, (VALUES (0.005::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE)) t(delta)),
  tails AS (SELECT a, b, delta, coalesce(sum({mass}) FILTER (2 * k < m), 0) AS low, coalesce(sum({mass}) FILTER (2 * k > m), 0) AS high
   FROM (SELECT *, unnest(range(m + 1)) AS k FROM grid WHERE n * d >= 1 AND p < 1) WHERE abs(2 * k - m) - 1 > {resampling.CRITICAL} * sqrt(m) GROUP BY ALL),
  hits AS (SELECT a, b, delta, avg((u < low OR u >= 1 - high)::INT) AS power FROM (SELECT *, {u} AS u FROM tails, range({trials}) x(rep)) GROUP BY ALL)
  SELECT a, b, n, m AS discordant_pairs, delta, CASE WHEN n * d < 1 THEN 0 WHEN p < 1 THEN round(coalesce(power, 0), 6) END AS power FROM grid LEFT JOIN hits USING (a, b, delta)"""


@query("power_grid", power_sql())
def power_grid(spark, d):
    """Power of paired comparisons of every two systems, at the discordance that they have."""
    ok = by_seed(spark, d).select("id", "system", "ok")
    x, y = ok.toDF("id", "a", "x"), ok.toDF("id", "b", "y")
    pairs = x.join(y, "id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("x") != F.col("y")).cast("int")).alias("discordant"))  # pairs of systems, of which there are few
    return resampling.power(pairs).withColumn("power", F.round("power", 6))


@query("normal_quantiles", f"SELECT id, round({normal_sql('p')}, 9) + 0.0 AS z FROM (SELECT p_partkey AS id, (p_partkey % 997 + 0.5) / 997.0::DOUBLE AS p FROM part)")
def normal_quantiles(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 997 + F.lit(0.5)) / F.lit(997.0)).alias("p"))
    return parts.select("id", (F.round(resampling.normal_quantile(F.col("p")), 9) + 0.0).alias("z"))


@query(
    "vote_bootstrap",
    f"""WITH {BALLOTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY id) AS k FROM b WHERE ans IS NOT NULL),
  d AS (SELECT id, rep, i AS pos, floor({UNIFORM.format("'v|' || id || '|' || rep || '|' || i")} * k) AS at_ FROM v, range(200) t(rep)),
  s AS (SELECT d.id, rep, d.pos, ans, logp FROM d JOIN v ON d.id = v.id AND d.at_ = v.i), t AS (SELECT id, rep, ans, min(pos) AS f, round(sum(exp(logp * 2)), 9) AS w FROM s GROUP BY ALL),
  w AS (SELECT id, rep, arg_max(ans, ROW(w, -f)) AS ans FROM t GROUP BY id, rep), n AS (SELECT id, ans, count(*) AS n, min(rep) AS f FROM w GROUP BY id, ans) SELECT id, arg_max(ans, ROW(n, -f)) AS answer FROM n GROUP BY id""",
)
def vote_bootstrap(spark, d):
    return resampling.bootstrap_vote(ballots(spark, d), 200)


@query(
    "subset_mc",
    f"""WITH {BALLOTS_SQL}, {GOLD_SQL}, {TOKENS}, d AS (SELECT id, pos, ans, trunc, "len", rep, round({MEAN.format('tlp[1:3]')}, 9) AS p, row_number() OVER (PARTITION BY id, rep ORDER BY {UNIFORM.format("'s|' || rep || '|' || id || '|' || pos")}, pos) AS r FROM k, range(200) t(rep)),
  e AS (SELECT d.*, x.k FROM d, (VALUES (2), (3), (4)) x(k) WHERE r <= x.k), c AS (SELECT *, count(ans) OVER w AS n, min(pos) OVER w AS f FROM e WINDOW w AS (PARTITION BY id, rep, k, ans)),
  w AS (SELECT id, rep, k, coalesce(arg_max(ans, ROW(n, -f)) FILTER (ans IS NOT NULL), '0') AS majority, (list(ans ORDER BY trunc, "len", pos))[1] AS first_finish, arg_max(ans, ROW(p, -pos)) FILTER (ans IS NOT NULL) AS best_prefix FROM c GROUP BY ALL)
  SELECT k::INT AS k, count(*) AS trials, {', '.join(f'round(avg(coalesce({c} = gold, false)::INT), 9) AS {c}' for c in ('majority', 'first_finish', 'best_prefix'))} FROM w JOIN g USING (id) GROUP BY k""",
)
def subset_mc(spark, d):
    rows = rewards.with_tokens(ballots(spark, d))
    out = resampling.subset_accuracy(rows, gold(spark, d), rewards.mean_of(F.slice("tlp", 1, 3)))
    return out.select("k", "trials", *[F.round(c, 9).alias(c) for c in ("majority", "first_finish", "best_prefix")])


@query(
    "reranker_sim",
    f"""WITH {BALLOTS_SQL}, {GOLD_SQL}, u AS (SELECT b.id, pos, (ans = gold)::INT::DOUBLE AS ok, greatest(1e-9, {UNIFORM.format("'r|' || b.id || '|' || pos")}) AS u FROM b JOIN g ON b.id = g.id WHERE ans IS NOT NULL),
  s AS (SELECT *, round(z * ok + {normal_sql('u')}, 9) AS s FROM u, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) t(z)), t AS (SELECT z, id, arg_max(ok, ROW(s, -pos)) AS ok FROM s GROUP BY z, id)
  SELECT z, count(*) AS n, round(avg(ok), 9) AS accuracy FROM t GROUP BY z""",
)
def reranker_sim(spark, d):
    out = resampling.reranker(ballots(spark, d), gold(spark, d))
    return out.select("z", "n", F.round("accuracy", 9).alias("accuracy"))


NESTED = ("majority", "weighted2", "trim25", "drop_trunc", "prefer_short")


@query(
    "nested_cv",
    f"WITH {GOLD_SQL}, w AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, id, answer FROM ({RULE_SQL[r]})" for r in NESTED) + "), c AS (SELECT rule, id % 5 AS fold, sum((answer = gold)::INT)::BIGINT AS c, count(*) AS n FROM w JOIN g USING (id) GROUP BY ALL), "
    "r AS (SELECT *, sum(c) OVER (PARTITION BY rule) - c AS rest FROM c) SELECT fold::INT AS fold, rule, c AS correct, n FROM r QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rest DESC, rule) = 1",
)
def nested_cv(spark, d):
    won = sweeps.answers(ballots(spark, d), NESTED).join(gold(spark, d), "id")
    return resampling.nested_selection(won.select("id", "rule", (F.col("answer") == F.col("gold")).cast("long").alias("ok"), (F.col("id") % 5).cast("int").alias("fold")))


def newton_sql(folds: int = 5, inner: int = 4, nested: bool = False) -> str:
    """Fits of the two heads in SQL: x (standard scores), then for each step sums over rows and one elimination a fit; w<STEPS> has the weights."""
    size, columns = len(selector.COLUMNS) + 1, selector.COLUMNS
    scaled = ", ".join(f"(f.{c} - m_{c}) / CASE WHEN s_{c} > {selector.SAME} THEN s_{c} ELSE 1 END" for c in columns)
    pick = "[" + ", ".join(f"[{', '.join(f'h{min(i, j)}_{max(i, j)} / n' + (f' + {selector.L2}' if i == j else '') for j in range(size))}, g{i} / n + {selector.L2} * w[{i + 1}]]" for i in range(size)) + "]"
    at = "e[1][1]::INT"
    pivot = f"list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = {at} THEN list_transform(a[i], lambda v: v / a[i][i]) ELSE list_transform(list_zip(a[i], a[{at}]), lambda z: z[1] - a[i][{at}] / a[{at}][{at}] * z[2]) END)"
    solved = f"list_reduce([{pick}, {', '.join(f'[[{p}.0::DOUBLE]]' for p in range(1, size + 1))}], lambda a, e: {pivot})"
    fits = f"SELECT k::INT AS k, NULL::INT AS j FROM range({folds}) t(k)" + (f" UNION ALL SELECT k, j FROM range({folds}) t(k), range({inner}) s(j)" if nested else "")
    parts = [
        f"m AS ({registry.SQL['meta_features']})",
        "f AS (SELECT m.*, CASE WHEN a1 = gold THEN -1 WHEN a2 = gold THEN 1 ELSE 0 END AS u FROM m JOIN g USING (id))",
        f"st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in columns)} FROM f)",
        f"x AS MATERIALIZED (SELECT id, (id % {folds})::INT AS fold, ((id // {folds}) % {inner})::INT AS own, u, [{scaled}, 1.0]::DOUBLE[] AS x FROM f, st)",
        f"w0 AS (SELECT k, j, list_transform(range({size}), lambda i: 0.0::DOUBLE) AS w FROM ({fits}))",
    ]
    for t in range(selector.STEPS):
        h = ", ".join(f"sum(q * x[{i + 1}] * x[{j + 1}]) AS h{i}_{j}" for i in range(size) for j in range(i, size))
        g = ", ".join(f"sum((p - y) * x[{i + 1}]) AS g{i}" for i in range(size))
        margin = f"least(greatest(list_dot_product(x, w), -{selector.CLIP}), {selector.CLIP})"
        parts.append(f"p{t} AS (SELECT k, j, w, x, (u = 1)::INT AS y, 1 / (1 + exp(-{margin})) AS p, p * (1 - p) AS q FROM x JOIN w{t} ON fold <> k AND (j IS NULL OR own <> j) WHERE u <> 0)")
        parts.append(f"h{t} AS (SELECT k, j, any_value(w) AS w, count(*) AS n, {h}, {g} FROM p{t} GROUP BY k, j)")
        parts.append(f"w{t + 1} AS MATERIALIZED (SELECT k, j, list_transform(list_zip(w, {solved}), lambda z: z[1] - z[2][{size + 1}]) AS w FROM h{t})")
    score = f"round(2 / (1 + exp(-least(greatest(list_dot_product(x, w), -{selector.CLIP}), {selector.CLIP}))) - 1, 9)"
    parts.append(f"o AS (SELECT id, fold, u, {score} AS score FROM x JOIN w{selector.STEPS} ON fold = k AND j IS NULL)")
    if nested:
        parts.append(f"i AS (SELECT k, u, {score} AS score FROM x JOIN w{selector.STEPS} ON fold <> k AND own = j)")
        parts.append("c AS (SELECT k, cut, coalesce(sum(u) FILTER (floor(score * 1000) >= cut), 0) AS net FROM i JOIN (SELECT DISTINCT k, round(score * 1000) AS cut FROM i) USING (k) GROUP BY k, cut)")
        parts.append("b AS (SELECT k, CASE WHEN max(net) > 0 THEN arg_max(cut, (net, cut)) ELSE 1000 END AS cut FROM c GROUP BY k)")
    return f"WITH {GOLD_SQL}, {', '.join(parts)}"


@query("meta_selector", f"{newton_sql()} SELECT id, fold, u, round(score, 6) AS score FROM o")
def meta_selector(spark, d):
    """Out-of-fold P(rescue) - P(harm) of flipping each contested problem to its second answer."""
    rows = selector.utility(selector.features(ballots(spark, d)), gold(spark, d))
    return selector.two_heads(rows).select("id", "fold", "u", F.round("score", 6).alias("score"))


@query(
    "meta_selector_nested",
    f"""{newton_sql(nested=True)} SELECT fold, count(*) FILTER (score * 1000 >= cut) AS flips, count(*) FILTER (score * 1000 >= cut AND u = 1) AS rescued,
  count(*) FILTER (score * 1000 >= cut AND u = -1) AS harmed, coalesce(sum(u) FILTER (score * 1000 >= cut), 0)::BIGINT AS net FROM o JOIN b ON fold = k GROUP BY fold""",
)
def meta_selector_nested(spark, d):
    """What flipping brings, a fold, with the threshold chosen inside the other folds."""
    rows = selector.utility(selector.features(ballots(spark, d)), gold(spark, d))
    return selector.flips(selector.two_heads(rows, nested=True))


UNITS = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


@query(
    "replicator",
    f"""WITH RECURSIVE {UNITS}, m AS (SELECT vec_id // 16 AS id, list(v ORDER BY vec_id) AS vs, list(label ORDER BY vec_id) AS a FROM u GROUP BY ALL),
  s AS MATERIALIZED (SELECT id, a, list_transform(range(1, len(vs) + 1), lambda i: list_transform(range(1, len(vs) + 1), lambda j: CASE WHEN i = j THEN 0.0 ELSE greatest(list_dot_product(vs[i], vs[j]), 0.0) END)) AS s FROM m),
  r AS (SELECT id, 0 AS t, list_transform(a, lambda z: 1.0::DOUBLE / len(a)) AS x, false AS done FROM s UNION ALL
    SELECT id, t + 1, CASE WHEN total > 0 THEN list_transform(y, lambda z: z / total) ELSE x END, total <= 0 OR list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2] / total))) < 1e-10
    FROM (SELECT *, list_sum(y) AS total FROM (SELECT r.*, list_transform(range(1, len(x) + 1), lambda i: x[i] * list_dot_product(s[i], x)) AS y FROM r JOIN s USING (id) WHERE t < 300 AND NOT done))),
  e AS (SELECT id, arg_max(x, t) AS x FROM r GROUP BY id), p AS (SELECT id, unnest(x) AS x, unnest(a) AS a, unnest(range(len(a))) AS pos FROM e JOIN s USING (id)),
  b AS (SELECT id, a, round(sum(x), 9) AS mass, min(pos) AS f FROM p GROUP BY id, a) SELECT id, arg_max(a, (mass, -f)) AS answer FROM b GROUP BY id""",
)
def replicator(spark, d):
    v = retrieval.unit(table(spark, d, "embeddings")).select(F.floor(F.col("vec_id") / 16).alias("id"), F.col("label").alias("ans"), (F.col("vec_id") % 16).alias("pos"), "v")
    return resampling.replicator(v)
