"""Contract checks over a submission made from the ballots of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.operators import contracts, votes
from votemill.plans.registry import SQL, query
from votemill.plans.voting import OVERSIZED, RULE_SQL, oversized
from votemill.sources.adapters import BALLOTS_SQL, GOLD_SQL, ballots, gold

SUB = f"won AS ({RULE_SQL['weighted2']}), sub AS (SELECT id, CASE WHEN id % 501 = 0 THEN NULL WHEN id % 502 = 0 THEN '4.5' WHEN id % 503 = 0 THEN '9223372036854775808' ELSE answer END AS answer FROM won WHERE id % 97 <> 0 UNION ALL SELECT id + 10000000, answer FROM won WHERE id % 499 = 0 UNION ALL SELECT id, answer FROM won WHERE id % 997 = 1)"


def submission(spark, d):
    won, k = votes.weighted(ballots(spark, d)), F.col("id")
    bad = F.when(k % 501 == 0, F.lit(None)).when(k % 502 == 0, "4.5").when(k % 503 == 0, "9223372036854775808").otherwise(F.col("answer"))
    return won.filter(k % 97 != 0).select("id", bad.alias("answer")).unionByName(won.filter(k % 499 == 0).select((k + 10000000).alias("id"), "answer")).unionByName(won.filter(k % 997 == 1))


@query(
    "submission_report",
    f"""WITH {GOLD_SQL}, {SUB}, i AS (SELECT id, count(*) AS n FROM sub GROUP BY id), w AS (SELECT DISTINCT id FROM g), c AS (SELECT sum(coalesce(n, 0)) AS rows, sum(greatest(coalesce(n, 0) - 1, 0)) AS dup, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (w.id IS NULL) AS extra, count(w.id) AS wanted FROM i FULL JOIN w ON i.id = w.id),
  v AS (SELECT count(*) FILTER (answer IS NULL) AS blank, count(*) FILTER (NOT regexp_full_match(answer, '-?[0-9]+')) AS not_int, count(*) FILTER (regexp_full_match(answer, '-?[0-9]+') AND TRY_CAST(answer AS BIGINT) IS NULL) AS oversize, avg(CASE WHEN answer = '0' THEN 1 ELSE 0 END) AS zeros FROM sub),
  r AS (SELECT unnest([{{'check': 'header', 'level': 'OK', 'value': 1.0}}, {{'check': 'rows', 'level': CASE WHEN rows <> wanted THEN 'FAIL' ELSE 'OK' END, 'value': rows::DOUBLE}}, {{'check': 'duplicates', 'level': CASE WHEN dup > 0 THEN 'FAIL' ELSE 'OK' END, 'value': dup::DOUBLE}},
  {{'check': 'missing', 'level': CASE WHEN missing > 0 THEN 'FAIL' ELSE 'OK' END, 'value': missing::DOUBLE}}, {{'check': 'extra', 'level': CASE WHEN extra > 0 THEN 'FAIL' ELSE 'OK' END, 'value': extra::DOUBLE}}, {{'check': 'blank', 'level': CASE WHEN blank > 0 THEN 'FAIL' ELSE 'OK' END, 'value': blank::DOUBLE}},
  {{'check': 'not_int', 'level': CASE WHEN not_int > 0 THEN 'FAIL' ELSE 'OK' END, 'value': not_int::DOUBLE}}, {{'check': 'oversize', 'level': CASE WHEN oversize > 0 THEN 'FAIL' ELSE 'OK' END, 'value': oversize::DOUBLE}}, {{'check': 'zero_rate', 'level': CASE WHEN zeros > 0.08 THEN 'FAIL' WHEN zeros > 0.045 THEN 'WARN' ELSE 'OK' END, 'value': zeros::DOUBLE}}]) AS r FROM c, v)
  SELECT r.check AS "check", r.level AS level, round(r.value, 6) AS value FROM r""",
)
def submission_report(spark, d):
    return contracts.submission_report(submission(spark, d), gold(spark, d))


@query("submission_verdict", f"SELECT CASE WHEN bool_or(level = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) FILTER (level = 'FAIL') AS failures FROM ({SQL['submission_report']})")
def submission_verdict(spark, d):
    return contracts.verdict(contracts.submission_report(submission(spark, d), gold(spark, d)))


@query(
    "coverage_report",
    f"""WITH {BALLOTS_SQL}, {GOLD_SQL}, p AS (SELECT id, count(*) AS k FROM b GROUP BY id), z AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT id FROM g) x WHERE id NOT IN (SELECT id FROM p)) AS missing, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM g)) AS extra, (SELECT min(k) FROM p) AS least, (SELECT max(k) FROM p) AS most, (SELECT avg((ans IS NULL)::INT) FROM b) AS lost, (SELECT avg(trunc::INT) FROM b) AS cut, (SELECT count(*) FROM (SELECT id, pos FROM b GROUP BY ALL HAVING count(*) > 1)) AS twice)
  SELECT r.check AS "check", r.level AS level, round(r.value, 6) AS value FROM (SELECT unnest([{{'check': 'missing', 'level': CASE WHEN missing > 0 THEN 'FAIL' ELSE 'OK' END, 'value': missing::DOUBLE}}, {{'check': 'extra', 'level': CASE WHEN extra > 0 THEN 'FAIL' ELSE 'OK' END, 'value': extra::DOUBLE}}, {{'check': 'duplicates', 'level': CASE WHEN twice > 0 THEN 'FAIL' ELSE 'OK' END, 'value': twice::DOUBLE}}, {{'check': 'samples', 'level': CASE WHEN least <> most THEN 'FAIL' ELSE 'OK' END, 'value': least::DOUBLE}},
  {{'check': 'lost_answers', 'level': CASE WHEN lost > 0.01 THEN 'FAIL' ELSE 'OK' END, 'value': lost::DOUBLE}}, {{'check': 'truncation', 'level': CASE WHEN cut > 0.05 THEN 'WARN' ELSE 'OK' END, 'value': cut::DOUBLE}}]) AS r FROM z)""",
)
def coverage_report(spark, d):
    return contracts.dump_report(ballots(spark, d), gold(spark, d))


@query("prediction_diff", f"WITH x AS ({RULE_SQL['majority']}), y AS ({RULE_SQL['trim25']}) SELECT count(*) AS common, count(*) FILTER (x.answer <> y.answer) AS differ FROM x JOIN y USING (id)")
def prediction_diff(spark, d):
    b = ballots(spark, d)
    return contracts.prediction_diff(votes.RULES["majority"](b), votes.RULES["trim25"](b))


@query(
    "dump_warnings",
    f"""WITH {BALLOTS_SQL}, {GOLD_SQL}, {OVERSIZED}, p AS (SELECT g.id, count(o.pos) AS k, count(o.ans) AS v, count(TRY_CAST(o.ans AS BIGINT)) AS fit FROM g LEFT JOIN o ON g.id = o.id GROUP BY g.id),
  t AS (SELECT id, ans, count(*) AS n, min(pos) AS f FROM o GROUP BY ALL), m AS (SELECT id, arg_max(ans, ROW(n, -f)) FILTER (ans IS NOT NULL) AS a, arg_max(ans, ROW(n, -f)) FILTER (TRY_CAST(ans AS BIGINT) IS NOT NULL) AS s FROM t GROUP BY id),
  z AS (SELECT count(*) AS answers, count(*) FILTER (coalesce(CASE WHEN a IS NULL OR TRY_CAST(a AS BIGINT) IS NOT NULL THEN a ELSE s END, '0') = '0') AS zeros FROM m),
  c AS (SELECT count(*) FILTER (k = 0) AS empty, count(*) FILTER (k > 0 AND k < 3) AS short, count(*) FILTER (v > 0 AND fit = 0) AS oversized FROM p)
  SELECT r.check AS "check", r.level AS level, round(r.value, 6) AS value FROM (SELECT unnest([{{'check': 'empty', 'level': CASE WHEN empty > 0 THEN 'WARN' ELSE 'OK' END, 'value': empty::DOUBLE}}, {{'check': 'short', 'level': CASE WHEN short > 0 THEN 'WARN' ELSE 'OK' END, 'value': short::DOUBLE}},
  {{'check': 'all_oversized', 'level': CASE WHEN oversized > 0 THEN 'WARN' ELSE 'OK' END, 'value': oversized::DOUBLE}}, {{'check': 'zeros', 'level': CASE WHEN zeros > greatest(5, 0.02 * answers) THEN 'WARN' ELSE 'OK' END, 'value': zeros::DOUBLE}}]) AS r FROM c, z)""",
)
def dump_warnings(spark, d):
    return contracts.dump_warnings(oversized(ballots(spark, d)), gold(spark, d), 3)
