"""Selections, slices, compliance and score functions over the ballots of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.functions import text as T
from votemill.functions import sql as functions_sql
from votemill.operators import rewards, selection
from votemill.plans import corpus as corpus_plans
from votemill.plans.corpus import CASCADE
from votemill.plans.evaluation import BG, TALLY, TOKENS
from votemill.plans.registry import query
from votemill.plans.texts import ASKED, EXTRACT, SOLUTIONS, questions, solutions, topic_sql
from votemill.plans.voting import RULE_SQL
from votemill.sources.adapters import BALLOTS_SQL, ballots, gold, table
from votemill.streaming.ingest import running


@query("mid_difficulty", f"""WITH {BG}, r AS (SELECT id, count(*) AS n FROM j WHERE hit GROUP BY id) SELECT g.id, coalesce(n, 0) AS "right", coalesce(n, 0) BETWEEN 1 AND 2 AS first FROM g LEFT JOIN r USING (id) ORDER BY first DESC, md5('11|' || g.id), g.id LIMIT 9000""")
def mid_difficulty(spark, d):
    return selection.mid_difficulty(ballots(spark, d), gold(spark, d), 9000)


@query(
    "recoverable_set",
    f"""WITH {BG}, {TALLY}, p AS (SELECT id, gold, max(CASE WHEN r = 1 THEN ans END) AS answer, coalesce(sum(n) FILTER (ans = gold), 0)::BIGINT AS "right", coalesce(sum(n) FILTER (ans <> gold), 0)::BIGINT AS wrong FROM k GROUP BY id, gold) SELECT * FROM p WHERE answer <> gold AND "right" >= 2 AND wrong >= 2 ORDER BY id LIMIT 50""",
)
def recoverable_set(spark, d):
    return selection.recoverable(ballots(spark, d), gold(spark, d))


@query("consensus_failure", f"WITH {BALLOTS_SQL}, c AS (SELECT id, ans, count(*) AS n FROM b GROUP BY id, ans), t AS (SELECT id, coalesce(max(n) FILTER (ans IS NOT NULL), 0) AS top FROM c GROUP BY id) SELECT * FROM t WHERE top <= 1")
def consensus_failure(spark, d):
    return selection.no_consensus(ballots(spark, d), 1)


@query("partial_filter", f'WITH {BALLOTS_SQL} SELECT id, pos FROM b WHERE NOT coalesce(CASE WHEN "len" % 3 = 0 THEN trunc END, false)')
def partial_filter(spark, d):
    return selection.complete_rows(ballots(spark, d).withColumn("partial", F.when(F.col("len") % 3 == 0, F.col("trunc")))).select("id", "pos")


@query("truncating_projection", "SELECT doc_id, left(text, 200) AS head, length(text) AS full_length FROM documents")
def truncating_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(200)).alias("head"), F.length("text").cast("long").alias("full_length"))


@query("worker_slice", "SELECT p_partkey AS id FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def worker_slice(spark, d):
    return selection.sliced(table(spark, d, "part").select(F.col("p_partkey").alias("id")), 100, 50)


@query(
    "ranking_compliance",
    f"""WITH {SOLUTIONS}, x AS (SELECT {EXTRACT} AS answer, list_distinct(list_transform(list_filter(list_transform(string_split(list_reverse(regexp_extract_all(text, 'RANKING\\s*[:：]\\s*(.+)', 1))[1], '>'), lambda x: replace(regexp_extract(x, '-?[0-9][0-9,]*'), ',', '')), lambda x: x <> ''), lambda x: x)) AS ranks,
  regexp_extract(list_reverse(regexp_extract_all(text, 'RANKING\\s*[:：]\\s*(.+)', 1))[1], '-?[0-9][0-9,]*') AS top FROM t)
  SELECT count(*) AS n, round(avg((coalesce(len(ranks), 0) > 0)::INT), 9) AS ranked, round(avg((coalesce(len(ranks), 0) >= 2)::INT), 9) AS two_or_more, round(avg((top <> answer)::INT) FILTER (len(ranks) > 0), 9) AS contradicts FROM x""",
)
def ranking_compliance(spark, d):
    rows = solutions(spark, d).select(T.parse_ranking(F.col("text")).alias("ranks"), T.extract_answer(F.col("text")).alias("answer"))
    return selection.compliance(rows, F.col("answer"))


@query(
    "low_confidence",
    f"""WITH {BALLOTS_SQL}, {TOKENS}, x AS (SELECT id, pos, list_filter(list_transform(tlp, lambda x, i: CASE WHEN x < -0.15 THEN (i - 1) / 8 END), lambda x: x IS NOT NULL) AS at_ FROM k) SELECT id, pos, round(len(at_) / 8, 6) AS share, round(list_stddev_pop(at_), 6) AS spread FROM x""",
)
def low_confidence(spark, d):
    return selection.low_confidence(rewards.with_tokens(ballots(spark, d)), -0.15)


@query("capped_subset", f"WITH {CASCADE} SELECT doc_id FROM c WHERE drop_reason IS NULL ORDER BY md5('5|' || doc_id), doc_id LIMIT 100")
def capped_subset(spark, d):
    return selection.capped_subset(corpus_plans.cascade(spark, d).filter("drop_reason IS NULL").select("doc_id"), 100)


@query("audit_tally", "WITH s AS (SELECT doc_id, quality FROM labels ORDER BY md5('3|' || doc_id), doc_id LIMIT 60) SELECT CASE quality WHEN 1 THEN 'GOLD_WRONG' ELSE 'TEACHER_WRONG' END AS verdict, count(*) AS n FROM s GROUP BY 1")
def audit_tally(spark, d):
    rows = selection.capped_subset(table(spark, d, "labels").select("doc_id", "quality"), 60, "3")
    return rows.groupBy(F.when(F.col("quality") == 1, "GOLD_WRONG").otherwise("TEACHER_WRONG").alias("verdict")).agg(F.count("*").alias("n"))


@query("softmax_entropy", f"WITH {BALLOTS_SQL}, e AS (SELECT id, exp((logp - max(logp) OVER (PARTITION BY id)) * 2) AS e FROM b), p AS (SELECT id, e / sum(e) OVER (PARTITION BY id) AS p FROM e) SELECT id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY id")
def softmax_entropy(spark, d):
    out = selection.entropy(selection.softmax(ballots(spark, d), "logp", 2.0))
    return out.withColumn("entropy", F.col("entropy") + 0.0)


@query("judge_vote", f"WITH {BALLOTS_SQL} SELECT id, CASE WHEN sum((pos % 3 = 1)::INT) > sum((pos % 3 = 0)::INT) THEN 'B' ELSE 'A' END AS winner FROM b GROUP BY id")
def judge_vote(spark, d):
    letters = F.element_at(F.array(F.lit("A is better"), F.lit(" b"), F.lit("tie")), F.col("pos") % 3 + 1)
    return selection.judge_vote(ballots(spark, d).select("id", letters.alias("letter")))


@query("contrastive_score", f"WITH {BALLOTS_SQL}, s AS (SELECT id, pos, CASE WHEN exp(logp * 20) >= 0.1 * exp(max(logp * 20) OVER (PARTITION BY id)) THEN 1.5 * (logp * 20) + 0.5 * score END AS score FROM b) SELECT id, pos, round(score, 6) + 0.0 AS score FROM s")
def contrastive_score(spark, d):
    rows = ballots(spark, d).select("id", "pos", (F.col("logp") * 20).alias("base"), (-F.col("score")).alias("amateur"))
    return selection.contrastive(rows).select("id", "pos", (F.round("score", 6) + 0.0).alias("score"))


@query("round_sums", f'WITH {BALLOTS_SQL} SELECT id, pos AS round, round(sum(logp) OVER w, 6) + 0.0 AS logp_sum, (sum("len") OVER w)::BIGINT AS len_sum FROM b WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)')
def round_sums(spark, d):
    out = running(ballots(spark, d).withColumnRenamed("pos", "round"))
    return out.select("id", "round", (F.round("logp_sum", 6) + 0.0).alias("logp_sum"), "len_sum")


@query(
    "specialist_router",
    f"""WITH {BG}, v AS (SELECT seed, system, id, gold, category, coalesce(arg_max(ans, ROW(n, -f)) FILTER (ans IS NOT NULL), '0') = gold AS ok FROM (SELECT seed, system, id, gold, category, ans, count(*) AS n, min(pos) AS f FROM j GROUP BY ALL) GROUP BY seed, system, id, gold, category),
  p AS (SELECT seed, category, id, max(ok::INT) FILTER (system = 'O') AS x, max(ok::INT) FILTER (system = 'F') AS y FROM v GROUP BY ALL), c AS (SELECT seed, category, count(*) AS n, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
  t AS (SELECT *, sum(y - x) OVER (PARTITION BY category) - (y - x) > 0 AS take FROM c) SELECT seed, sum(n)::BIGINT AS n, sum(x)::BIGINT AS base, sum(CASE WHEN take THEN y ELSE x END)::BIGINT AS routed, sum(take::INT)::BIGINT AS cells FROM t GROUP BY seed""",
)
def specialist_router(spark, d):
    return selection.router(ballots(spark, d), gold(spark, d), "O", "F")


def log_softmax_sql(source: str, columns: dict[str, str], keep: str) -> str:
    """source with each of columns as a log-softmax over its id."""
    tops = ", ".join(f"{v} AS {k}_, max({v}) OVER w AS {k}_top" for k, v in columns.items())
    return f"SELECT {keep}, {', '.join(f'{k}_ - {k}_top - ln(sum(exp({k}_ - {k}_top)) OVER w) AS {k}' for k in columns)} FROM (SELECT *, {tops} FROM {source} WINDOW w AS (PARTITION BY id)) WINDOW w AS (PARTITION BY id)"


@query(
    "nucleus_mix",
    f"""WITH {BALLOTS_SQL}, j AS (SELECT coalesce(c.id, u.id) AS id, coalesce(c.pos, u.pos) AS token, coalesce(c.logp * 20, -30.0) AS gx, coalesce(u.x, -30.0) AS fx
   FROM (SELECT * FROM b WHERE pos % 4 <> 3) c FULL JOIN (SELECT id, pos, -(score * 40) - other / 2 AS x FROM b WHERE pos % 4 <> 2) u ON c.id = u.id AND c.pos = u.pos),
  l AS ({log_softmax_sql('j', {'g': 'gx', 'f': 'fx'}, 'id, token')}), e AS (SELECT *, round(-sum(exp(g) * g) OVER (PARTITION BY id), 9) > 1.5 AS mixed FROM l),
  s AS ({log_softmax_sql('e', {'z': 'CASE WHEN mixed THEN -0.5 * f + 1.5 * g ELSE g END / 0.7'}, 'id, token, mixed')}), p AS (SELECT *, round(exp(z), 12) AS p FROM s),
  k AS (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) - p AS before FROM p)
  SELECT id, token, mixed, round(p / sum(p) OVER (PARTITION BY id), 6) AS p FROM k WHERE round(before, 9) <= 0.8""",
)
def nucleus_mix(spark, d):
    """What is left of each problem's ballots as tokens, with and without a condition."""
    b = ballots(spark, d).withColumn("token", F.col("pos"))
    given = b.filter("pos % 4 <> 3").select("id", "token", (F.col("logp") * 20).alias("x"))
    free = b.filter("pos % 4 <> 2").select("id", "token", (-(F.col("score") * 40) - F.col("other") / 2).alias("x"))
    return selection.nucleus(given, free).withColumn("p", F.round("p", 6))


def sample_arrays(spark, d):
    """id and the samples of each problem, as dumps hold them."""
    b = ballots(spark, d)
    packed = b.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ans", "logp", "trunc", "len"))).alias("s"))  # the samples of one problem
    return packed.select("id", F.transform("s", lambda x: F.struct(x["ans"].alias("ans"), x["logp"].alias("logp"), x["trunc"].alias("trunc"), x["len"].alias("len"))).alias("samples"))


@query(
    "sql_rules",
    f"""WITH m AS ({RULE_SQL['majority']}), w AS ({RULE_SQL['weighted2']}), t AS ({RULE_SQL['trim25_weighted']}), r AS ({RULE_SQL['drop_trunc']})
  SELECT m.id, m.answer AS majority, w.answer AS weighted, t.answer AS trimmed, r.answer AS complete FROM m JOIN w USING (id) JOIN t USING (id) JOIN r USING (id)""",
)
def sql_rules(spark, d):
    """Rules called in a query that is written in SQL."""
    functions_sql.register(spark)
    return spark.sql(
        """SELECT id, vote_majority(samples) AS majority, vote_weighted(samples, 2.0) AS weighted,
          vote_weighted(trim_lowconf(samples, 0.25), 2.0) AS trimmed, vote_majority(drop_truncated(samples)) AS complete FROM {dump}""",
        dump=sample_arrays(spark, d),
    )


@query(
    "sql_blocks",
    f"WITH {ASKED} SELECT id, (id % 3 + 1)::INT AS blocks, {topic_sql('text')} AS topic FROM t",
)
def sql_blocks(spark, d):
    """Blocks of texts by the table function, and the topics of their solutions."""
    functions_sql.register(spark)
    block = F.concat(F.lit("### ID: q"), F.col("id").cast("string"), F.lit("\n"), "text", F.lit("\n"))
    texts = questions(spark, d).select("id", F.concat(F.lit("intro\n"), F.repeat(block, (F.col("id") % 3 + 1).cast("int"))).alias("text"))
    return spark.sql("SELECT t.id, CAST(count(*) AS INT) AS blocks, min(topic_of(b.solution)) AS topic FROM {texts} t, LATERAL id_blocks(t.text) b GROUP BY t.id", texts=texts)
