"""Training-set operators over documents, labels, benchmark, conversations and the ballots of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from votemill.functions import text as T
from votemill.operators import corpus, packing, retrieval, votes
from votemill.plans.evaluation import BG
from votemill.plans.registry import query
from votemill.sources.adapters import ballots, gold, table

STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
TRIMMED = STRIP.format("text")
CASCADE = f"""h AS (SELECT DISTINCT {TRIMMED} AS k FROM benchmark), r AS (SELECT doc_id, source, {TRIMMED} AS k, CASE WHEN length({TRIMMED}) < 50 THEN 'too_short' WHEN length({TRIMMED}) > 3000 THEN 'too_long' WHEN NOT contains(text, '.') THEN 'no_sentence' WHEN {TRIMMED} IN (SELECT k FROM h) THEN 'contaminated' END AS reason FROM documents),
  c AS (SELECT doc_id, source, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY k, reason IS NULL ORDER BY doc_id) > 1 THEN 'duplicate' END) AS drop_reason FROM r)"""


def docs(spark, d):
    return table(spark, d, "documents")


def cascade(spark, d):
    return corpus.cascade(docs(spark, d), table(spark, d, "benchmark"))


def samples(spark, d):
    b = ballots(spark, d)
    return b.withColumn("text", F.concat(F.lit("step "), (F.col("len") % 7).cast("string"), F.lit(" gives \\boxed{"), F.coalesce("ans", F.lit("?")), F.lit("}")))


@query("corpus_cascade", f"WITH {CASCADE} SELECT * FROM c")
def corpus_cascade(spark, d):
    return cascade(spark, d)


@query("corpus_reject_report", f"WITH {CASCADE} SELECT coalesce(drop_reason, 'kept') AS reason, source, count(*) AS n FROM c GROUP BY ALL")
def corpus_reject_report(spark, d):
    return cascade(spark, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason"), "source").agg(F.count("*").alias("n"))


@query("exact_dedup", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {TRIMMED}")
def exact_dedup(spark, d):
    return corpus.exact_first(docs(spark, d))


@query("decontam_exact", f"SELECT doc_id FROM documents WHERE {TRIMMED} NOT IN (SELECT {TRIMMED} FROM benchmark)")
def decontam_exact(spark, d):
    return corpus.decontaminated(docs(spark, d), table(spark, d, "benchmark")).select("doc_id")


@query("hash_sample", "SELECT o_orderkey AS id FROM orders ORDER BY md5('123|' || o_orderkey), o_orderkey LIMIT 500")
def hash_sample(spark, d):
    return corpus.sample(gold(spark, d).select("id"), 500)


@query("holdout_split", "SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.05) AS held_out FROM documents")
def holdout_split(spark, d):
    return corpus.holdout(docs(spark, d).select(F.col("doc_id").alias("id"), "lang"), 0.05, keys=("lang",))


@query("fold_assignment", "SELECT o_orderkey AS id, (('0x' || substr(md5('7|' || o_orderkey), 1, 8))::BIGINT % 5)::INT AS fold FROM orders")
def fold_assignment(spark, d):
    return corpus.folds(gold(spark, d).select("id"), 5)


@query("balanced_sample", "WITH k AS (SELECT least(sum(quality), sum(1 - quality), 40) AS k FROM labels) SELECT doc_id AS id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS r FROM labels), k WHERE r <= k")
def balanced_sample(spark, d):
    return corpus.balanced(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "quality", 40)


@query("class_caps", "SELECT doc_id AS id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def class_caps(spark, d):
    return corpus.capped(docs(spark, d).select(F.col("doc_id").alias("id"), "source"), 20, ("source",))


RIGHT = f"WITH {BG}, s AS (SELECT *, 'step ' || (\"len\" % 7) || ' gives \\boxed{{' || coalesce(ans, '?') || '}}' AS text FROM j)"


@query("rft_select", f"{RIGHT}, h AS (SELECT id, left(text, 200) AS head, min(pos) AS pos FROM s WHERE hit GROUP BY ALL), r AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos)::INT AS k FROM h) SELECT * FROM r WHERE k <= 3")
def rft_select(spark, d):
    return corpus.rejection_sampled(samples(spark, d), gold(spark, d))


@query("marginal_band", f'{RIGHT}, r AS (SELECT id, pos, "len" AS len, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY "len", pos)::INT AS r FROM s WHERE hit) SELECT * FROM r WHERE n BETWEEN 1 AND 2 AND r <= 2')
def marginal_band(spark, d):
    return corpus.marginal(samples(spark, d), gold(spark, d))


@query("leak_check", f"{RIGHT}, v AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0), m AS (SELECT id FROM s WHERE hit GROUP BY id HAVING count(*) <= 2) SELECT count(*) AS leaks FROM m WHERE id IN (SELECT id FROM v)")
def leak_check(spark, d):
    chosen = corpus.marginal(samples(spark, d), gold(spark, d)).select("id").distinct()
    return chosen.join(gold(spark, d).filter("id % 10 = 0").select("id"), "id", "left_semi").agg(F.count("*").alias("leaks"))


@query(
    "dpo_pairs",
    f"""{RIGHT}, k AS (SELECT id, pos, hit, row_number() OVER (PARTITION BY id, hit ORDER BY CASE WHEN hit THEN lpad("len"::VARCHAR, 9, '0') ELSE md5('42|' || id || '|' || pos) END, pos)::INT AS k FROM s WHERE ans IS NOT NULL AND "len" >= 50)
  SELECT a.id, a.k, a.pos AS chosen, b.pos AS rejected FROM k a JOIN k b ON a.id = b.id AND a.k = b.k AND a.hit AND NOT b.hit WHERE a.k <= 2""",
)
def dpo_pairs(spark, d):
    return corpus.preference_pairs(samples(spark, d), gold(spark, d))


NUMBER = "('0x' || substr(md5('42|' || id || '|' || e[1]), 1, 12))::BIGINT % (p * q - least(4, p * q) + e[1] + 1)"


@query(
    "reward_pairs",
    f"""{RIGHT}, h AS (SELECT id, pos, hit, row_number() OVER (PARTITION BY id, hit ORDER BY pos) - 1 AS place FROM (SELECT id, pos, coalesce(hit, false) AS hit FROM s WHERE "len" >= 50)),
  c AS (SELECT id, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS q FROM h GROUP BY id),
  n AS (SELECT id, q, unnest(list_reduce([[]::BIGINT[], [0], [1], [2], [3]], lambda a, e: CASE WHEN e[1] >= p * q THEN a WHEN list_contains(a, {NUMBER}) THEN list_append(a, p * q - least(4, p * q) + e[1]) ELSE list_append(a, {NUMBER}) END)) AS number FROM c WHERE p > 0 AND q > 0),
  x AS (SELECT n.id, a.pos AS chosen, b.pos AS rejected, n.id || '-' || a.pos || '-' || b.pos AS pair FROM n JOIN h a ON n.id = a.id AND a.hit AND a.place = number // q JOIN h b ON n.id = b.id AND NOT b.hit AND b.place = number % q)
  SELECT id, chosen, rejected, row_number() OVER (ORDER BY md5('42h|' || pair), pair) <= floor(count(*) OVER () * 0.05) AS held_out FROM x""",
)
def reward_pairs(spark, d):
    return corpus.reward_pairs(samples(spark, d), gold(spark, d))


MAJ = "m AS (SELECT id, coalesce(arg_max(ans, ROW(n, -f)) FILTER (ans IS NOT NULL), '0') AS answer FROM (SELECT id, ans, count(*) AS n, min(pos) AS f FROM j GROUP BY id, ans) GROUP BY id)"


@query(
    "hard_easy_tags",
    f"""WITH {BG}, {MAJ}, t AS (SELECT j.id, pos, CASE WHEN answer = gold THEN 'easy' ELSE 'hard' END || '_' || CASE WHEN hit THEN 'pos' ELSE 'neg' END AS tag FROM j JOIN m USING (id) WHERE ans IS NOT NULL)
  SELECT id, pos, tag FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY md5('42|' || id || '-' || pos), id || '-' || pos) AS r FROM t) WHERE r <= 200""",
)
def hard_easy_tags(spark, d):
    return corpus.tagged(samples(spark, d), gold(spark, d))


@query("wrong_records", f"WITH {BG}, {MAJ}, a AS (SELECT id, any_value(gold) AS gold, string_agg(coalesce(ans, '-'), ',' ORDER BY pos) AS answers FROM j GROUP BY id) SELECT id, gold, answer, answers FROM m JOIN a USING (id) WHERE answer <> gold")
def wrong_records(spark, d):
    return corpus.wrong_records(samples(spark, d), gold(spark, d))


@query("judge_consistent", f"WITH {BG} SELECT id, min(pos) AS pos FROM j WHERE (score >= 0.04) = hit GROUP BY id")
def judge_consistent(spark, d):
    rows = ballots(spark, d).join(gold(spark, d), "id")
    return corpus.consistent(rows, F.col("score") >= 0.04, F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)))


@query("verifier_labels", f"WITH {BG} SELECT id, pos, hit AS label FROM j")
def verifier_labels(spark, d):
    rows = samples(spark, d).join(gold(spark, d), "id")
    return rows.select("id", "pos", T.extract_answer(F.regexp_replace("text", r"^step \d+ gives ", "")).eqNullSafe(F.col("gold")).alias("label"))


@query(
    "val_large",
    """WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 37 = 0), n AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 37 <> 0 ORDER BY md5('99|' || o_orderkey), o_orderkey LIMIT 300),
  b AS (SELECT id, true AS in_old FROM o UNION ALL SELECT id, false FROM n) SELECT id, in_old, id % 3 = 0 AS used FROM b""",
)
def val_large(spark, d):
    o = gold(spark, d).select("id")
    return corpus.extended_set(o.filter("id % 37 = 0"), o, o.filter("id % 11 = 0"), o.filter("id % 3 = 0"), 300)


@query("hard_export", f"WITH {BG}, {MAJ} SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM j) AND o_orderkey NOT IN (SELECT id FROM j WHERE hit) AND o_orderkey % 37 <> 0 AND o_orderkey % 11 <> 0")
def hard_export(spark, d):
    b, g = ballots(spark, d), gold(spark, d)
    solved = b.join(g, "id").filter("ans = gold").select("id")
    left = b.select("id").distinct().join(solved, "id", "left_anti")
    for other in (g.filter("id % 37 = 0"), g.filter("id % 11 = 0")):
        left = left.join(other.select("id"), "id", "left_anti")
    return left


@query("id_intersection", f"WITH {BG} SELECT id FROM j WHERE system = 'O' INTERSECT SELECT id FROM j WHERE system = 'F'")
def id_intersection(spark, d):
    b = ballots(spark, d)
    return b.filter("system = 'O'").select("id").intersect(b.filter("system = 'F'").select("id"))


@query("replay_mix", "WITH b AS (SELECT doc_id AS id FROM documents WHERE source = 'src1'), p AS (SELECT doc_id AS id FROM documents WHERE source <> 'src1' ORDER BY md5('42|' || doc_id), doc_id LIMIT 50) SELECT * FROM b UNION ALL SELECT * FROM p")
def replay_mix(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "source")
    return corpus.replay(rows.filter("source = 'src1'").select("id"), rows.select("id"), 50)


@query("sft_messages", "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS messages_md5 FROM conversations GROUP BY conv_id")
def sft_messages(spark, d):
    conv = corpus.conversations(table(spark, d, "conversations"))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return conv.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(said).alias("messages_md5"))


EXCHANGE = "x AS (SELECT conv_id, arg_min(text, ROW(turn, text)) FILTER (role = 'user') AS question, arg_min(text, ROW(turn, text)) FILTER (role = 'assistant') AS solution FROM conversations GROUP BY conv_id), e AS (SELECT * FROM x WHERE question IS NOT NULL AND solution IS NOT NULL AND length(solution) <= 4000)"


@query("message_extract", f"WITH {EXCHANGE} SELECT conv_id, md5(question) AS question_md5, md5(solution) AS solution_md5 FROM e")
def message_extract(spark, d):
    e = corpus.first_exchange(corpus.conversations(table(spark, d, "conversations")))
    return e.select("conv_id", F.md5("question").alias("question_md5"), F.md5("solution").alias("solution_md5"))


@query("fewshot_assembly", f"WITH {EXCHANGE}, s AS (SELECT string_agg('user:' || question || chr(10) || 'assistant:' || solution, chr(10) ORDER BY conv_id) AS s FROM (SELECT * FROM e ORDER BY conv_id LIMIT 2)) SELECT conv_id, md5(s || chr(10) || 'user:' || question) AS prompt_md5 FROM e, s")
def fewshot_assembly(spark, d):
    e = corpus.first_exchange(corpus.conversations(table(spark, d, "conversations")))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return corpus.fewshot(e, e.select("conv_id", "question")).select("conv_id", F.md5(said).alias("prompt_md5"))


RENDERED = "t AS (SELECT conv_id, left(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text), 2048) AS text FROM conversations GROUP BY conv_id)"


@query(
    "label_masks",
    f"""WITH {RENDERED}, m AS (SELECT conv_id, length(text)::INT AS length, CASE WHEN contains(text, '<|im_start|>assistant' || chr(10)) THEN length(string_split(text, '<|im_start|>assistant' || chr(10))[-1]) ELSE 0 END::INT AS labelled,
    ((row_number() OVER (ORDER BY conv_id) - 1) // 8)::INT AS batch, ((row_number() OVER (ORDER BY conv_id) - 1) % 8)::INT AS place FROM t)
  SELECT conv_id, length, length - labelled AS cut, labelled, batch, place, max(length) OVER (PARTITION BY batch) - length AS padding FROM m""",
)
def label_masks(spark, d):
    """Which part of each conversation is learned, and its padding in batches of eight."""
    return packing.padded(packing.label_masks(packing.rendered(corpus.conversations(table(spark, d, "conversations")))))


@query("packed_batches")
def packed_batches(spark, d):
    """Conversations packed into rows of 4,096 characters."""
    masks = packing.label_masks(packing.rendered(corpus.conversations(table(spark, d, "conversations"))))
    return packing.packed(masks, 4096).drop("part_")


@query("chunk_export", "SELECT p_partkey AS id, ((row_number() OVER (ORDER BY p_partkey) - 1) // 20)::INT AS chunk, ((row_number() OVER (ORDER BY p_partkey) - 1) % 20)::INT AS place FROM part")
def chunk_export(spark, d):
    return corpus.chunked(table(spark, d, "part").select(F.col("p_partkey").alias("id")), 20)


TEACHER = """f AS (SELECT o_orderkey // 40 AS file, (o_orderkey % 40 + 1)::INT AS place, CASE WHEN o_orderkey % 13 = 0 THEN 'x' || o_orderkey WHEN o_orderkey % 17 = 0 THEN (o_orderkey - 1)::VARCHAR ELSE o_orderkey::VARCHAR END AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'no figure' ELSE 'so boxed{' || (o_orderkey % 5) || '}' END AS solution FROM (SELECT DISTINCT o_orderkey FROM orders))"""


@query(
    "teacher_parse",
    f"""WITH {TEACHER}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, place) AS nth, CASE WHEN solution <> 'no figure' THEN regexp_extract(solution, 'boxed.([0-9]+)', 1) END AS answer FROM f), q AS (SELECT o_orderkey::VARCHAR AS id, (o_custkey % 5)::VARCHAR AS gold FROM orders)
  SELECT file, id, answer, CASE WHEN gold IS NULL THEN 'unknown' WHEN nth > 1 THEN 'duplicate' WHEN answer IS NULL THEN 'no_answer' WHEN answer <> gold THEN 'wrong' ELSE 'kept' END AS status FROM n LEFT JOIN q USING (id)""",
)
def teacher_parse(spark, d):
    k = F.col("id")
    name = F.when(k % 13 == 0, F.concat(F.lit("x"), k)).when(k % 17 == 0, (k - 1).cast("string")).otherwise(k.cast("string"))
    body = F.when(k % 5 == 0, "no figure").otherwise(F.concat(F.lit("so boxed{"), (k % 5).cast("string"), F.lit("}")))
    block = F.concat(F.lit("## ID: "), name, F.lit("\n"), body, F.lit("\n"))
    files = gold(spark, d).select("id").distinct().withColumn("file", F.floor(k / 40)).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]), "").alias("value"))
    q = gold(spark, d).select(k.cast("string").alias("id"), "gold")
    return corpus.teacher_status(corpus.teacher_blocks(files), q, T.extract_teacher(F.col("solution")).cast("string")).drop("place")


STOPS = ", ".join(f"'{w}'" for w in T.STOP)


@query(
    "tfidf_topk",
    f"""WITH dt AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({STOPS}) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
  df AS (SELECT term, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf, any_value(n) AS n FROM dt, n GROUP BY term), dw AS (SELECT doc_id, term, tf * idf AS w FROM dt JOIN df USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY doc_id),
  qt AS (SELECT item_id, term, 1 + ln(count(*)) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM benchmark) WHERE term NOT IN ({STOPS}) GROUP BY ALL), qw AS (SELECT item_id, term, tf * idf AS q, df, n FROM qt JOIN df USING (term)), qn AS (SELECT item_id, sqrt(sum(q * q)) AS qn FROM qw GROUP BY item_id),
  s AS (SELECT item_id, doc_id, sum(q * w) AS s FROM qw JOIN dw USING (term) WHERE df <= n * 0.25 GROUP BY ALL), r AS (SELECT item_id, doc_id, round(s / (dn * qn), 6) AS score FROM s JOIN dn USING (doc_id) JOIN qn USING (item_id))
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM r) WHERE rank <= 3""",
)
def tfidf_topk(spark, d):
    return retrieval.tfidf_topk(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark"))


UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


@query("cosine_within", f"WITH {UNIT} SELECT a.label, any_value(n) AS n, round(avg(list_dot_product(a.v, b.v)), 6) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM u GROUP BY label) c ON c.label = a.label GROUP BY a.label")
def cosine_within(spark, d):
    return retrieval.mean_cosines(table(spark, d, "embeddings"), "label")


@query(
    "cohesion_vote",
    f"""WITH {UNIT}, g AS (SELECT vec_id // 16 AS id, label AS ans, vec_id % 16 AS pos, v FROM u), p AS (SELECT a.id, a.ans, avg(greatest(0, list_dot_product(a.v, b.v))) AS w FROM g a JOIN g b ON a.id = b.id AND a.ans = b.ans AND a.pos < b.pos GROUP BY ALL),
  t AS (SELECT id, ans, count(*) AS n, min(pos) AS f FROM g GROUP BY ALL), s AS (SELECT t.id, t.ans, f, round(sqrt(n) * coalesce(w, 0.9), 6) AS s FROM t LEFT JOIN p ON t.id = p.id AND t.ans = p.ans)
  SELECT id, ans AS answer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, f) AS r FROM s) WHERE r = 1""",
)
def cohesion_vote(spark, d):
    v = retrieval.unit(table(spark, d, "embeddings")).select(F.floor(F.col("vec_id") / 16).alias("id"), F.col("label").alias("ans"), (F.col("vec_id") % 16).alias("pos"), "v")
    return votes.cohesion_vote(v, 1.0)




@query(
    "cosine_between",
    f"WITH {UNIT} SELECT a.label AS a, b.label AS b, round(avg(list_dot_product(a.v, b.v)), 6) + 0.0 AS cosine FROM u a JOIN u b ON a.label < b.label GROUP BY ALL",
)
def cosine_between(spark, d):
    return retrieval.cross_cosines(table(spark, d, "embeddings"), "label")


@query(
    "length_bands",
    """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS solution FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  p AS (SELECT conv_id, turn, length(trim(coalesce(text, ''), E' \\t\\n\\r')) AS p, length(trim(coalesce(solution, ''), E' \\t\\n\\r')) AS n FROM t WHERE role = 'user' AND next_role = 'assistant') SELECT conv_id, turn, n BETWEEN 50 AND 2500 AS v1, n BETWEEN 50 AND 3000 AND p <= 1500 AS v2 FROM p""",
)
def length_bands(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "solution": F.lead("text").over(w)})
    return corpus.length_bands(t.filter("role = 'user' AND next_role = 'assistant'"), "text").select("conv_id", "turn", "v1", "v2")


EDGES = ("-9223372036854775808", "9223372036854775807", "9223372036854775808", "-9223372036854775809", "12")


@query("int64_filter", f"WITH t AS (SELECT p_partkey AS id, list_value({', '.join(repr(e) for e in EDGES)})[(p_partkey % 5 + 1)::INT] AS ans FROM part) SELECT id, ans FROM t WHERE TRY_CAST(ans AS BIGINT) IS NOT NULL")
def int64_filter(spark, d):
    return corpus.int64_only(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(*map(F.lit, EDGES))[(F.col("p_partkey") % 5).cast("int")].alias("ans")))
