"""Text functions over solutions and questions that both engines build from parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from votemill.functions import text as T
from votemill.plans.registry import query
from votemill.sources.adapters import table

KINDS = [
    r"so the answer is \boxed{-42}.", "approx 38.585 so x", "total 1,234 dollars", r"\boxed{\frac{10}{2}}", r"answer \boxed{ 1,000 }", r"\boxed{1{,}000}", "no figure at all",
    r"first \boxed{3}, then \boxed{x^2+1} with 12.0", r"\boxed{\frac{7}{2}} or 3.0", r"\boxed{-0012}", r"take \boxed{1_000}", r"RANKING: 12 > -3 > 12 > 7 > 9", r"I think. Verdict: yes", r"Verdict: no way REASON: too long", r"\boxed{\text{$ 5 $}}", r"it is 00.",
]
QUESTIONS = [
    "How many ways to choose 3 of 7 balls?", "Find the derivative of x^2 at 3.5", "A triangle has sides 3, 4 and 5. What is its area?", "What is the remainder of 2^100 modulo 7?", "Solve the equation 3x + 1 = 10", "The sequence a_n = 2, 4, 6: the sum of the first 1000 terms",
    "If we know the answer is 12, what is the value of unknown variable X?", "Ann has 3 apples.", "Let f(x) be a function with domain R", "The probability that a die shows at least 5", "Compute floor(7/2) + 1 2 3 4 5 6 7 8 9", "Tom runs " + "very " * 40 + "far",
]


def case(values: list[str], key: str) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return "CASE " + key + " ".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


SOLUTIONS = f"t AS (SELECT p_partkey AS id, {case(KINDS, f'p_partkey % {len(KINDS)}')} || ' part ' || CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR ELSE '' END AS text FROM part)"
ASKED = f"t AS (SELECT p_partkey AS id, {case(QUESTIONS, f'p_partkey % {len(QUESTIONS)}')} AS text FROM part)"


def picked(values: list[str], key):
    return F.array(*map(F.lit, values))[(key % len(values)).cast("int")]


def solutions(spark, d):
    p = table(spark, d, "part")
    tail = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise("")
    return p.select(F.col("p_partkey").alias("id"), F.concat(picked(KINDS, F.col("p_partkey")), F.lit(" part "), tail).alias("text"))


def questions(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), picked(QUESTIONS, F.col("p_partkey")).alias("text"))


def canon_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '^[+-]?0*', '')"
    return f"CASE WHEN {bare} = '' THEN '0' ELSE CASE WHEN starts_with({x}, '-') THEN '-' ELSE '' END || {bare} END"


def parse_sql(x: str) -> str:
    t = rf"regexp_replace(regexp_replace({x}, '[\s\\,$!;:]', '', 'g'), '^\.+|\.+$', '', 'g')"
    f = f"TRY_CAST({t} AS DOUBLE)"
    return (
        f"CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+(?:_[0-9]+)*') THEN {canon_sql(f'replace({t}, chr(95), chr(0))').replace('chr(0)', chr(39) * 2)} "
        rf"WHEN regexp_full_match({t}, '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') AND abs({f} - round_even({f}, 0)) < 1e-6 THEN TRY_CAST(round_even({f}, 0) AS BIGINT)::VARCHAR END"
    )


def last_sql(x: str) -> str:
    return f"list_filter(list_transform(list_reverse(regexp_extract_all({x}, '{T.NUMBER}')), lambda n: {parse_sql('n')}), lambda n: n IS NOT NULL)[1]"


A, B = (f"TRY_CAST(regexp_extract(c, '{T.FRACTION}', {i}) AS BIGINT)" for i in (1, 2))
EXTRACT = (
    f"coalesce(list_filter(list_transform(list_reverse(regexp_extract_all(text, '{T.BOXED}', 1)), lambda c: coalesce(CASE WHEN {B} <> 0 AND {A} % {B} = 0 THEN ({A} // {B})::VARCHAR END, {parse_sql('c')}, {last_sql('c')})), lambda c: c IS NOT NULL)[1], {last_sql('text')})"
)


@query("extract_answer", f"WITH {SOLUTIONS} SELECT id, {EXTRACT} AS answer FROM t")
def extract_answer(spark, d):
    return solutions(spark, d).select("id", T.extract_answer(F.col("text")).alias("answer"))


@query("extract_flat", f"WITH {SOLUTIONS} SELECT id, coalesce({parse_sql(f'list_reverse(regexp_extract_all(text, {chr(39)}{T.BOXED_FLAT}{chr(39)}, 1))[1]')}, {last_sql('text')}, '0') AS answer FROM t")
def extract_flat(spark, d):
    return solutions(spark, d).select("id", T.extract_flat(F.col("text")).alias("answer"))


@query("parse_int", f"WITH {SOLUTIONS}, n AS (SELECT id, unnest(string_split(text, ' ')) AS word FROM t) SELECT id, word, {parse_sql('word')} AS value FROM n")
def parse_int(spark, d):
    return solutions(spark, d).select("id", F.explode(F.split("text", " ")).alias("word")).withColumn("value", T.parse_int(F.col("word")))


@query("teacher_extract", rf"""WITH {SOLUTIONS}, x AS (SELECT id, text, list_reverse(regexp_extract_all(replace(text, '\', ''), '{T.BOXED_FLAT}', 1))[1] AS box FROM t)
  SELECT id, TRY_CAST(round_even(TRY_CAST(replace(list_reverse(regexp_extract_all(coalesce(box, text), '{T.NUMBER}'))[1], ',', '') AS DOUBLE), 0) AS BIGINT) AS answer FROM x""")
def teacher_extract(spark, d):
    return solutions(spark, d).select("id", T.extract_teacher(F.col("text")).alias("answer"))


PURE = "box"
for _junk in ("\\,", "\\!", "\\;", "~", "{,}", ",", " ", "$"):
    PURE = f"replace({PURE}, '{_junk}', '')"


@query(
    "boxed_balanced",
    f"""WITH {SOLUTIONS}, x AS (SELECT id, CASE WHEN contains(text, 'boxed{{') THEN string_split(text, 'boxed{{')[-1] END AS tail FROM t),
  c AS (SELECT id, i, 1 + sum(CASE substr(tail, i, 1) WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS depth FROM (SELECT id, tail, unnest(range(1, length(tail) + 1)) AS i FROM x)),
  e AS (SELECT id, min(i) AS stop FROM c WHERE depth = 0 GROUP BY id), y AS (SELECT x.id, substr(tail, 1, stop - 1) AS box FROM x LEFT JOIN e USING (id)) SELECT id, box, coalesce(regexp_full_match({PURE}, '-?[0-9]+'), false) AS pure FROM y""",
)
def boxed_balanced(spark, d):
    box = T.boxed_balanced(F.col("text"))
    return solutions(spark, d).select("id", box.alias("box"), T.is_pure_integer(box).alias("pure"))



@query("pure_int_box", rf"WITH {SOLUTIONS}, x AS (SELECT id, list_reverse(regexp_extract_all(text, '{T.BOXED}', 1))[1] AS box FROM t) SELECT id, coalesce(regexp_full_match({PURE}, '-?[0-9]+'), false) AS pure FROM x")
def pure_int_box(spark, d):
    box = F.get(F.reverse(F.regexp_extract_all("text", F.lit(T.BOXED), 1)), F.lit(0))
    return solutions(spark, d).select("id", T.is_pure_integer(box).alias("pure"))


@query("verdict_of", f"""WITH {SOLUTIONS}, x AS (SELECT id, text, lower(text) AS l FROM t), y AS (SELECT *, substr(list_reverse(string_split(l, 'verdict:'))[1], 1, 12) AS tail FROM x)
  SELECT id, CASE WHEN contains(l, 'verdict:') THEN CASE WHEN contains(tail, 'yes') THEN true WHEN contains(tail, 'no') THEN false END END AS verdict, trim(regexp_extract(text, 'REASON:\\s*([^\\n]*)', 1)) AS reason FROM y""".replace("\\\\", "\\"))
def verdict_of(spark, d):
    return solutions(spark, d).select("id", T.verdict_of(F.col("text")).alias("verdict"), T.reason_of(F.col("text")).alias("reason"))


@query("parse_ranking", rf"""WITH {SOLUTIONS}, l AS (SELECT id, list_reverse(regexp_extract_all(text, 'RANKING\s*[:：]\s*(.+)', 1))[1] AS line FROM t),
  v AS (SELECT id, list_transform(list_filter(list_transform(string_split(line, '>'), lambda x: replace(regexp_extract(x, '-?[0-9][0-9,]*'), ',', '')), lambda x: x <> ''), lambda x: {canon_sql('x')}) AS v FROM l)
  SELECT id, coalesce(array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[1:3], '>'), '') AS ranks FROM v""")
def parse_ranking(spark, d):
    return solutions(spark, d).select("id", F.array_join(T.parse_ranking(F.col("text")), ">").alias("ranks"))


@query("p_yes", "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, round(CASE WHEN l_tax = 0 THEN 0 WHEN l_discount = 0 THEN 1 ELSE exp(-l_tax) / (exp(-l_tax) + exp(-l_discount)) END, 9) AS p_yes FROM lineitem")
def p_yes(spark, d):
    yes, no = (F.when(F.col(c) != 0, -F.col(c)) for c in ("l_tax", "l_discount"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.round(T.p_yes(yes, no), 9).alias("p_yes"))


DIRTY = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '12. ' || text WHEN 1 THEN text || ' ![fig](http://x/y.png) [asy]draw(a);[/asy] end' WHEN 2 THEN text || '\n\n\n\nTranslate the above text into another language.' ELSE text END AS q FROM documents"


def cleaned_sql(x: str) -> str:
    for pattern, new in ((r"(?is)\s*Translate the above text.*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?is)\[asy\].*?\[/asy\]", ""), (r"^\s*\d+\.\s+", "")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("clean_question", f"WITH t AS ({DIRTY.replace(chr(92) + 'n', chr(10))}), c AS (SELECT doc_id, q, {cleaned_sql('q')} AS clean FROM t) SELECT doc_id, md5(clean) AS clean_md5, clean <> q AS affected FROM c")
def clean_question(spark, d):
    k, t = F.col("doc_id") % 4, F.col("text")
    q = F.when(k == 0, F.concat(F.lit("12. "), t)).when(k == 1, F.concat(t, F.lit(" ![fig](http://x/y.png) [asy]draw(a);[/asy] end"))).when(k == 2, F.concat(t, F.lit("\n\n\n\nTranslate the above text into another language."))).otherwise(t)
    rows = table(spark, d, "documents").select("doc_id", q.alias("q")).withColumn("clean", T.clean_question(F.col("q")))
    return rows.select("doc_id", F.md5("clean").alias("clean_md5"), (F.col("clean") != F.col("q")).alias("affected"))


def topic_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in T.TOPICS) + f" ELSE '{T.OTHER_TOPIC}' END"


@query("classify_topic", f"WITH {ASKED} SELECT id, {topic_sql('text')} AS topic FROM t")
def classify_topic(spark, d):
    return questions(spark, d).select("id", T.topic(F.col("text")).alias("topic"))


@query(
    "feature_flags",
    f"WITH {ASKED} SELECT id, " + ", ".join(f"regexp_matches(lower(text), '{p}') AS \"{n}\"" for n, p in T.FEATURES)
    + rf""", len(regexp_extract_all(text, '\d+')) >= 8 AS "{T.MANY_NUMBERS}", len(list_filter(regexp_extract_all(text, '\d+'), lambda x: length(x) >= 4)) > 0 AS "{T.BIG_NUMBER}", length(text) >= 180 AS "{T.LONG_TEXT}" FROM t""",
)
def feature_flags(spark, d):
    return questions(spark, d).select("id", *[c.alias(n) for n, c in T.features(F.col("text")).items()])


RATE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.NO_CORRECT_RATE.items()) + " ELSE 0.2 END"


@query(
    "target_priority",
    f"WITH {ASKED}, c AS (SELECT id, text, {topic_sql('text')} AS topic FROM t) SELECT id, topic, regexp_matches(text, '{T.DEGENERATE}') AS degenerate, round((least({RATE.format('topic')}, {T.RATE_CAP}) - CASE WHEN regexp_matches(text, '{T.DEGENERATE}') THEN {T.DEGENERATE_PENALTY} ELSE 0 END)::DOUBLE, 4) AS priority FROM c",
)
def target_priority(spark, d):
    t = F.col("text")
    return questions(spark, d).select("id", T.topic(t).alias("topic"), T.degenerate(t).alias("degenerate"), T.priority(t).alias("priority"))


@query("format_reward", f"WITH {SOLUTIONS} SELECT id, round((coalesce(({EXTRACT}) = '5', false)::INT + 0.1 * contains(text, 'boxed')::INT)::DOUBLE, 6) AS reward FROM t")
def format_reward(spark, d):
    from votemill.operators.rewards import format_reward as shaped

    return shaped(solutions(spark, d), T.extract_answer(F.col("text")), F.lit("5")).select("id", F.round("reward", 6).alias("reward"))


@query(
    "verdict_reason",
    f"WITH {SOLUTIONS}, x AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Verdict: YES' || chr(10) || 'REASON:  the ' || repeat('long ', id % 90) || chr(10) || 'more' ELSE text END AS text FROM t), "
    r"y AS (SELECT id, text, substr(string_split(lower(text), 'verdict:')[-1], 1, 12) AS tail FROM x) "
    r"SELECT id, CASE WHEN contains(lower(text), 'verdict:') THEN CASE WHEN contains(tail, 'yes') THEN true WHEN contains(tail, 'no') THEN false END END AS verdict, substr(trim(regexp_extract(text, 'REASON:\s*([^\n]*)', 1)), 1, 300) AS reason FROM y",
)
def verdict_reason(spark, d):
    own = F.concat(F.lit("Verdict: YES\nREASON:  the "), F.repeat(F.lit("long "), (F.col("id") % 90).cast("int")), F.lit("\nmore"))
    rows = solutions(spark, d).withColumn("text", F.when(F.col("id") % 4 == 0, own).otherwise(F.col("text")))
    return rows.select("id", T.verdict_of(F.col("text")).alias("verdict"), T.reason_of(F.col("text")).alias("reason"))
