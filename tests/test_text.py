"""Golden pairs of the text functions."""

import random

import pytest
from pyspark.sql import functions as F

from votemill.functions import sql
from votemill.functions import text as T
from votemill.operators import votes


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, answer",
    [
        (r"answer is \boxed{-42}.", "-42"), ("approx 38.585 so x", None), ("total 1,234 dollars", "1234"), (r"\boxed{\frac{10}{2}}", "5"), (r"answer \boxed{ 1,000 }", "1000"), (r"\boxed{1{,}000}", "0"),
        ("", None), (None, None), (r"\boxed{" + "7" * 40 + "}", "7" * 40), (r"\boxed{3} and \boxed{x}", "3"), ("it is 12.0", "12"),
    ],
)
def test_extract(spark, text, answer):
    assert one(spark, T.extract_answer, text) == answer


@pytest.mark.parametrize("text, box", [(r"a \boxed{\frac{1}{2}} b", r"\frac{1}{2}"), (r"\boxed{a{b{c}}}", "a{b{c}}"), (r"\boxed{open", None), ("none", None), (r"\boxed{1} \boxed{2}", "2"), (r"\boxed{}", "")])
def test_balanced(spark, text, box):
    assert one(spark, T.boxed_balanced, text) == box


@pytest.mark.parametrize("box, pure", [("1{,}000", True), ("1.92 yuan", False), (r"-5\,", True), ("", False), ("$7$", True)])
def test_pure(spark, box, pure):
    assert one(spark, T.is_pure_integer, box) is pure


def test_small_ones(spark):
    assert one(spark, T.verdict_of, "x VERDICT: Yes") is True and one(spark, T.verdict_of, "verdict: maybe") is None
    assert one(spark, T.parse_ranking, "RANKING: 1 > 2\nRANKING: 3 > 3 > 4 > 5 > 6") == ["3", "4", "5"]
    assert one(spark, T.parse_ranking, "none") == []
    assert one(spark, T.clean_question, " 3. Find x. ![a](b)\n\n\n\nNow.  Translate the above text into y") == "Find x. \n\nNow."
    assert one(spark, T.terms, "The Prime of the primes, a PRIME") == ["prime", "primes", "prime"]
    assert one(spark, T.extract_teacher, r"\boxed{2.5} or 7") == 2 and one(spark, T.extract_flat, "nothing") == "0"
    assert one(spark, T.degenerate, "If we know the answer") is True


def test_sql_functions(spark):
    """Functions and rules that SQL calls give what the columns and rules of DataFrames give."""
    names = sql.register(spark)
    assert sql.register(spark) == names
    texts = ["-42", " 1,234 $", "3.0", "2.5", "1e3", "007", "-0", "x", "", None, "1_000", r"5\,", "9" * 30, ".5", "..7.."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = spark.sql("SELECT i, parse_int(t) AS a, topic_of(t) AS b FROM {df}", df=df).collect()
    want = df.select("i", T.parse_int(F.col("t")).alias("a"), T.topic(F.col("t")).alias("b")).collect()
    assert sorted(got) == sorted(want)
    rng = random.Random(4)
    ballots = [(i, p, rng.choice(["1", "2", "3", None]), -rng.randint(1, 6) / 4, rng.random() < 0.3, rng.randint(1, 9)) for i in range(150) for p in range(rng.randint(1, 12))]
    ballots += [(500, 0, None, -1.0, False, 1), (501, 0, "7", -1.0, True, 1)]
    df = spark.createDataFrame(ballots, "id long, pos int, ans string, logp double, trunc boolean, len int")
    packed = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ans", "logp", "trunc", "len"))).alias("s")).select("id", F.expr("transform(s, x -> struct(x.ans AS ans, x.logp AS logp, x.trunc AS trunc, x.len AS len))").alias("s"))
    rules = {
        "vote_majority(s)": votes.RULES["majority"], "vote_weighted(s, 2.0)": votes.RULES["weighted2"], "vote_majority(trim_lowconf(s, 0.25))": votes.RULES["trim25"],
        "vote_weighted(trim_lowconf(s, 0.5), 2.0)": votes.RULES["trim50_weighted"], "vote_weighted(drop_truncated(s), 2.0)": votes.RULES["drop_trunc_weighted"],
        "vote_majority(first_n(s, 3))": lambda b: votes.RULES["majority"](votes.prefix(b, 3)),
    }
    for call, rule in rules.items():
        assert dict(map(tuple, spark.sql(f"SELECT id, {call} FROM {{packed}}", packed=packed).collect())) == {r["id"]: r["answer"] for r in rule(df).collect()}, call
    text = "intro\n## ID: a\none\n### ID： b\n\n  two \n## Notes\n## ID: c"
    found = spark.sql("SELECT b.* FROM {t} t, LATERAL id_blocks(t.x) b ORDER BY place", t=spark.createDataFrame([(text,), (None,)], "x string"))
    assert [tuple(r) for r in found.collect()] == [(1, "a", "one"), (2, "b", "two \n## Notes"), (3, "c", "")]
