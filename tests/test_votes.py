"""Vote rules against plain Python on random ballots, and the fault-injection cases."""

import math
import random
from collections import Counter

import pytest

from votemill.operators import contracts, sweeps, votes

HUGE = "9" * 2048


def frame(spark, problems):
    rows = [(i, p, *b) for i, ballots in problems.items() for p, b in enumerate(ballots)]
    return spark.createDataFrame(rows, "id long, pos int, ans string, logp double, trunc boolean, len int")


def plain(ans):
    return [(a, -0.1, False, 400) for a in ans]


def winner(df):
    return {r["id"]: r["answer"] for r in df.collect()}


def by_majority(bs):
    v = [b[0] for b in bs if b[0] is not None]
    return Counter(v).most_common(1)[0][0] if v else "0"


def by_weight(bs, scale=2.0):
    v = [b for b in bs if b[0] is not None]
    if not v:
        return "0"
    top, w = max(b[1] for b in v), {}
    for b in v:
        w[b[0]] = w.get(b[0], 0) + math.exp((b[1] - top) * scale)
    return max(w, key=lambda a: round(w[a], 9))


def trimmed(bs, frac=0.25):
    v = [b for b in bs if b[0] is not None]
    if len(v) < 4:
        return by_majority(bs)
    return by_majority(sorted(v, key=lambda b: -b[1])[: max(2, int(len(v) * (1 - frac)))])


def complete(bs):
    return by_majority([b for b in bs if not b[2]] or bs)


@pytest.fixture(scope="module")
def problems():
    rng = random.Random(3)
    return {i: [(rng.choice([None, "1", "2", "3"]), -rng.randint(1, 9) / 8, rng.random() < 0.3, rng.randint(1, 50)) for _ in range(rng.randint(1, 9))] for i in range(200)}


@pytest.mark.parametrize("rule, expected", [("majority", by_majority), ("weighted2", by_weight), ("trim25", trimmed), ("drop_trunc", complete)])
def test_rules_match_python(spark, problems, rule, expected):
    assert winner(votes.RULES[rule](frame(spark, problems))) == {i: expected(bs) for i, bs in problems.items()}


def test_int64_guard(spark):
    edge = str(2**63 - 1)
    got = {r["id"]: (r["answer"], r["reason"]) for r in votes.int64_safe(frame(spark, {
        1: plain([HUGE] * 5 + ["42"] * 3), 2: plain([HUGE] * 4), 3: plain(["7"] * 3 + ["9"]), 4: plain([edge] * 3), 5: plain([str(2**63)] * 3 + ["5"]), 6: plain([None] * 4), 7: plain(["-" + str(2**63)] * 2 + ["8"]),
    })).collect()}
    assert got[1] == ("42", "oversized_2048d")
    assert got[2] == ("0", "all_oversized")
    assert got[3] == ("7", "none") and got[4] == (edge, "none")
    assert got[5] == ("5", "oversized_19d")
    assert got[6] == ("0", "none") and got[7][0] == "8"


def test_irv_and_ensemble(spark):
    b = spark.createDataFrame([(1, p, r) for p, r in enumerate([["1", "2"], ["1", "2"], ["2", "3"], ["3", "2"], ["3", "2"]])], "id long, pos int, rank array<string>")
    # 2 has one first choice and leaves; its ballot goes to 3, which then has a majority.
    assert winner(votes.instant_runoff(b)) == {1: "3"}
    assert sweeps.rule_ensemble(frame(spark, {1: plain(["4", "4", "5"])})).first()["answer"] == "4"


def ids(n, start=0):
    return [(f"t-{i:03d}",) for i in range(start, start + n)]


@pytest.mark.parametrize(
    "name, rows, columns, fails",
    [
        ("good", [(f"t-{i:03d}", str(i + 1)) for i in range(20)], ["id", "answer"], set()),
        ("header", [(f"t-{i:03d}", str(i + 1)) for i in range(20)], ["ID", "answer"], {"header"}),
        ("short", [(f"t-{i:03d}", str(i + 1)) for i in range(15)], ["id", "answer"], {"rows", "missing"}),
        ("others", [(f"x-{i:03d}", str(i + 1)) for i in range(20)], ["id", "answer"], {"missing", "extra"}),
        ("zeros", [(f"t-{i:03d}", "0" if i else "5") for i in range(20)], ["id", "answer"], {"zero_rate"}),
        ("oversize", [(f"t-{i:03d}", str(2**63 + 9) if i == 3 else "7") for i in range(20)], ["id", "answer"], {"oversize"}),
        ("twice", [("t-000", "1")] + [(f"t-{i:03d}", str(i + 1)) for i in range(20)], ["id", "answer"], {"rows", "duplicates"}),
        ("blank", [(f"t-{i:03d}", None if i == 3 else "7.5" if i == 4 else "7") for i in range(20)], ["id", "answer"], {"blank", "not_int"}),
    ],
)
def test_submission_faults(spark, name, rows, columns, fails):
    got = contracts.submission_report(spark.createDataFrame(rows, "id string, answer string"), spark.createDataFrame(ids(20), "id string"), columns)
    assert {r["check"] for r in got.collect() if r["level"] == "FAIL"} == fails
    assert contracts.verdict(got).first()["verdict"] == ("FAIL" if fails else "PASS")


def test_dump_faults(spark):
    want = spark.createDataFrame([(i,) for i in range(20)], "id long")
    part = frame(spark, {i: plain(["1"] * 4) for i in range(5)})
    thin = frame(spark, {i: plain(["1"] * (2 if i == 3 else 4)) for i in range(20)})
    fails = lambda df, n=None: {r["check"] for r in contracts.dump_report(df, want, n).collect() if r["level"] == "FAIL"}
    assert fails(part) == {"missing"} and fails(thin) == {"samples"} and fails(thin, 4) == {"samples"}
    with pytest.raises(contracts.ContractError):
        contracts.require_coverage(part, want)
    assert contracts.require_coverage(part, want, allow_partial=True) is part
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(part, "id")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, pos int, ans string, logp double, trunc boolean, len int")
    for rule in votes.RULES.values():
        assert rule(empty).count() == 0
    assert sweeps.answers(empty, tuple(votes.RULES)).count() == 0
