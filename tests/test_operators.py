"""Operators whose results SQL does not give, or gives by the same formula, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from votemill import plans
from votemill.functions import sql, text
from votemill.operators import contracts, corpus, draws, ranges, resampling, retrieval, selector, sweeps, systems, votes
from votemill.plans import files
from votemill.sources import adapters
from votemill.sources.adapters import ballots, gold
from votemill.streaming import completion, ingest

BALLOT = "id long, pos int, ans string, logp double, trunc boolean, len int, seed long, system string, score double, other long"


def random_ballots(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for p in range(rng.randint(1, 12)):
            ans = None if rng.random() < 0.15 else rng.choice(["1", "2", "3", "-4", "1000000000001"])
            rows.append((i, p, ans, -rng.randint(1, 400) / 100, rng.random() < 0.4, rng.randint(10, 60), p % 3, "s", rng.random(), rng.randint(0, 4)))
    return rows, spark.createDataFrame(rows, BALLOT)


@pytest.mark.parametrize("most", [0, 10**6])
def test_running_numbers_and_sums(spark, most):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 5), rng.randint(-3, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a int, v int")
    got = {r["id"]: (r["k"], r["s"]) for r in ranges.running(df, [-F.col("a"), F.col("id")], {"s": F.col("v")}, most=most, sample=300, ranges=9).collect()}
    total = 0
    for k, (i, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        assert got[i] == (k, total)


def test_hash_ranks(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("g"))
    got = ranges.hash_ranks(df, F.md5(F.col("id").cast("string")), ("g",), "id").collect()
    import hashlib

    groups = defaultdict(list)
    for r in df.collect():
        groups[r["g"]].append(r["id"])
    want = {i: (k, len(g)) for g in groups.values() for k, i in enumerate(sorted(g, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()), 1)}
    assert {r["id"]: (r["r_"], r["n_"]) for r in got} == want


def test_sweep_gives_each_rule_its_own_answers(spark):
    _, df = random_ballots(spark)
    got = defaultdict(dict)
    for r in sweeps.answers(df, tuple(votes.RULES)).collect():
        got[r["rule"]][r["id"]] = r["answer"]
    assert set(got) == set(votes.RULES) == set(sweeps.forms())
    for rule, f in votes.RULES.items():
        assert got[rule] == {r["id"]: r["answer"] for r in f(df).select("id", "answer").collect()}, rule


def test_sweep_runs_rules_of_callers(spark):
    _, df = random_ballots(spark)
    truth = df.select("id").distinct().select("id", F.lit("1").alias("gold"))
    mine = {"majority": votes.RULES["majority"], "always1": lambda b: b.groupBy("id").agg(F.lit("1").alias("answer"))}
    got = {r["rule"]: r["correct"] for r in sweeps.sweep(df, truth, mine).collect()}
    assert got["always1"] == truth.count() and got["majority"] < truth.count()


def test_runoff():
    assert votes.runoff([["1", "2"], ["2", "1"], ["3", "2"]]) == "2"  # 3 leaves, then 2 has two of three
    assert votes.runoff([["1"], ["1"], ["2"]]) == "1"
    assert votes.runoff([["5", "1"], ["1", "5"]]) == "1"  # of equal ones the larger leaves
    assert votes.runoff([]) is None


def test_replicator(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i // 8, int(rng.integers(3)), i % 8, v[i].tolist()) for i in range(40)]
    got = {r["id"]: r["answer"] for r in resampling.replicator(spark.createDataFrame(rows, "id long, ans int, pos long, v array<double>")).collect()}
    for i in range(5):
        own = [r for r in rows if r[0] == i]
        n = len(own)
        s = [[max(0.0, sum(a * b for a, b in zip(own[j][3], own[k][3]))) if j != k else 0.0 for k in range(n)] for j in range(n)]
        x = [1 / n] * n
        for _ in range(300):
            y = [x[j] * sum(s[j][k] * x[k] for k in range(n)) for j in range(n)]
            t = sum(y)
            if t <= 0:
                break
            y = [a / t for a in y]
            done = sum(abs(a - b) for a, b in zip(x, y)) < 1e-10
            x = y
            if done:
                break
        mass = defaultdict(float)
        for (_, a, _, _), m in zip(own, x):
            mass[a] += m
        assert got[i] == max(mass, key=lambda a: round(mass[a], 9))  # two samples left share the mass evenly: the first answer wins


def plain_logistic(x, y, epochs=400, rate=0.35):
    """The original's descent: 400 steps from zero."""
    w = np.zeros(x.shape[1])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(y) + selector.L2 * w)
    return w


def contested(spark, n=400):
    _, df = random_ballots(spark, n)
    truth = df.select("id").distinct().select("id", (F.col("id") % 3 + 1).cast("string").alias("gold"))
    return selector.utility(selector.features(df), truth)


def standard_scores(rows):
    data = rows.orderBy("id").collect()
    x = np.array([[r[c] for c in selector.COLUMNS] for r in data])
    sd = x.std(0)
    return data, np.column_stack([(x - x.mean(0)) / np.where(sd > selector.SAME, sd, 1), np.ones(len(x))])


def test_selector_fits_are_optimal(spark):
    """At the fitted weights the gradient of the loss over the rows outside the fold is zero; descent goes to the same place."""
    rows = contested(spark)
    data, x = standard_scores(rows)
    got = {r["id"]: r for r in selector.two_heads(rows).collect()}
    fits = [(k, None) for k in range(5)] + [(2, 1)]
    weights = selector.newton(selector.prepared(rows), fits)
    u, fold, inner = np.array([r["u"] for r in data]), np.array([r["id"] % 5 for r in data]), np.array([r["id"] // 5 % 4 for r in data])
    for w, (k, j) in zip(weights, fits):
        train = (u != 0) & (fold != k) & ((inner != j) if j is not None else True)
        y = (u[train] == 1).astype(float)
        gradient = x[train].T @ (1 / (1 + np.exp(-x[train] @ w)) - y) / train.sum() + selector.L2 * w
        assert np.abs(gradient).max() < 1e-9
        near = plain_logistic(x[train], y)
        assert np.corrcoef(x @ near, x @ w)[0, 1] > 0.98
        long = plain_logistic(x[train], y, 60_000)
        assert np.allclose(long, w, atol=1e-3)
        if j is None:
            for i in np.flatnonzero(fold == k):
                p = 1 / (1 + math.exp(-float(x[i] @ w)))
                assert got[data[i]["id"]]["score"] == pytest.approx(p - (1 - p), abs=1e-8)


def test_selector_thresholds(spark):
    rows = contested(spark)
    data, x = standard_scores(rows)
    ready = selector.prepared(rows)
    fits = [(k, None) for k in range(5)] + [(k, j) for k in range(5) for j in range(4)]
    weights = selector.newton(ready, fits)
    u, fold, inner = np.array([r["u"] for r in data]), np.array([r["id"] % 5 for r in data]), np.array([r["id"] // 5 % 4 for r in data])
    cut = selector.thresholds(ready, weights, fits, 5)
    for k in range(5):
        own = [weights[fits.index((k, j))] for j in inner]
        score = np.array([round(2 / (1 + math.exp(-float(a @ w))) - 1, 9) for a, w in zip(x, own)])
        rest = fold != k
        nets = {c: u[rest & (np.floor(score * 1000) >= c)].sum() for c in {round(v * 1000) for v in score[rest]}}
        top = max(nets.values())
        assert cut[k] == (max(c for c in nets if nets[c] == top) if top > 0 else 1000)


def test_selector_without_lessons(spark):
    rows = contested(spark, 60)
    assert all(r["score"] == 0 and not r["flip"] for r in selector.two_heads(rows.withColumn("u", F.lit(0)), nested=True).collect())
    assert all(r["score"] < 0 for r in selector.two_heads(rows.withColumn("u", F.lit(-1))).collect())
    assert selector.two_heads(rows.limit(0)).count() == 0


def plain_topk(pool, asked, k, common=0.25):
    words = lambda t: [w for w in re.findall("[a-z]{2,}", t.lower()) if w not in text.STOP]
    n, docs = len(pool), {i: Counter(words(t)) for i, t in pool}
    df = Counter(w for c in docs.values() for w in c)
    weigh = lambda c: {w: (1 + math.log(f)) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, f in c.items() if w in df}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    docs = {i: weigh(c) for i, c in docs.items()}
    out = set()
    for q, t in asked:
        v = weigh(Counter(words(t)))
        scores = {}
        for i, d in docs.items():
            s = sum(x * d[w] for w, x in v.items() if w in d and df[w] <= n * common)
            if s:
                scores[i] = round(s / norm(d) / norm(v), 6)
        out |= {(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(((s, i) for i, s in scores.items()), reverse=True)[:k])}
    return out


@pytest.mark.parametrize("block", [1, 4, 128])
def test_topk_opens_what_it_needs(spark, block):
    """Blocks that cannot reach the k best stay closed, and the rows are those of all lists; ties and copies included."""
    rng = random.Random(block)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.05)), len(vocabulary) - 1)] for _ in range(n))
    asked = [(i, draw(6)) for i in range(12)]
    pool = [(i, draw(rng.randint(3, 30))) for i in range(700)] + [(1000 + 10 * i + j, t + " " + draw(2)) for i, t in asked for j in range(3)] + [(2000 + j, asked[0][1]) for j in range(5)]
    best, report = retrieval.topk(spark.createDataFrame(pool, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), 3, 0.25, block)
    assert {tuple(r) for r in best.collect()} == plain_topk(pool, asked, 3)
    opened, postings = report.agg(F.sum("opened"), F.sum("postings")).first()
    assert 0 < opened <= postings and (block > 4 or opened < 0.75 * postings)


def test_topk_of_few_and_of_none(spark):
    docs = "doc_id long, text string"
    pool, asked = [(1, "alpha beta"), (2, "gamma"), (3, None), (4, ""), (5, "alpha gamma delta"), (6, "omega")], [(1, "alpha gamma"), (2, ""), (3, "unknown words")]
    found = lambda p: {tuple(r) for r in retrieval.tfidf_topk(spark.createDataFrame(p, docs), spark.createDataFrame(asked, "item_id long, text string"), 3, 1.0).collect()}
    assert found(pool) == plain_topk([(i, t or "") for i, t in pool], asked, 3, 1.0)
    assert found([]) == set()


def test_reward_pairs_are_drawn_evenly(spark):
    """All pairs where there are few; else four different ones, each pair of a problem as often as any other."""
    rows = [(i, p, "1" if p < 3 else None if p == 3 else "2", 60) for i in range(3000) for p in range(6)] + [(9000, 0, "1", 60), (9000, 1, "2", 60), (9000, 2, "2", 10), (9001, 0, "1", 60), (9002, 0, "2", 60)]
    rows += [(9003, p, "1" if p < 300 else "2", 99) for p in range(600)]
    got = corpus.reward_pairs(spark.createDataFrame(rows, "id long, pos int, ans string, len int"), spark.createDataFrame([(i, "1") for i in {r[0] for r in rows}], "id long, gold string")).collect()
    by = defaultdict(set)
    for r in got:
        assert (r["chosen"], r["rejected"]) not in by[r["id"]]
        by[r["id"]].add((r["chosen"], r["rejected"]))
    assert by[9000] == {(0, 1)} and 9001 not in by and 9002 not in by
    assert len(by[9003]) == 4 and all(a < 300 <= b for a, b in by[9003])
    seen = Counter(p for i in range(3000) for p in by[i])
    assert len(seen) == 9 and all(len(by[i]) == 4 for i in range(3000)) and all(abs(n - 3000 * 4 / 9) < 150 for n in seen.values())
    assert sum(r["held_out"] for r in got) == int(len(got) * 0.05)


def test_power_is_that_of_the_simulation(spark):
    pairs = [("x", "y", 400, 0.2), ("x", "z", 1000, 0.05), ("y", "z", 100, 0.004), ("p", "q", 300, 0.01)]
    got = {(r["a"], r["b"], r["delta"]): r["power"] for r in resampling.power(spark.createDataFrame(pairs, "a string, b string, n long, discordant double")).collect()}
    rng = np.random.default_rng(1)
    for a, b, n, disc in pairs:
        for delta in (0.005, 0.01, 0.02):
            p, m = 0.5 + delta / (2 * disc), round(n * disc)
            if n * disc < 1:
                assert got[a, b, delta] == 0
            elif p >= 1:
                assert got[a, b, delta] is None
            else:
                k = rng.binomial(m, p, 40_000)
                assert got[a, b, delta] == pytest.approx(((np.abs(2 * k - m) - 1) / math.sqrt(m) > 1.959964).mean(), abs=0.02)


def test_binomial_draws(spark):
    cases = [(0, 0.5), (7, 0.0), (7, 1.0), (1, 0.3), (12, 0.5), (900, 0.02), (10**6, 0.4), (10**9, 0.9)]
    df = spark.createDataFrame(cases, "n long, p double")
    rows = resampling.replicates(df, 3000).withColumn("k", resampling.binomial(F.col("n"), F.col("p"), resampling.uniform(F.col("rep"), F.col("n"), F.col("p"))))
    got = {(r["n"], r["p"]): r for r in rows.groupBy("n", "p").agg(F.avg("k").alias("m"), F.stddev_pop("k").alias("s"), F.min("k").alias("low"), F.max("k").alias("high")).collect()}
    for n, p in cases:
        r, sd = got[n, p], math.sqrt(n * p * (1 - p))
        assert 0 <= r["low"] <= r["high"] <= n and abs(r["m"] - n * p) <= 4 * sd / math.sqrt(3000) and abs(r["s"] - sd) <= 0.06 * sd
    one = spark.createDataFrame([(5, 0.5, u) for u in (0.0, 0.031, 0.032, 0.49, 0.9999999)], "n long, p double, u double")
    assert [r[0] for r in one.orderBy("u").select(resampling.binomial(F.col("n"), F.col("p"), F.col("u"))).collect()] == [0, 0, 1, 2, 5]


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(6)
    hits = (rng.random(800) < 0.3).astype(float)
    df = spark.createDataFrame([(i, float(h), float(x)) for i, (h, x) in enumerate(zip(hits, rng.normal(size=800)))], "id long, v double, x double")
    means = np.sort(rng.choice(hits, (4000, 800)).mean(1))
    got = resampling.bootstrap_share(df, "v").first()
    assert got["n"] == 800 and got["mean"] == pytest.approx(hits.mean())
    assert got["low"] == pytest.approx(means[100], abs=0.006) and got["high"] == pytest.approx(means[3900], abs=0.006)
    assert resampling.bootstrap_share(df.filter("id < 0"), "v").count() == 0
    flat = resampling.bootstrap_share(df.withColumn("v", F.lit(1.0)), "v").first()
    assert (flat["low"], flat["high"]) == (1.0, 1.0)
    real = resampling.bootstrap_ci(df, "x", 400).first()
    x = np.array([r["x"] for r in df.collect()])
    assert real["mean"] == pytest.approx(x.mean()) and real["high"] - real["low"] == pytest.approx(2 * 1.96 * x.std() / math.sqrt(800), rel=0.2)


def test_permutation_of_signs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(np.where(rng.random(60) < 0.62, 0.75, -0.25))]
    got = resampling.permutation_max(spark.createDataFrame(rows, "id long, cell string, v double"), 2000).first()
    v, cell = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    signs = rng.choice([-1, 1], (20_000, 60)) * v
    top = np.maximum(signs[:, cell == "a"].mean(1), signs[:, cell == "b"].mean(1))
    observed = max(v[cell == "a"].mean(), v[cell == "b"].mean())
    assert got["observed"] == pytest.approx(observed) and got["trials"] == 2000
    assert got["p"] == pytest.approx((top >= observed - 1e-12).mean(), abs=0.02)


def test_greedy_cover(spark):
    rng = random.Random(7)
    solved = {s: {i for i in range(80) if rng.random() < 0.2} for s in "abcdefg"}
    rows = [(i, s, i in own) for s, own in solved.items() for i in range(80)]
    got = [(r["step"], r["system"], r["gain"]) for r in systems.greedy_cover(spark.createDataFrame(rows, "id long, system string, ok boolean"), 9).collect()]
    left, want = dict(solved), []
    while any(left.values()):
        best = max(left, key=lambda s: (len(left[s]), s))
        want.append((len(want) + 1, best, len(left[best])))
        left = {s: own - solved[best] for s, own in left.items()}
    assert got == want[:9]


def test_family_odds_are_not_negative(spark):
    """A family right on less than half weighs nothing by odds, so another family's answer stands."""
    rows = [(i, p, "1" if f == "good" else "2", -1.0, f) for i in range(50) for p, f in enumerate(("good", "bad", "bad2"))]
    df = spark.createDataFrame(rows, "id long, pos int, ans string, logp double, fam0 string")
    truth = spark.createDataFrame([(i, "1" if i % 10 else "2") for i in range(50)], "id long, gold string")
    got = systems.family_vote(df, truth, "fam0").collect()
    assert {r["equal"] for r in got} == {"2"} and {r["odds"] for r in got} == {"1"}


def test_dump_contracts(spark):
    rows, df = random_ballots(spark, 30)
    want = spark.range(33).toDF("id")
    twice = df.unionByName(df.filter("id = 0 AND pos = 0"))
    by = {r["check"]: (r["level"], r["value"]) for r in contracts.dump_report(twice, want).collect()}
    assert by["duplicates"] == ("FAIL", 1.0) and by["missing"] == ("FAIL", 3.0)
    by = {r["check"]: (r["level"], r["value"]) for r in contracts.dump_warnings(df, want, 4).collect()}
    sizes = Counter(r[0] for r in rows)
    assert by["empty"] == ("WARN", 3.0) and by["short"][1] == sum(0 < n < 4 for n in sizes.values())


def test_groups_are_emitted_once(spark, tmp_path):
    schema, home = "key long, value double, ts timestamp", tmp_path / "in"
    home.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(home))

    def put(rows):
        spark.createDataFrame(rows, "key long, value double, ts string").coalesce(1).write.mode("append").json(str(home))

    def drain():
        ingest.drain(completion.completed(source, "key", 3), str(tmp_path / "out"), str(tmp_path / "c"))
        return ingest.sink_rows(spark, str(tmp_path / "out"), completion.OUT)

    put([(1, 1.0, "2024-01-01 00:00:00")] * 2 + [(2, 1.0, "2024-01-01 00:00:00")] * 3 + [(3, 2.0, "2024-01-01 00:00:00")])
    drain()
    put([(1, 1.0, "2024-01-01 00:01:00")] * 2 + [(2, 5.0, "2024-01-01 00:01:00")] * 4)
    got = drain()
    assert {(r["key"], r["n"], r["total"], r["partial"]) for r in got.collect()} == {(1, 3, 3.0, False), (2, 3, 3.0, False)} and got.count() == 2
    put([(4, 0.0, "2024-01-02 00:00:00")])
    left = [tuple(r) for r in drain().collect() if r["partial"]]
    assert left == [(3, 1, 2.0, True)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def draw(*keys) -> float:
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 2**52


def drawn_ballots(spark, n: int = 40):
    rng = random.Random(11)
    rows = [(i, p, rng.choice(["0", "1", "2", "33", None]), -rng.random(), rng.random() < 0.4, rng.randrange(5), rng.choice([-1.0, -0.5, -0.25])) for i in range(n) for p in range(60 if i == 7 else rng.randrange(1, 8))]
    return rows, spark.createDataFrame(rows, "id long, pos int, ans string, logp double, trunc boolean, len int, sure double")


def test_keys_are_hashed_as_md5_does():
    tails = [b"|%d|%d" % (i * i * 977, i) for i in range(300)] + [b"|" + b"x" * 70]
    for part in (tails[:-1], tails):
        keys = draws.Keys([b"s|"] * len(part), part)
        for middle in (b"3", b"17", b"4", b"199"):
            assert [bytes(d) for d in keys.digests(middle)] == [hashlib.md5(b"s|" + middle + t).digest() for t in part]
            assert keys.leading(middle).tolist() == [int(hashlib.md5(b"s|" + middle + t).hexdigest()[:13], 16) for t in part]


def test_subsets_are_drawn_in_arrays(spark):
    rows, df = drawn_ballots(spark)
    gold = {i: str(i % 4) for i in range(40)}
    out = resampling.subset_accuracy(df, spark.createDataFrame(list(gold.items()), "id long, gold string"), F.col("sure"), draws=30)
    assert "Generate" not in plan_of(out)  # a draw is no row
    want = {}
    for k in (2, 3, 4):
        right = np.zeros(3)
        for i in range(40):
            own = [r for r in rows if r[0] == i]
            for rep in range(30):
                got = sorted(own, key=lambda r: (draw("s", rep, i, r[1]), r[1]))[:k]
                some = [r for r in got if r[2] is not None]
                firsts = {a: (-sum(r[2] == a for r in some), min(r[1] for r in some if r[2] == a)) for a in {r[2] for r in some}}
                right += [min(firsts, key=firsts.get, default="0") == gold[i], min(got, key=lambda r: (r[4], r[5], r[1]))[2] == gold[i], bool(some) and max(some, key=lambda r: (r[6], -r[1]))[2] == gold[i]]
        want[k] = right / 1200
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == {2, 3, 4}
    for k in got:
        assert got[k]["trials"] == 1200 and [got[k][c] for c in ("majority", "first_finish", "best_prefix")] == pytest.approx(list(want[k]))


def test_votes_are_resampled_in_arrays(spark, monkeypatch):
    rows, df = drawn_ballots(spark)
    out = resampling.bootstrap_vote(df, 25)
    assert "Generate" not in plan_of(out)  # a draw is no row
    got = {r["id"]: r["answer"] for r in out.collect()}
    want = {}
    for i in range(40):
        own, wins = [r for r in rows if r[0] == i and r[2] is not None], {}
        for rep in range(25 if own else 0):
            picked = [own[int(draw("v", i, rep, d) * len(own))] for d in range(len(own))]
            tally = {a: (round(sum(math.exp(2 * r[3]) for r in picked if r[2] == a), 9), -min(d for d, r in enumerate(picked) if r[2] == a)) for a in {r[2] for r in picked}}
            best = max(tally, key=tally.get)
            wins.setdefault(best, []).append(rep)
        if own:
            want[i] = max(wins, key=lambda a: (len(wins[a]), -wins[a][0]))
    assert got == want


def task_of(monkeypatch, make):
    """The function that a plan runs in its tasks, and the batches that it gets."""
    seen = []
    kind, real = type(make()), type(make()).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema: seen.append((f, df)) or real(df, f, schema))
    make()
    return seen[-1][0], seen[-1][1].coalesce(1).toArrow().to_batches(max_chunksize=16)


def test_problems_of_all_sizes_are_hashed_together(monkeypatch):
    sizes = np.array([3, 1, 60, 2, 3, 0, 7, 2] * 20)
    starts, tails = np.cumsum(sizes) - sizes, [b"|%d" % (i * 977) for i in range(sizes.sum())]
    keys, calls, real = draws.Keys([b"s|"] * len(tails), tails), [], draws.Keys.leading
    monkeypatch.setattr(draws.Keys, "leading", lambda self, middle: calls.append(len(self.tail)) or real(self, middle))
    monkeypatch.setattr(draws, "KEYS", 1000)
    seen = {}
    for problems, reps, u in draws.drawn(keys, starts, sizes, np.flatnonzero(sizes), range(5, 9)):
        for r, rep in enumerate(reps):
            seen |= {(p, rep): u[r, :, i].tolist() for i, p in enumerate(problems)}
    assert seen == {(p, rep): [int(hashlib.md5(b"s|%d" % rep + tails[starts[p] + i]).hexdigest()[:13], 16) for i in range(sizes[p])] for p in np.flatnonzero(sizes) for rep in range(5, 9)}
    assert sum(calls) == 4 * sizes.sum() and len(calls) <= 4 * 2  # not a call for each size


def test_votes_stop_only_when_the_answer_is_settled(spark, monkeypatch):
    """Two ballots of equal weight tie in half of the replicates; one heavy ballot of four wins nearly all."""
    light = [(i, p, a, -0.5, i) for i in range(60) for p, a in enumerate("ab" if i < 40 else "abba" if i < 50 else "aabbcbca" * 3)]
    df = spark.createDataFrame(light + [(100, p, "xyzz"[p], 0.0 if p == 0 else -9.0, 0) for p in range(4)] + [(101, p, "q", -1.0, 0) for p in range(3)], "id long, pos int, ans string, logp double, len int")
    f, batches = task_of(monkeypatch, lambda: resampling.bootstrap_vote(df, 200))
    made, real = {}, draws.Keys.leading
    monkeypatch.setattr(draws.Keys, "leading", lambda self, middle: [made.update({h: made.get(h, 0) + 1}) for h in self.head.tolist()] and real(self, middle))
    got = {r["id"]: r["answer"] for out in f(iter(batches)) for r in out.to_pylist()}
    own = {}
    for r in df.orderBy("id", "pos").collect():
        own.setdefault(r["id"], []).append(r)
    for i, b in own.items():
        wins = {}
        for rep in range(200):
            picked = [b[int(draw("v", i, rep, d) * len(b))] for d in range(len(b))]
            tally = {a: (round(sum(math.exp(2 * r["logp"]) for r in picked if r["ans"] == a), 9), -min(d for d, r in enumerate(picked) if r["ans"] == a)) for a in {r["ans"] for r in picked}}
            wins.setdefault(max(tally, key=tally.get), []).append(rep)
        ranked = sorted(wins, key=lambda a: (-len(wins[a]), wins[a][0]))
        assert got[i] == ranked[0]
        if len(ranked) > 1 and len(wins[ranked[0]]) - len(wins[ranked[1]]) < 5:
            assert made[b"v|%d|" % i] == 200 * len(b)  # a close vote is drawn to its end
    assert made[b"v|100|"] < 200 * 4 and b"v|101|" not in made


def test_subsets_are_judged_once_and_looked_up(spark, monkeypatch):
    """Problems of up to 14 samples, with answers that are never right, equal scores and missing answers."""
    rng = random.Random(5)
    rows = [(i, p, rng.choice(["0", "1", "2", None]), rng.random() < 0.4, rng.randrange(3), rng.choice([-1.0, -0.5])) for i in range(90) for p in range(1 + i % 14)]
    gold = {i: str(i % 5) for i in range(90)}
    df = spark.createDataFrame(rows, "id long, pos int, ans string, trunc boolean, len int, sure double")
    f, batches = task_of(monkeypatch, lambda: resampling.subset_accuracy(df, spark.createDataFrame(list(gold.items()), "id long, gold string"), F.col("sure"), draws=20))
    made, real = [], draws.Keys.part
    monkeypatch.setattr(draws.Keys, "part", lambda self, at: made.extend(self.tail[at].tolist()) or real(self, at))
    right, trials = np.zeros((3, 3), np.int64), 0
    for r in (r for out in f(iter(batches)) for r in out.to_pylist()):
        right[r["k"] - 2] += [r["majority"], r["first_finish"], r["best_prefix"]]
        trials += r["trials"]
    want = np.zeros((3, 3), np.int64)
    for i in range(90):
        own = [r for r in rows if r[0] == i]
        for rep in range(20):
            order = sorted(own, key=lambda r: (draw("s", rep, i, r[1]), r[1]))
            for k in (2, 3, 4):
                got = order[:k]
                some = [r for r in got if r[2] is not None]
                firsts = {a: (-sum(r[2] == a for r in some), min(r[1] for r in some if r[2] == a)) for a in {r[2] for r in some}}
                want[k - 2] += [min(firsts, key=firsts.get, default="0") == gold[i], min(got, key=lambda r: (r[3], r[4], r[1]))[2] == gold[i], bool(some) and max(some, key=lambda r: (r[5], -r[1]))[2] == gold[i]]
    assert trials == 3 * 90 * 20 and right.tolist() == want.tolist()
    drawn = {int(t.split(b"|")[1]) for t in made}
    assert drawn and not any(i % 14 < 2 or i % 5 > 2 for i in drawn)  # neither with all samples in each subset, nor without a right one


def test_bootstrap_ci_weighs_every_unit_in_every_replicate(spark):
    rows = [(i * 31, float(i % 3 == 0)) for i in range(90)]
    out = dict(zip(("n", "mean", "low", "high"), resampling.bootstrap_ci(spark.createDataFrame(rows, "id long, v double"), "v", 80).first()))
    means = []
    for rep in range(80):
        w = [sum(hashlib.md5(f"b|{rep // 8}|{i}".encode()).hexdigest()[rep % 8 * 4 : rep % 8 * 4 + 4] >= c for c in resampling.POISSON) for i, _ in rows]
        means.append(sum(x * v for x, (_, v) in zip(w, rows)) / sum(w))
    means.sort()
    assert (out["low"], out["high"]) == pytest.approx((means[2], means[77])) and out["n"] == 90
    sql = plans.oracle_sql()["bootstrap_ci"]
    assert "|| id" in sql and "lgamma" not in sql  # the SQL draws for units too, not once a replicate


def test_ballots_are_dealt_by_rows(spark):
    """A task's rows, and so its memory, do not grow with the table."""
    rows = spark.range(5000).withColumn("l_orderkey", F.col("id") % 1700)
    out = adapters.dealt(rows, "l_orderkey", 250)
    assert out.rdd.getNumPartitions() == 20
    assert sorted(r[0] for r in out.select("id").collect()) == list(range(5000))
    place = out.withColumn("p", F.spark_partition_id())
    assert place.select("l_orderkey", "p").distinct().count() == 1700
    few = adapters.dealt(rows, "l_orderkey", 5000)
    assert "RepartitionByExpression" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_range_of_a_value_is_the_number_of_cuts_passed(spark):
    rng = random.Random(4)
    kinds = spark.createDataFrame([], "a int, b long").schema
    df = spark.createDataFrame([(rng.randrange(30), i) for i in range(200)], "a int, b long").select(F.struct(F.col("a").alias("a"), F.col("b").alias("b")).alias("at"))
    for n in (0, 1, 2, 3, 9, 40):
        cuts = sorted((rng.randrange(30), rng.randrange(200)) for _ in range(n))
        for r in df.select("at", ranges.passed(cuts, kinds, F.col("at")).alias("n")).collect():
            assert r["n"] == sum(c <= tuple(r["at"]) for c in cuts)


def test_running_works_its_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(2000).mapInArrow(count, "id long")
    assert ranges.running(df, [F.col("id")], {"s": F.col("id")}, most=0, ranges=7).agg(F.max("s")).first()[0] == 1999000
    assert seen.value == 2000


def test_block_files_are_as_many_as_their_rows_ask_for(spark, monkeypatch):
    """No task is given half of the documents to write, and the blocks are those of one file."""
    monkeypatch.setattr(files, "FILE_ROWS", 30)
    path = files.block_files(spark, SF)
    found = spark.read.text(path, wholetext=True).count()
    docs = adapters.table(spark, SF, "documents").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    assert found >= docs.count() / 30 > 2
    assert files.header_count(spark, SF).first()[0] == docs.select("doc_id").distinct().count()


def test_whole_numbers_are_taken_as_they_are(spark):
    odd = ["0", "-0", "00", "007", "-7", "- 7", "5\n", "\n5", "12.0", "12.5", "1e3", "1_000", "1__0", "", ".", "-", "$1,234", "9" * 40, "-" + "9" * 40, "abc", "1 2", "+5", "5.", "?", "٣", None]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    sql.register(spark)
    for r in df.select("t", text.parse_int(F.col("t")).alias("a"), F.expr("parse_int(t)").alias("b"), text.parse_int(F.concat(F.lit(" "), F.col("t"))).alias("c")).collect():
        assert r["a"] == r["b"] == r["c"], r
    assert text.CANONICAL[:-2] in plan_of(df.select(text.parse_int(F.col("t"))))  # one test serves most texts


def test_systems_stand_beside_the_base_after_one_sort(spark):
    """No join of the answers with themselves: each would hold two more sorts in a task of a large table."""
    rng = random.Random(21)
    rows = [(i, s, rng.choice("012"), rng.choice([True, False, False, None])) for i in range(90) for s in ("s0", "s1", "s2") if rng.random() < 0.9]
    rows += [(500 + i, "rare", "1", True) for i in range(5)] + [(None, s, "1", True) for s in ("s0", "s1", "s2")]
    answers = spark.createDataFrame(rows, "id long, system string, answer string, ok boolean")
    by = defaultdict(dict)
    for i, s, a, ok in rows:
        if i is not None and s in ("s0", "s1", "s2"):
            by[i][s] = (a, ok)
    full = {i: p for i, p in by.items() if len(p) == 3}
    own = systems.covered(answers, 50)
    assert own.columns == answers.columns
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, own.collect()), key=key) == sorted(((i, s, *v) for i, p in full.items() for s, v in p.items()), key=key)
    pairs = {s: [(p[s], p["s0"]) for p in full.values()] for s in ("s1", "s2")}
    only = lambda x, y: bool(x) and y is False
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (lambda x: systems.rescue_harm(x, "s0"), lambda x: systems.pair_scores(x, "s0"), lambda x: systems.mcnemar(x, "s0", "s1")):
            plan = plan_of(f(systems.covered(answers, 50)))
            assert "SortMergeJoin" not in plan and plan.count(" Sort [") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = {r["system"]: r.asDict() for r in systems.rescue_harm(own, "s0").collect()}
    for s, both in pairs.items():
        assert got.pop(s) == {"system": s, "n": len(both), "rescued": sum(only(x[1], y[1]) for x, y in both), "harmed": sum(only(y[1], x[1]) for x, y in both), "differing": sum(x[0] != y[0] for x, y in both)}
    assert not got
    for s in pairs:
        r = systems.mcnemar(own, "s0", s).first()
        assert (r["b"], r["c"]) == (sum(only(y[1], x[1]) for x, y in pairs[s]), sum(only(x[1], y[1]) for x, y in pairs[s]))
    same = systems.mcnemar(own, "s0", "s0").first()
    assert (same["b"], same["c"]) == (0, 0)
    wrong = {s: [x[0] == y[0] for x, y in both if x[1] is False and y[1] is False] for s, both in pairs.items()}
    assert {r["system"]: r["wrong_same"] for r in systems.pair_scores(own, "s0").collect()} == {s: pytest.approx(sum(w) / len(w), abs=1e-6) for s, w in wrong.items()}


@pytest.mark.parametrize("name", ["policy_mix_1_3", "policy_mix_3_1", "category_accuracy", "nested_cv"])
def test_no_step_by_problem_leaves_the_dealt_tasks(spark, monkeypatch, name):
    """Windows, tallies, unions and joins by problem take as many tasks as the ballots were dealt to, whatever the session's shuffle partitions."""
    monkeypatch.setattr(adapters.dealt, "__defaults__", (500,))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(plans.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = re.findall(r"hashpartitioning\((?:l_orderkey|o_orderkey|id)#\d+L?, (\d+)\)", plan)
    assert found and {int(n) for n in found} == {-(-lines // 500)}
