"""Label masks, padding and packing of conversations, and the nucleus cut, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from votemill.operators import corpus, packing, selection

TURNS = "conv_id long, turn long, role string, text string"


def plain_mask(text, most):
    text = text[:most]
    at = text.rfind(packing.MARKER)
    cut = len(text) if at < 0 else at + len(packing.MARKER)
    return len(text), cut, len(text) - cut


def test_masks_and_padding(spark):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["", "short é😀", "a longer text " * 9, packing.MARKER + "quoted", "<|im_start|>assistant"])) for c in range(40) for t in range(rng.randint(1, 6))]
    turns += [(100, 0, "user", None), (101, 0, None, "x"), (102, 0, "assistant", None)]
    texts = {}
    for c, _, role, said in sorted(turns, key=lambda x: (x[0], x[1])):
        texts[c] = texts.get(c, "") + f"<|im_start|>{role or ''}\n{said or ''}<|im_end|>\n"
    conv = corpus.conversations(spark.createDataFrame(turns, TURNS))
    masks = packing.label_masks(packing.rendered(conv), 200)
    want = {c: plain_mask(t, 200) for c, t in texts.items()}
    assert {r["conv_id"]: (r["length"], r["cut"], r["labelled"]) for r in masks.collect()} == want
    got = sorted(packing.padded(masks, 5).collect(), key=lambda r: (r["batch"], r["place"]))
    assert [r["conv_id"] for r in got] == sorted(texts)
    for i in range(0, len(got), 5):
        longest = max(r["length"] for r in got[i : i + 5])
        assert [r["padding"] for r in got[i : i + 5]] == [longest - r["length"] for r in got[i : i + 5]]
    assert packing.label_masks(packing.rendered(conv.limit(0))).count() == 0


@pytest.mark.parametrize("within", [10_000, 150])
def test_packs(spark, within):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 1000), 1000, 0])) for i in range(900)] + [(5000, 4000)] + [(6000, 10)] * 40
    got = packing.packed(spark.createDataFrame(rows, "conv_id long, length int"), 1000, within=within).collect()
    assert sorted((r["conv_id"], r["length"]) for r in got) == sorted(rows)
    parts, packs = {}, {}
    for r in got:
        parts.setdefault(r["part_"], []).append(r)
        packs.setdefault(r["pack"], []).append(r)
    assert sorted(packs) == list(range(len(packs))) and (len(parts) == 1) == (within == 10_000)
    for own in packs.values():
        own.sort(key=lambda r: (r["start"], r["length"]))
        assert len({r["part_"] for r in own}) == 1 and sum(r["length"] for r in own) <= 1000 or len(own) == 1
        assert all(b["start"] == a["start"] + a["length"] for a, b in zip(own, own[1:])) and own[0]["start"] == 0
    for own in parts.values():  # the plain way: each example, longest first, into the first row that has room
        bins = []
        for n, _ in sorted(((r["length"], r["conv_id"]) for r in own), key=lambda x: (-x[0], x[1])):
            room = next((b for b in bins if sum(b) + n <= 1000), None)
            room.append(n) if room is not None else bins.append([n])
        base = min(r["pack"] for r in own)
        assert sorted(sorted(b) for b in bins) == sorted(sorted(x["length"] for x in packs[base + k]) for k in range(len(bins)))
    total = sum(min(n, 1000) for _, n in rows)
    assert len(packs) <= 1.25 * total / 1000 + len(parts)


def test_packing_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "conv_id long, length int"), 100).count() == 0


def plain_nucleus(given, free, omega, tau, temperature, top_p):
    tokens = sorted({*given, *free})
    log_softmax = lambda x: [v - max(x) - math.log(sum(math.exp(u - max(x)) for u in x)) for v in x]
    g, f = (log_softmax([d.get(t, -30.0) for t in tokens]) for d in (given, free))
    mixed = -sum(math.exp(x) * x for x in g) > tau
    p = [math.exp(x) for x in log_softmax([((1 - omega) * b + omega * a if mixed else a) / temperature for a, b in zip(g, f)])]
    out, before = {}, 0.0
    for v, t in sorted(zip(p, tokens), key=lambda x: (-x[0], x[1])):
        if before <= top_p:
            out[t] = v
        before += v
    return {t: (mixed, v / sum(out.values())) for t, v in out.items()}


def test_nucleus(spark):
    rng = random.Random(3)
    lists = {i: tuple({t: rng.gauss(0, 2) for t in rng.sample(range(12), rng.randint(1, 9))} for _ in range(2)) for i in range(60)}
    lists[60] = ({1: 0.0, 2: -800.0}, {})
    lists[61] = ({}, {3: 1.0})
    tables = [spark.createDataFrame([(i, t, x) for i, pair in lists.items() for t, x in pair[k].items()], "id long, token long, x double") for k in (0, 1)]
    for omega, tau, temperature, top_p in ((1.5, 1.5, 0.7, 0.8), (1.5, 0.5, 1.0, 0.95), (1.0, 9.0, 0.7, 0.0)):
        got = {}
        for r in selection.nucleus(*tables, omega, tau, temperature, top_p).collect():
            got.setdefault(r["id"], {})[r["token"]] = (r["mixed"], r["p"])
        for i, pair in lists.items():
            want = plain_nucleus(*pair, omega, tau, temperature, top_p)
            assert got[i].keys() == want.keys()
            assert all(got[i][t][0] == want[t][0] and got[i][t][1] == pytest.approx(want[t][1], abs=1e-6) for t in want)
    assert {r["s"] for r in selection.nucleus(*tables).groupBy("id").agg(F.round(F.sum("p"), 9).alias("s")).collect()} == {1.0}
