"""Resampling statistics with hash-seeded draws, and the iterative estimators.

A draw is a hash of (seed, replicate, unit), so that every one can be repeated. Draws for units and ballots are made inside tasks, in arrays
(draws.py); only replicates of a few rows are rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.draws import KEYS, Keys, drawn, flat, key
from votemill.operators.votes import rounded, valid


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the md5 of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: The coefficients of the approximation of the normal quantile.
NORMAL = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function by rational approximation (relative error below 1.2e-9)."""
    a, b, c, d = NORMAL
    poly = lambda xs, x: _horner(xs, x)
    q = p - 0.5
    r = q * q
    tail = lambda y: poly(c, F.sqrt(-2 * F.log(y))) / poly(d, F.sqrt(-2 * F.log(y)))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(q * poly(a, r) / poly(b, r))


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + k
    return out


def replicates(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


#: Poisson(1) distribution in 65536ths, for weights 1, 2, ... 6, as hexadecimal digits.
POISSON = tuple(f"{round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k))):04x}" for k in range(1, 7))


#: Standard deviations from the mean within which a binomial distribution is added up.
TERMS_SD = 12


def bootstrap_ci(units: DataFrame, value: str, n: int = 2000, seed: str = "b") -> DataFrame:
    """Mean and its 95 % interval from index percentiles of Poisson-weighted replicates.

    Weights are Poisson(1) draws (cut at 6) from four hexadecimal digits a unit and replicate; one md5 serves eight replicates. A task draws
    them for a batch of units at a time and keeps two sums a replicate.
    """
    cuts = np.array([int(s, 16) for s in POISSON], np.uint16)

    def sums(batches):
        top, weight = np.zeros(-(-n // 8) * 8), np.zeros(-(-n // 8) * 8, np.int64)
        for batch in batches:
            tails, v = batch.column(1).to_pylist(), flat(batch.column(0), np.float64, 0.0)
            for at in range(0, len(tails), KEYS):
                own, keys = v[at : at + KEYS], Keys([f"{seed}|".encode()] * len(tails[at : at + KEYS]), tails[at : at + KEYS])
                for block in range(-(-n // 8)):
                    w = np.searchsorted(cuts, keys.digests(str(block).encode()).view(">u2").astype(np.uint16), "right")
                    top[block * 8 : block * 8 + 8] += own @ w
                    weight[block * 8 : block * 8 + 8] += w.sum(0)
        yield pa.RecordBatch.from_pydict({"rep": np.arange(n, dtype=np.int32), "top": top[:n], "weight": weight[:n]})

    reps = units.select(F.col(value).cast("double").alias("v"), key(F.col("id")).alias("key")).mapInArrow(sums, "rep int, top double, weight long")
    means = reps.groupBy("rep").agg((F.sum("top") / F.nullif(F.sum("weight"), F.lit(0))).alias("m"))
    i = F.row_number().over(Window.orderBy("m", "rep")) - 1  # a row a replicate
    ends = means.withColumn("i", i).agg(F.max(F.when(F.col("i") == int(n * 0.025), F.col("m"))).alias("low"), F.max(F.when(F.col("i") == int(n * 0.975) - 1, F.col("m"))).alias("high"))
    return units.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(F.broadcast(ends))  # one row each


def binomial(n: Column, p: Column, u: Column) -> Column:
    """Binomial draws by inversion: the smallest k whose distribution function reaches u. The terms within TERMS_SD deviations of the mean
    are added up, once for each (n, p) of a batch; what lies beyond is less than u can resolve."""

    @F.pandas_udf("long")
    def draw(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
        out = np.zeros(len(n), np.int64)
        for (size, chance), at in pd.DataFrame({"n": n, "p": p}).groupby(["n", "p"]).indices.items():
            out[at] = size if chance >= 1 else 0
            if 0 < chance < 1:
                reach = TERMS_SD * math.sqrt(size * chance * (1 - chance)) + 2
                low, high = max(0, int(size * chance - reach)), min(int(size), int(size * chance + reach))
                k = np.arange(low, high + 1)
                first = math.lgamma(size + 1) - math.lgamma(low + 1) - math.lgamma(size - low + 1) + low * math.log(chance) + (size - low) * math.log1p(-chance)
                logs = first + np.concatenate([[0.0], np.cumsum(np.log(size - k[:-1]) - np.log(k[1:]) + math.log(chance) - math.log1p(-chance))])
                out[at] = np.minimum(low + np.searchsorted(np.cumsum(np.exp(logs)), u.to_numpy()[at], "left"), high)
        return pd.Series(out)

    return draw(n.cast("long"), p.cast("double"), u)


def bootstrap_share(units: DataFrame, hit: str, n: int = 2000, seed: str = "b") -> DataFrame:
    """n, mean, low and high: the share of units with `hit` 1 and its 95 % interval from index percentiles of resampled shares.

    Drawing as many units with replacement gives a binomial number of hits, so that a replicate is one row, however many units there are.
    """
    own = units.agg(F.count("*").alias("n"), F.avg(hit).alias("mean")).filter("n > 0")  # one row
    reps = replicates(own, n).withColumn("m", binomial(F.col("n"), F.col("mean"), uniform(F.lit(seed), F.col("rep"))) / F.col("n"))
    i = F.row_number().over(Window.orderBy("m", "rep")) - 1  # a row a replicate
    ends = reps.withColumn("i", i).agg(F.max(F.when(F.col("i") == int(n * 0.025), F.col("m"))).alias("low"), F.max(F.when(F.col("i") == int(n * 0.975) - 1, F.col("m"))).alias("high"))
    return own.join(F.broadcast(ends))  # one row each


def permutation_max(units: DataFrame, n: int = 2000, seed: str = "p") -> DataFrame:
    """The largest cell mean of `v` over cells, and how often sign-flipped replicates reach it.

    Of the c units of a cell with one value, a binomial number keeps its sign, so that a replicate is a row for each cell and value.
    """
    kinds = units.groupBy("cell", "v").agg(F.count("*").alias("c"))
    cells = kinds.groupBy("cell").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("m")).agg(F.max("m").alias("observed"))
    kept = binomial(F.col("c"), F.lit(0.5), uniform(F.lit(seed), F.col("rep"), F.col("cell"), F.col("v")))
    trial = replicates(kinds, n).withColumn("s", F.col("v") * (2 * kept - F.col("c"))).groupBy("rep", "cell").agg((F.sum("s") / F.sum("c")).alias("m")).groupBy("rep").agg(F.max("m").alias("top"))
    reached = F.round("top", 12) >= F.round("observed", 12)
    return trial.join(F.broadcast(cells)).agg(F.max("observed").alias("observed"), F.count("*").alias("trials"), ((F.count(F.when(reached, 1)) + 1) / (F.count("*") + 1)).alias("p"))  # cells: one row


#: Fixed value: the two-sided 5 % point of the normal distribution, as the power study has it.
CRITICAL = 1.959964


def power(pairs: DataFrame, deltas=(0.005, 0.01, 0.02), trials: int = 4000, seed: str = "w") -> DataFrame:
    """Share of simulated comparisons that a corrected McNemar test finds, for systems that truly differ by delta.

    pairs: a, b, n and discordant (their share of problems that one of the two gets right). Of round(n * discordant) pairs, each goes to the
    better system with 1/2 + delta / (2 discordant); power is null where that is no probability, and 0 with no pair. A trial's count is a
    binomial draw by inversion: one uniform number against the two tails in which the test rejects, so a trial is one row.
    """

    def tails(batches):
        for frame in batches:
            low, high = [], []
            for m, p in zip(frame["m"], frame["p"]):
                k = np.arange(int(m) + 1)
                logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(m) + 1)))])
                mass = np.exp(logs[-1] - logs - logs[::-1] + k * math.log(p) + (int(m) - k) * math.log1p(-p))
                found = np.abs(2 * k - int(m)) - 1 > CRITICAL * math.sqrt(int(m))
                low.append(float(mass[found & (2 * k < m)].sum()))
                high.append(float(mass[found & (2 * k > m)].sum()))
            yield frame.assign(low=low, high=high)

    grid = pairs.withColumn("delta", F.explode(F.array(*map(F.lit, deltas)))).withColumns({"m": F.rint(F.col("n") * F.col("discordant")).cast("long"), "p": F.lit(0.5) + F.col("delta") / (2 * F.col("discordant"))})
    fit = (F.col("n") * F.col("discordant") >= 1) & (F.col("p") < 1)
    able = grid.filter(fit).select("a", "b", "n", "delta", "m", "p").repartition("a", "b", "delta")  # a row a pair of systems and delta
    able = able.mapInPandas(tails, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in able.schema) + ", low double, high double")
    u = uniform(F.lit(seed), F.col("rep"), F.col("a"), F.col("b"), F.col("delta"))
    hits = replicates(able, trials).groupBy("a", "b", "delta").agg(F.avg(((u < F.col("low")) | (u >= 1 - F.col("high"))).cast("int")).alias("hits"))
    none = F.when(F.col("n") * F.col("discordant") < 1, 0.0)
    return grid.join(hits, ["a", "b", "delta"], "left").select("a", "b", "n", F.col("m").alias("discordant_pairs"), "delta", F.coalesce("hits", none).alias("power"))


def packed(rows: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """id, what `by` names, and b: the samples of one problem in order of pos."""
    return rows.groupBy("id", *by).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("b"))


#: Packed problems that are drawn for together, in several batches of Arrow.
TOGETHER = 50_000


def joined(batches):
    """Batches put together to TOGETHER problems or a few more, so that many keys are hashed at once."""
    some = []
    for batch in batches:
        some.append(batch)
        if sum(map(len, some)) >= TOGETHER:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def unpacked(batch: pa.RecordBatch):
    """Of a batch of packed problems: how many samples each has, where they begin, and the samples' columns by name."""
    b = batch.column(batch.schema.get_field_index("b"))
    sizes = pc.fill_null(pc.list_value_length(b), 0).to_numpy().astype(np.int64)
    rows = b.flatten()
    return sizes, np.cumsum(sizes) - sizes, {f.name: c for f, c in zip(rows.type, rows.flatten())}


def codes(answers: pa.Array) -> np.ndarray:
    """Equal numbers for equal answers, -1 for none."""
    return pc.fill_null(answers.dictionary_encode().indices, -1).to_numpy().astype(np.int64)


#: Replicates between two looks at which problems are decided, once more than half of all are drawn, and samples of a problem up to which
#: draws are counted by comparison.
LOOK, COMPARED = 20, 16


def resampled_winners(u: np.ndarray, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Number of the answer that wins each resampled vote, by problem and replicate.

    u: hashes by replicate, sample and problem; own, weight: each sample's answer and weight, by sample and problem. Sums are products of weights
    and of how often each sample is drawn; among equal sums, the answer that is drawn first wins.
    """
    n, k, m = u.shape
    pick = (u.astype(np.float64) * (k / (1 << 52))).astype(np.min_scalar_type(k)).transpose(1, 2, 0).copy()  # draw, problem, replicate
    if k <= COMPARED:
        times = np.empty((m, k, n))
        for i in range(k):
            count = (pick[0] == i).astype(np.uint8)
            for d in range(1, k):
                count += pick[d] == i
            times[:, i] = count
    else:
        cell = (np.arange(m)[:, None] * k + pick) * n + np.arange(n)
        times = np.bincount(cell.ravel(), minlength=m * k * n).reshape(m, k, n).astype(np.float64)
    kinds = int(own.max()) + 1
    share = np.where(own == np.arange(kinds)[:, None, None], weight, 0.0).transpose(2, 0, 1)
    total = np.rint(np.ascontiguousarray(share) @ times * 1e9)  # problem, answer, replicate
    top, won, tied = total[:, 0].copy(), np.zeros((m, n), np.int64), np.zeros((m, n), bool)
    for j in range(1, kinds):
        more = total[:, j] > top
        tied &= ~more
        tied |= total[:, j] == top
        won[more] = j
        np.maximum(top, total[:, j], top)
    p, r = np.nonzero(tied)
    for d in reversed(range(k if len(p) else 0)):
        answer = own[pick[d, p, r], p]
        best = total[p, answer, r] == top[p, r]
        won[p[best], r[best]] = answer[best]
    return won


def bootstrap_vote(ballots: DataFrame, n: int = 200, scale: float = 2.0, seed: str = "v") -> DataFrame:
    """The answer that wins most of n resampled weighted votes of its problem, all after one exchange by id.

    Each replicate draws as many ballots as there are, with replacement: ballot number floor(u k) of the valid ones. A task draws for many
    problems at once, and what leaves it is one row a problem. Only draws that cannot change the answer are left out: those of problems with
    one answer, and those of problems where one answer leads by more replicates than are left.
    """

    def winners(batches):
        for batch in joined(batches):
            sizes, starts, samples = unpacked(batch)
            answer, weight = codes(samples["ans"]), np.exp(flat(samples["logp"], np.float64, -np.inf) * scale)
            head = [f"{seed}{k.decode()}|".encode() for k in batch.column(1).to_pylist()]
            # answers are numbered within each problem, from its place on; `some` is a ballot with each
            span = int(answer.max(initial=0)) + 1
            pairs, some, own = np.unique(np.repeat(np.arange(len(sizes)), sizes) * span + answer, return_index=True, return_inverse=True)
            problem = pairs // span
            place, kinds = np.searchsorted(problem, np.arange(len(sizes))), np.bincount(problem, minlength=len(sizes))
            own = own - np.repeat(place, sizes)
            wins, first = np.zeros(len(pairs), np.int64), np.full(len(pairs), n, np.int64)
            numbers, widths = [b"|%d" % d for d in range(int(sizes.max(initial=0)))], np.fromiter(map(len, head), np.int64, len(head))
            for width in np.unique(widths[kinds > 1]):
                left = np.flatnonzero((widths == width) & (kinds > 1))
                keys, begin = Keys([head[p] for p in left for _ in range(sizes[p])], [t for p in left for t in numbers[: sizes[p]]]), np.zeros(len(sizes), np.int64)
                begin[left] = np.cumsum(sizes[left]) - sizes[left]
                looks = [0, *range(n // 2 + 1, n, LOOK), n]
                for done, until in zip(looks, looks[1:]):
                    for g, reps, u in drawn(keys, begin, sizes, left, range(done, until)):
                        at = starts[g] + np.arange(u.shape[1])[:, None]
                        won, most = resampled_winners(u, own[at], weight[at]), int(kinds[g].max())
                        count = np.bincount((np.arange(len(g))[:, None] * most + won).ravel(), minlength=len(g) * most).reshape(-1, most)
                        mine = np.arange(most) < kinds[g][:, None]
                        wins[(place[g][:, None] + np.arange(most))[mine]] += count[mine]
                        np.minimum.at(first, (place[g][:, None] + won).ravel(), np.tile(np.array(reps), len(g)))  # at() misreads operands that it has to broadcast
                    pair = np.flatnonzero(np.isin(problem, left))
                    rank = pair[np.lexsort((-wins[pair], problem[pair]))]
                    lead = np.flatnonzero(np.diff(problem[rank], prepend=-1))
                    left = left[wins[rank[lead]] - wins[rank[lead + 1]] <= n - until]
            order, voted, best = np.lexsort((first, -wins, problem)), kinds > 0, np.zeros(len(sizes), np.int64)
            best[voted] = some[order[place[voted]]]
            yield pa.RecordBatch.from_arrays([batch.column(0), samples["ans"].take(pa.array(best))], ["id", "answer"])

    rows = packed(ballots.filter(valid()), "ans", "logp").select("id", key(F.col("id")).alias("key"), F.transform("b", lambda x: F.struct(x["ans"].cast("string").alias("ans"), x["logp"].cast("double").alias("logp"))).alias("b"))
    return rows.mapInArrow(winners, f"id {rows.schema['id'].dataType.simpleString()}, answer string")


#: Samples of a problem up to which its subsets are judged once and looked up.
LISTED = 10


def ranks(u: np.ndarray) -> list[np.ndarray]:
    """How many samples of the problem come before each by hash, or by number where hashes are equal. u: hashes by replicate, sample and problem."""
    size = u.shape[1]
    out = [np.full((len(u), u.shape[2]), size - 1 - i, np.uint8) for i in range(size)]
    for j in range(size):
        for i in range(j):
            before = (u[:, i] <= u[:, j]).view(np.uint8)
            out[j] += before
            out[i] -= before
    return out


def subset_accuracy(ballots: DataFrame, gold: DataFrame, prefix: Column, ks=(2, 3, 4), draws: int = 200, seed: str = "s") -> DataFrame:
    """Accuracy of three pickers over draws of k ballots without replacement: majority, first finished, best prefix.

    The first finished is the shortest complete ballot (the shortest one if none is complete), null answers included; the
    best prefix is that of the valid ballot with the highest `prefix`. A problem's ballots meet in one task, which draws for many problems
    at once and keeps four sums for each k. All subsets of a problem are judged first, and a draw looks its own up; where all subsets of
    each k are judged alike (no ballot is right, or none is left out), every draw counts without being made.
    """
    pickers = ("majority", "first_finish", "best_prefix")
    bits = np.arange(1 << len(pickers))[:, None] >> np.arange(len(pickers)) & 1

    def sums(batches):
        trials, right = np.zeros(len(ks), np.int64), np.zeros((len(ks), len(pickers)), np.int64)
        for batch in joined(batches):
            sizes, starts, samples = unpacked(batch)
            answer, hit, nothing = codes(samples["ans"]), flat(samples["hit"], bool, False), flat(batch.column(1), bool, False)
            pos = flat(samples["pos"], np.int64, -1)
            least = np.iinfo(np.int64).min
            fast, sure = np.empty(len(pos), np.int64), np.empty(len(pos), np.int64)
            fast[np.lexsort((pos, flat(samples["len"], np.int64, least), flat(samples["trunc"], np.int64, -1)))] = np.arange(len(pos))
            sure[np.lexsort((-pos, flat(samples["p"], np.float64, -np.inf)))] = np.arange(len(pos))
            sure[answer < 0] = -1

            def judged(own: np.ndarray, zero: np.ndarray) -> np.ndarray:
                """Which pickers are right on sets of samples, a set a row, as bits; zero: whether no valid answer is right."""
                rows, given = np.arange(len(own)), answer[own]
                count, first = np.zeros(own.shape, np.int64), own.copy()
                for other in range(own.shape[1]):
                    same = given == given[:, other : other + 1]
                    count += same
                    np.minimum(first, own[:, other : other + 1], out=first, where=same)
                votes, some = np.where(given < 0, -1, count * (len(pos) + 1) - first), (given >= 0).any(1)
                majority, best = hit[own[rows, votes.argmax(1)]], hit[own[rows, sure[own].argmax(1)]]
                return np.where(some, majority, zero) | hit[own[rows, fast[own].argmin(1)]].astype(np.uint8) << 1 | (some & best).astype(np.uint8) << 2

            able = nothing | (np.bincount(np.repeat(np.arange(len(sizes)), sizes), hit, len(sizes)) > 0)  # else nothing is ever right
            open_, row, judgements = able & (sizes > LISTED), np.zeros(len(sizes), np.int64), {}
            for size in range(1, LISTED + 1):
                own = np.flatnonzero(able & (sizes == size))
                table = np.zeros((len(own), 1 << size), np.uint8)
                for k in ks if len(own) else ():
                    sets = list(combinations(range(size), min(k, size)))
                    at = starts[own][:, None, None] + np.array(sets)
                    made = judged(at.reshape(-1, at.shape[2]), np.repeat(nothing[own], len(sets))).reshape(len(own), -1)
                    table[:, [sum(1 << i for i in s) for s in sets]] = made
                    open_[own] |= (made != made[:, :1]).any(1)
                for j, k in enumerate(ks):
                    right[j] += draws * (np.bincount(table[~open_[own], (1 << min(k, size)) - 1], minlength=len(bits)) @ bits)
                row[own], judgements[size] = np.arange(len(own)), table
            trials += draws * np.count_nonzero(sizes)
            keys = Keys([f"{seed}|".encode()] * len(pos), samples["key"].to_pylist()) if open_.any() else None
            for g, reps, u in drawn(keys, starts, sizes, np.flatnonzero(open_), range(draws)):
                size = u.shape[1]
                if size <= LISTED:
                    rank, table = ranks(u), judgements[size]
                    for j, k in enumerate(ks):
                        drew = row[g] << size
                        drew = drew + sum((rank[i] < k) * np.uint16(1 << i) for i in range(size))
                        right[j] += np.bincount(table.ravel()[drew.ravel()], minlength=len(bits)) @ bits
                else:
                    own = (starts[g] + u.argsort(1, kind="stable")[:, : max(ks)]).transpose(0, 2, 1).reshape(len(reps) * len(g), -1)
                    for j, k in enumerate(ks):
                        right[j] += np.bincount(judged(own[:, :k], np.tile(nothing[g], len(reps))), minlength=len(bits)) @ bits
        yield pa.RecordBatch.from_pydict({"k": np.array(ks, np.int32), "trials": trials} | {name: right[:, i] for i, name in enumerate(pickers)})

    rows = ballots.select("id", F.col("pos").cast("long").alias("pos"), "ans", "trunc", F.col("len").cast("long").alias("len"), rounded(prefix).alias("p")).join(gold.select("id", "gold"), "id")
    rows = rows.withColumn("hit", F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)))
    rows = packed(rows, "ans", "trunc", "len", "p", "hit", by=("gold",))
    rows = rows.select(F.transform("b", lambda x: F.struct(x["pos"].alias("pos"), x["ans"].alias("ans"), x["trunc"].alias("trunc"), x["len"].alias("len"), x["p"].alias("p"), x["hit"].alias("hit"), key(F.col("id"), x["pos"]).alias("key"))).alias("b"), (F.col("gold") == "0").alias("zero"))
    got = rows.mapInArrow(sums, "k int, trials long, " + ", ".join(f"{p} long" for p in pickers)).groupBy("k").agg(F.sum("trials").alias("trials"), *[F.sum(p).alias(p) for p in pickers])
    return got.filter("trials > 0").select("k", "trials", *[(F.col(p) / F.col("trials")).alias(p) for p in pickers])


def reranker(ballots: DataFrame, gold: DataFrame, strengths=(0.0, 0.5, 1.0, 2.0), seed: str = "r") -> DataFrame:
    """Accuracy when the sample with the highest strength * right + N(0, 1) is taken, by strength."""
    rows = ballots.filter(valid()).join(gold, "id").withColumn("z", F.explode(F.array(*map(F.lit, strengths))))
    noise = normal_quantile(F.greatest(F.lit(1e-9), uniform(F.lit(seed), F.col("id"), F.col("pos"))))
    ok = (F.col("ans") == F.col("gold")).cast("double")
    best = rows.withColumns({"s": rounded(F.col("z") * ok + noise), "ok": ok}).groupBy("z", "id").agg(F.max_by("ok", F.struct("s", -F.col("pos"))).alias("ok"))
    return best.groupBy("z").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))


def nested_selection(correct: DataFrame, k: int = 5) -> DataFrame:
    """Rule choice by cross-validation: on each fold, the rule that is best on the other folds. correct: id, rule, ok, fold."""
    cells = correct.groupBy("rule", "fold").agg(F.sum("ok").alias("c"), F.count("*").alias("n"))
    rest = cells.withColumn("rest", F.sum("c").over(Window.partitionBy("rule")) - F.col("c"))
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("rest"), "rule"))
    return rest.withColumn("r", best).filter("r = 1").select("fold", "rule", F.col("c").alias("correct"), "n")


def replicator(vectors: DataFrame, steps: int = 300, tol: float = 1e-10, block: int = 512) -> DataFrame:
    """Replicator dynamics on the clipped cosines of a problem's samples; the answer with the most mass (the first among equals).

    vectors: id, ans, pos, v, of unit length. The sum of a sample's cosines weighted by x is one product with the weighted sum of the
    vectors; only cosines below zero, which are clipped, are held one by one. Samples of a problem meet in one task.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        v = np.stack([np.array(a, float) for a in group["v"]])
        own = (v * v).sum(1)
        rows, columns, below = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a in range(0, len(v), block):
            c = v[a : a + block] @ v.T
            i, j = np.nonzero(c < 0)
            rows.append(i + a)
            columns.append(j)
            below.append(c[i, j])
        row, column, less = np.concatenate(rows), np.concatenate(columns), np.concatenate(below)
        x = np.full(len(v), 1 / len(v))
        for _ in range(steps):
            y = x * (v @ (v.T @ x) - own * x - np.bincount(row, less * x[column], len(v)))
            if y.sum() <= 0:
                break
            y /= y.sum()
            done = np.abs(y - x).sum() < tol
            x = y
            if done:
                break
        mass: dict = {}
        for a, m in zip(group["ans"], x):
            mass[a] = mass.get(a, 0.0) + m
        return pd.DataFrame({"id": [group["id"].iloc[0]], "answer": [max(mass, key=lambda a: round(mass[a], 9))]})

    return vectors.groupBy("id").applyInPandas(run, "id long, answer int")
