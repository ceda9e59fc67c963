"""Exact n-gram Jaccard join with a token-group matrix: components of documents that are near duplicates.

Two documents link when the Jaccard similarity of their shingle sets is at least NUM / DEN; a component is what
links reach. Every pair of different texts that links is either joined by a path of verified links or compared.

1. Documents with equal sets are one class, held by its smallest id.
2. Classes are partitioned into groups of similar documents: classes that share a band of minima are compared
   with the band's first class, and the components of the links found are the groups. So thousands of near
   copies are one group, after as many comparisons, and pairs within a group need none.
3. The token-group matrix has an entry (token, group) for each prefix token of a group's members. A set of n
   shingles in one fixed global order (frequent ones last) must share one of its first n - ceil(t n) + 1 with any
   set it links to, at places that leave room for the needed overlap. A document is a query only against groups
   larger than its own (or of equal size and larger id), since a link between groups is seen from either side.
4. The matrix gives query-group candidates; for groups of several documents, the overlap of the query with the
   union of the group's tokens bounds its overlap with any member, and only groups where it reaches
   ceil(t n) are opened. An opened group's members that share a prefix token are verified exactly; first the one
   that shares most, and after components are merged the rest, for pairs whose groups are still apart.

Nothing is capped: the list of frequent tokens only decides the order. Shingles are 64-bit hashes, sets are
compared whole.

Edge cases: null and empty texts, and texts of white space only, have the empty set, link with nothing and are
their own component; rows that share a doc_id are one node (their links add up), each row is returned; a row
with a null doc_id links with nothing and has a null component; an empty table gives no row; extra columns are
ignored; ties cannot arise, since a component's id is its smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.llm.bpe import slices
from votemill.llm.common import BROADCAST_IDS, in_batches, materialize, restrict, small
from votemill.llm.components import components
from votemill.llm.shingles import U, mix, overlap, shingle_sets

N, NUM, DEN = 5, 75, 100
BANDS, ROWS = 4, 2
#: A shingle in so many documents counts as frequent; the number is doubled until the list has at most
#: FREQUENT_MOST entries (8 MB), however large the corpus. Frequent shingles come last in the order; results do
#: not depend on it, but the number of candidates does.
FREQUENT, FREQUENT_MOST = 8, 500_000
SALT_ROWS = 256


def need(n: np.ndarray | int):
    """The overlap that a set of n shingles must have with any set that it links to."""
    return -(-NUM * n // DEN)


def sets_of(batch: pa.RecordBatch, id_at: int = 0, text_at: int = 1):
    """ids and shingle sets of a batch, a few hundred rows and a megabyte of text at a time."""
    ids = batch.column(id_at)
    for a, b, texts in slices(batch.column(text_at)):
        yield ids.slice(a, b - a).to_pylist(), shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts], N)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set that is not empty: hashes of ROWS minima under different permutations."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), BANDS), U)
    for j in range(BANDS * ROWS):
        low = np.minimum.reduceat(mix(flat ^ mix(np.array([j + 1], U))[0]), start)
        out[:, j // ROWS] = mix(out[:, j // ROWS] * U(31) + low + U(j))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n, digest (hi, lo), bands. Besides, rows with n = -1: a frequent shingle (hi) and its count (lo)."""

    def run(batches):
        seen: list[np.ndarray] = []

        def often(seen) -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(seen), return_counts=True)
            take = count > 1
            k = int(take.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.array(np.full(k, -1, np.int32)), pa.array(token[take].view(np.int64)), pa.array(count[take]), pa.nulls(k, pa.list_(pa.int64()))],
                names=["doc_id", "n", "hi", "lo", "bands"],
            )

        for batch in batches:
            for ids, sets in sets_of(batch):
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, band_keys([sets[i] for i in full]).view(np.int64).tolist()):
                        bands[i] = k
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests[::2]), pa.array(digests[1::2]), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "hi", "lo", "bands"],
                )
                seen.append(np.concatenate(sets))
                if sum(map(len, seen)) > 1_000_000:
                    yield often(seen)
                    seen = []
        if seen:
            yield often(seen)

    return in_batches(docs, run, "doc_id long, n int, hi long, lo long, bands array<long>")


def frequent_tokens(sig: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and the place of each in the order of counts."""
    counts = materialize(sig.filter("n = -1").groupBy("hi").agg(F.sum("lo").alias("c")), "frequent")
    least = FREQUENT
    while counts.filter(F.col("c") >= least).count() > FREQUENT_MOST:
        least *= 2
    found = counts.filter(F.col("c") >= least).toPandas()
    token = found.hi.to_numpy(np.int64).view(U)
    order = np.lexsort((token, found.c.to_numpy()))
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    by = np.argsort(token)
    return token[by], place[by]


def prefixes(docs: DataFrame, frequent) -> DataFrame:
    """token, doc_id, pos of the prefix tokens of every document."""

    def run(batches):
        token, place = frequent.value
        for batch in batches:
            for ids, sets in sets_of(batch):
                out, own, pos = [], [], []
                for i, s in zip(ids, sets):
                    if not len(s) or i is None:
                        continue
                    k = len(s) - need(len(s)) + 1
                    if len(token):
                        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                        common = token[at] == s
                        if common.any():
                            rare = s[~common]
                            s = np.concatenate([rare, s[common][np.argsort(place[at[common]], kind="stable")]]) if len(rare) < k else rare
                    out.append(s[:k])
                    own.append(np.full(k, i, np.int64))
                    pos.append(np.arange(k, dtype=np.int32))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(own)), pa.array(np.concatenate(pos))], names=["token", "doc_id", "pos"])

    return in_batches(docs, run, "token long, doc_id long, pos int")


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, token of whole sets."""

    def run(batches):
        for batch in batches:
            for ids, sets in sets_of(batch):
                own = np.repeat(np.array(ids, np.int64), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "token"])

    return in_batches(docs, run, "doc_id long, token long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link. Members b of a hot a are dealt over salts, and a's text goes once to each."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    load = pairs.groupBy("a").agg(F.count("*").alias("k")).select("a", F.ceil(F.col("k") / SALT_ROWS).cast("int").alias("salts"))
    load = small(materialize(load, "load"))
    dealt = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = materialize(restrict(docs.filter("doc_id IS NOT NULL"), ids, "doc_id"), "texts")
    left = texts.join(load.withColumnRenamed("a", "doc_id"), "doc_id").select(
        F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text"
    )
    if pairs.count() <= BROADCAST_IDS:
        dealt = F.broadcast(dealt)
    right = texts.withColumnRenamed("doc_id", "b").join(dealt, "b").select("a", "salt", "b", "text")
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        now, base = None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            members = batch.column(2).to_pylist()
            at, found = 0, []
            for ids, sets in sets_of(batch, 2, 3):
                for s in sets:
                    key, b = keys[at], members[at]
                    if key != now:
                        now, base = key, []
                    if b is None:
                        base += [s] if not any(np.array_equal(s, x) for x in base) else []
                    elif any(linked(x, s) for x in base):
                        found.append((key[0], b))
                    at += 1
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return in_batches(rows, run, "a long, b long").distinct()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * DEN < max(len(x), len(y)) * NUM or not len(x):
        return False
    both = overlap(x, y)
    return DEN * both >= NUM * (len(x) + len(y) - both)


def enough(q_min: str, q_max: str, x_min: str, x_max: str, shared: str = "shared"):
    """Whether the prefix tokens shared leave room for a link between a set of q_min..q_max and one of x_min..x_max.

    Two sets need an overlap of t / (1 + t) of the sum of their sizes. What they share beyond both prefixes is
    less than t times the larger size, so the prefixes must share the difference at least.
    """
    return (F.col(q_min) != F.col(q_max)) | (F.col(shared) + 1e-6 >= fewest(q_min, x_min, x_max))


def fewest(n: str, x_min: str, x_max: str):
    """The least number of shared prefix tokens with which a set of n can link to one of x_min..x_max (maybe below 1)."""
    t, n = NUM / DEN, F.col(n)
    f = lambda x: t / (1 + t) * (n + x) - t * F.greatest(n, x)  # noqa: E731  least at an end of the range
    return F.least(f(F.greatest(F.col(x_min), F.floor(n * t))), f(F.least(F.col(x_max), F.ceil(n / t))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with an equal set) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialize(signatures(docs), "signatures")
    rows = sig.filter("n >= 0")
    sets = rows.filter("n > 0 AND doc_id IS NOT NULL")

    # 1. Classes of equal sets.
    classes = sets.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    size = classes.select(F.col("rep").alias("doc_id"), "n")

    # 2. Groups: links to the first class of each band.
    bands = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    heads = bands.groupBy("band", "key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("k")).filter("k > 1")
    fits = (F.least("n", "head.n") * DEN >= F.greatest("n", "head.n") * NUM) & (F.col("rep") != F.col("head.rep"))
    star = bands.join(heads, ["band", "key"]).filter(fits).select(F.col("head.rep").alias("a"), F.col("rep").alias("b"))
    links = materialize(verified(star, docs), "links")
    # Rows that share an id but not a set are one node.
    twice = sets.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1")
    both = sets.join(twice, "doc_id", "left_semi").join(classes.select("n", "hi", "lo", "rep"), ["n", "hi", "lo"])
    links = links.unionByName(materialize(both.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a != b").distinct(), "links"))
    found = components(links)

    # 3. The token-group matrix, of shingles that two documents or more have in their prefixes.
    frequent = spark.sparkContext.broadcast(frequent_tokens(sig))
    by_token = Window.partitionBy("token")
    entry = prefixes(docs, frequent).repartition("token")
    entry = entry.withColumns({"x": F.min("doc_id").over(by_token), "y": F.max("doc_id").over(by_token)}).filter("x != y").drop("x", "y")
    group = size.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("grp"))
    group = group.groupBy("doc_id", "grp").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    members = group.groupBy("grp").agg(F.count("*").alias("size"))
    group = materialize(group.join(members, "grp"), "groups")
    entry = materialize(entry.join(group, "doc_id"), "entries")
    matrix = entry.groupBy("token", "grp", "size").agg(F.min("n_min").alias("g_min"), F.max("n_max").alias("g_max"), F.min("pos").alias("g_pos"))
    matrix = matrix.select("token", F.col("grp").alias("g"), F.col("size").alias("g_size"), "g_min", "g_max", "g_pos")
    total = NUM + DEN  # overlap * total >= NUM * (n_q + n_x)
    room = (F.col("pos") * total <= F.col("n_max") * total - NUM * (F.col("n_max") + F.col("g_min"))) & (F.col("g_pos") * total <= F.col("g_max") * total - NUM * (F.col("n_min") + F.col("g_max")))
    fits = (F.col("g_min") * NUM <= F.col("n_max") * DEN) & (F.col("g_max") * DEN >= F.col("n_min") * NUM)
    smaller = F.struct("size", "grp") < F.struct("g_size", "g")
    pairs = entry.join(matrix, "token").filter(smaller & fits)
    pairs = pairs.groupBy("doc_id", "n_min", "n_max", "grp", "g", "g_size").agg(F.count("*").alias("shared"), F.max(room).alias("room"), F.min("g_min").alias("g_min"), F.max("g_max").alias("g_max"))
    pairs = materialize(pairs.filter(F.col("room") & enough("n_min", "n_max", "g_min", "g_max")), "candidates")

    # 4. Bound, then open.
    wide = bounded(pairs.filter("g_size > 1"), group, docs)
    single = pairs.filter("g_size = 1").select("doc_id", "g", F.col("g").alias("x"))
    links = links.unionByName(materialize(verified(single.select(F.col("x").alias("a"), F.col("doc_id").alias("b")), docs), "links"))
    if not wide.isEmpty():
        opened = entry.join(wide, "doc_id").select("token", F.col("doc_id").alias("q"), "g", F.col("n_min").alias("q_min"), F.col("n_max").alias("q_max"))
        inside = entry.select("token", F.col("doc_id").alias("x"), F.col("grp").alias("g"), "n_min", "n_max")
        fits = (F.col("n_min") * NUM <= F.col("q_max") * DEN) & (F.col("n_max") * DEN >= F.col("q_min") * NUM)
        # One member a token first: the links found make most of the rest needless.
        first = inside.groupBy("token", "g").agg(F.min_by(F.struct("x", "n_min", "n_max"), "x").alias("m")).select("token", "g", "m.*")
        best = opened.join(first, ["token", "g"]).filter(fits).groupBy("q", "g", "x").agg(F.count("*").alias("k"))
        best = best.groupBy("q", "g").agg(F.max_by("x", F.struct("k", -F.col("x"))).alias("x"))
        links = links.unionByName(materialize(verified(best.select(F.col("x").alias("a"), F.col("q").alias("b")), docs), "links"))
        found = components(links)
        at = group.select("doc_id", "grp").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("c"))
        still = wide.join(at, "doc_id").join(at.select(F.col("doc_id").alias("g"), F.col("c").alias("d")), "g").filter("c != d").select("doc_id", "g")
        still = materialize(still, "apart")
        if not still.isEmpty():
            # A link to a member needs some number of shared prefix tokens, so one at least is among the tokens that the
            # query shares with the group without that many less one: the rarest in the group are taken.
            common = opened.join(still.withColumnRenamed("doc_id", "q"), ["q", "g"]).join(inside.groupBy("token", "g").agg(F.count("*").alias("docs")), ["token", "g"])
            ends = Window.partitionBy("q", "g")
            common = common.withColumns({"shared": F.count("*").over(ends), "nth": F.row_number().over(ends.orderBy("docs", "token"))})
            exact = (F.col("q_min") == F.col("q_max")) & (F.col("n_min") == F.col("n_max"))
            spare = F.when(exact, F.greatest(F.lit(1), F.ceil(fewest("q_min", "n_min", "n_max") - 1e-6))).otherwise(1)
            rest = common.drop("g_min", "g_max").join(inside, ["token", "g"]).filter(fits & (F.col("nth") <= F.col("shared") - spare + 1))
            links = links.unionByName(materialize(verified(rest.select(F.col("x").alias("a"), F.col("q").alias("b")), docs), "links"))

    found = components(links).select(F.col("node").alias("rep"), "component")
    classes = classes.select("n", "hi", "lo", "rep").join(found, "rep", "left")
    out = rows.join(classes, ["n", "hi", "lo"], "left")  # sets of ids that are null or empty find no class
    same = F.col("doc_id").isNotNull()
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(same, own).alias("component_id"), F.when(same, F.coalesce("rep", "doc_id")).alias("class_id"))


def bounded(pairs: DataFrame, group: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates (doc_id, g) whose shingles reach the needed overlap with the union of the group's tokens."""
    pairs = materialize(pairs.select("doc_id", "g", "n_min"), "wide")
    if pairs.isEmpty():
        return pairs.select("doc_id", "g")
    groups = pairs.select(F.col("g").alias("grp")).distinct()
    inside = materialize(group.join(groups, "grp", "left_semi").select("doc_id", "grp"), "inside")
    union = exploded(restrict(docs, inside, "doc_id").select("doc_id", "text")).join(inside, "doc_id").select(F.col("grp").alias("g"), "token").distinct()
    queries = pairs.select("doc_id").distinct()
    asked = exploded(restrict(docs, queries, "doc_id").select("doc_id", "text")).join(pairs, "doc_id")
    hit = asked.join(union, ["g", "token"]).groupBy("doc_id", "g").agg(F.count("*").alias("k"), F.min("n_min").alias("n"))
    return materialize(hit.filter(F.col("k") * DEN >= F.col("n") * NUM).select("doc_id", "g"), "bounded")
