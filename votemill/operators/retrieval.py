"""TF-IDF retrieval by inverted lists of which only the blocks that matter are opened, and cosine figures of vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.functions.text import terms
from votemill.operators.runs import numbered
from votemill.sources.scratch import written


#: Rows of a side that is broadcast at most, postings of a list's first block, how much longer each following block is (so that the
#: longest list has some eighty blocks), and the room that rounded scores are given against a bound.
BROADCAST_ROWS, BLOCK, LONGER, ROOM = 200_000, 128, 1.25, 2e-6


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf with tf = 1 + ln f."""
    return rows.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count("*"))).alias("tf"))


def inverted(pool: DataFrame, asked: DataFrame, common: float = 0.25, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The queries' terms (item_id, term, q) and the postings of these terms (term, doc_id, w, block): cosine is the sum of q w.

    A list is in order of falling impact w and cut into blocks that grow. Lists are numbered by ranges, so a long one is not one task's. Terms in
    more than a share `common` of the documents count in the norms, but have no list.
    """
    n = pool.count()
    docs = written(weights(pool, "doc_id", "text"))
    df = written(docs.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1))
    queries = weights(asked, "item_id", "text").join(df, "term").withColumn("q", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("item_id")))  # the terms of a query
    queries = written(queries.withColumn("q", F.col("q") / length).filter(F.col("df") <= n * common).select("item_id", "term", "q"))
    weighed = docs.join(small(df.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    lists = weighed.join(small(queries.select("term").distinct()), "term", "left_semi").join(norms, "doc_id")
    lists = numbered(lists.select("term", "doc_id", (F.col("w") / F.col("dn")).alias("w"), (-F.col("w") / F.col("dn")).alias("fall_")), ["term"], ["fall_", "doc_id"], "place_")
    return queries, written(lists.select("term", "doc_id", "w", F.floor(F.log(1 + (F.col("place_") - 1) * (LONGER - 1) / block) / math.log(LONGER)).alias("block")))


def partial(opened: DataFrame, lists: DataFrame) -> DataFrame:
    """item_id, doc_id, s: sums over the blocks before `upto` of opened (item_id, term, q, upto)."""
    return opened.join(lists, "term").filter("block < upto").groupBy("item_id", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("s"))


def kth(scores: DataFrame, k: int) -> DataFrame:
    """item_id and the k-th highest s (0 if there are fewer): a bound from below of the k-th score."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("s")))
    return scores.withColumn("r", rank).filter(F.col("r") <= k).groupBy("item_id").agg(F.when(F.count("*") == k, F.min("s")).otherwise(0.0).alias("least"))


def plan_blocks(queries: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """item_id, term, q, postings, upto (blocks of the term to be opened), opened (their postings) and rest: what a document can get at
    most from the query's unopened blocks.

    The first blocks of all lists give a bound of the k-th score. Then a query's blocks are taken in order of the most that
    they can add, until all that is left unopened adds up to less than that bound: a document in no opened block cannot be
    among the k best.
    """
    heads = lists.groupBy("term", "block").agg(F.max("w").alias("top"), F.count("*").alias("n"))
    blocks = written(queries.join(heads, "term").withColumn("c", F.col("q") * F.col("top")))
    bound = kth(partial(small(queries.withColumn("upto", F.lit(1))), lists.filter("block = 0")), k)
    falling = Window.partitionBy("item_id").orderBy(F.desc("c"), "term", "block")
    left = F.sum(F.when(F.col("block") == 0, F.col("c")).otherwise(0.0)).over(Window.partitionBy("item_id"))
    drop = F.col("c") - F.coalesce(F.lead("c").over(Window.partitionBy("item_id", "term").orderBy("block")), F.lit(0.0))
    rows = blocks.withColumn("left_", left).withColumn("drop_", drop).join(bound, "item_id")
    before = F.col("left_") - F.coalesce(F.sum("drop_").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("open", (before >= F.col("least") - ROOM) | (F.col("block") == 0))
    taken = F.col("open").cast("long")
    out = rows.groupBy("item_id", "term", "q").agg(F.sum(taken).alias("upto"), F.sum("n").alias("postings"), F.sum(taken * F.col("n")).alias("opened"), F.coalesce(F.max(F.when(~F.col("open"), F.col("c"))), F.lit(0.0)).alias("rest_"))
    return out.withColumn("rest", F.sum("rest_").over(Window.partitionBy("item_id"))).drop("rest_")


def topk(pool: DataFrame, asked: DataFrame, k: int = 3, common: float = 0.25, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The k documents nearest to each query by cosine (item_id, rank, doc_id, score), and item_id, postings and opened of each query."""
    queries, lists = inverted(pool, asked, common, block)
    opened = written(plan_blocks(queries, lists, k))
    found = written(partial(small(opened.select("item_id", "term", "q", "upto")), lists))
    able = found.join(kth(found, k), "item_id").join(opened.select("item_id", "rest").distinct(), "item_id").filter(F.col("s") + F.col("rest") >= F.col("least") - ROOM)
    able = written(able.select("item_id", "doc_id"))
    whole = lists.join(small(able), "doc_id").join(queries, ["item_id", "term"]).groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("q") * F.col("w")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("doc_id")))
    best = whole.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
    return best, opened.groupBy("item_id").agg(F.sum("postings").alias("postings"), F.sum("opened").alias("opened"))


def tfidf_topk(pool: DataFrame, asked: DataFrame, k: int = 3, common: float = 0.25) -> DataFrame:
    """The k documents nearest to each query by cosine; terms in more than a share `common` of documents are not followed."""
    return topk(pool, asked, k, common)[0]


def unit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("norm_", norm).filter("norm_ > 0").withColumn("v", F.transform(v, lambda x: x / F.col("norm_"))).drop("norm_")


def mean_cosines(vectors: DataFrame, label: str) -> DataFrame:
    """Mean cosine of all pairs within each label, from the norm of the sum: no pair is formed.

    The sum over pairs i < j of u_i . u_j is (|sum u|^2 - n) / 2 for unit vectors.
    """
    parts = unit(vectors).select(label, F.posexplode("v").alias("d", "x")).groupBy(label, "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    out = parts.groupBy(label).agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s"))
    return out.select(label, "n", F.round((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("cosine"))


def cross_cosines(vectors: DataFrame, label: str) -> DataFrame:
    """Mean cosine between the members of every two labels: the product of the labels' mean unit vectors.

    Pairs are of labels, of which there are few; no pair of vectors is formed.
    """
    parts = unit(vectors).select(label, F.posexplode("v").alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("x"))
    a, b = parts.toDF("a", "d", "x"), parts.toDF("b", "d", "y")
    return a.join(b, "d").filter("a < b").groupBy("a", "b").agg((F.round(F.sum(F.col("x") * F.col("y")), 6) + 0.0).alias("cosine"))
