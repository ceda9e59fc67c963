"""Importance resampling towards a target text collection, in Spark SQL functions only.

Words are runs of a-z, 0-9 (after A-Z went to lower case) and characters beyond ASCII; features are all runs of one to GRAMS words.
A feature's bucket is the crc32 of its bytes modulo BUCKETS; buckets are counted over all documents and over all target texts, and
a bucket's gain is the logarithm of the ratio of its smoothed shares, in thousandths. A document's weight is the sum of the gains of
its features. Gumbel noise from a hash of the id is added, and the highest scores are drawn: a sample without
replacement by weight.

Scale: a text becomes an array of buckets once, which is written (two bytes a feature) and read twice: exploded and
counted with partial sums, then exploded and joined to the gain table, whose BUCKETS rows are broadcast. A document's gains meet on one
key a row, so neither a repeated id nor a frequent feature is one task's. Ranks come from a sort by ranges of
(score, id, row), in which equal rows differ by their row number; each range numbers its own rows, and the counts of the ranges before
it are added.

Edge cases: a null text has no words; a document without features weighs 0; a null id has no hash, so its score and rank are
null and it is not among those drawn from; repeated rows count each, are drawn each and returned each; with fewer than 100/PERCENT
eligible documents none is drawn; without target texts all gains speak against frequent buckets; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.llm.common import materialize

BUCKETS, GRAMS, SEED, MIN_WORDS, PERCENT = 10_000, 3, "42", 20, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a range of the sort holds, about.
RANGE_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def grams(ws: Column, n: int) -> Column:
    """Arrays of the runs of 1 to n words that start at each word, null where the text ends before. ws must be a stored column."""

    def at(w: Column, i: Column) -> Column:
        runs = [w]
        for k in range(1, n):
            runs.append(F.concat(runs[-1], F.lit(" "), F.get(ws, i + k)))
        return F.array(*[(F.crc32(r) % BUCKETS).cast("int") for r in runs])

    return F.array_compact(F.flatten(F.transform(ws, at)))


def featured(docs: DataFrame, text: str = "text", n: int = GRAMS) -> DataFrame:
    """docs without its text, with n_words and buckets (array of int, one for each feature)."""
    split = docs.withColumn("words_", words(F.col(text)))
    return split.select(*[c for c in docs.columns if c != text], F.size("words_").cast("long").alias("n_words"), grams(F.col("words_"), n).alias("buckets"))


def counts(features: DataFrame, name: str) -> DataFrame:
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket, from the counts s in source and t in target."""
    spark = source.sparkSession
    table = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts(source, "s")), "bucket", "left").join(F.broadcast(counts(target, "t")), "bucket", "left").fillna(0, ["s", "t"])  # `buckets` rows at most
    total = table.agg(F.sum("s").cast("double").alias("ss"), F.sum("t").cast("double").alias("tt"))  # one row
    ratio = (F.col("t").cast("double") + 1) * (F.col("ss") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("tt") + buckets))
    return materialize(table.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), "gains")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], within: int = RANGE_ROWS) -> DataFrame:
    """rows with `place` (from 1) in a total order: ranges of it number their own rows, and the counts of the ranges before are added."""
    n = rows.count()
    ranges = max(n // within, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > 10_000 else 1, 1)
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n_"))  # a row a range
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn("own_", own).join(F.broadcast(sizes.select("range_", before.alias("before_"))), "range_").withColumn("place", F.col("own_") + F.col("before_")).drop("own_", "before_", "range_")


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = GRAMS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, and row_ that tells equal rows apart."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = materialize(featured(docs, "text", n).withColumn("row_", F.monotonically_increasing_id()), "features")
    table = gains(source, featured(target.select(F.col(target_col).cast("string").alias("text")), "text", n))
    each = source.select("row_", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    sums = each.join(F.broadcast(table), "bucket", "left").groupBy("row_", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return sums.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, **settings) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document."""
    rows = materialize(weighed(docs, target, id_col, text_col, **settings).withColumn("fit_", F.col("score").isNotNull() & (F.col("n_words") >= min_words)), "scores")
    drawn = percent * rows.filter("fit_").count() // 100
    placed = ranked(rows, [F.desc("fit_"), F.desc("score"), F.asc("doc_id"), F.asc("row_")])
    rank = F.when(F.col("fit_") & (F.col("place") <= drawn), F.col("place").cast("long"))
    return placed.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def sql(buckets: int = BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> str:
    """The same over `documents` and `benchmark`; crc32 by its table of 256 values, made by the rule of its polynomial."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    table = "range"
    for _ in range(8):
        table = f"(SELECT i, {step.format('v')} AS v FROM {table})" if table != "range" else f"(SELECT i, {step.format('i')} AS v FROM (SELECT unnest(range(256)) AS i))"
    bytes_ = "list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    features = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
 fd AS MATERIALIZED (SELECT r, {features} FROM d), fb AS MATERIALIZED (SELECT {features} FROM (SELECT {split} AS w FROM benchmark)),
 tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM {table}),
 code AS MATERIALIZED (SELECT f, {crc} % {buckets} AS b FROM (SELECT f FROM fd UNION SELECT f FROM fb), tab),
 s AS (SELECT b, count(*) AS s FROM fd JOIN code USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM fb JOIN code USING (f) GROUP BY b),
 g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM fd)::DOUBLE + {buckets})
   / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM fb)::DOUBLE + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
 n AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM fd JOIN code USING (f) JOIN g USING (b) GROUP BY r),
 e AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{seed}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN n USING (r)),
 p AS (SELECT *, score IS NOT NULL AND n_words >= {min_words} AS fit FROM e),
 k AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id, r) AS place, {percent} * (count(*) FILTER (fit) OVER ()) // 100 AS drawn FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM k"""
