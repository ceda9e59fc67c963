"""Quality rules for documents and hosts, with DataFrame functions only.

Each document gets counts from its own text and fails the base rules if it is short or repeats itself, the soft rule
if symbols are more than MAX_SYMBOL_PERCENT of its word characters. Documents that fail any rule are summed by host (the
`source` column), each host's rate is shrunk with a beta prior fitted to all hosts by the method of moments, and the
host's posterior gives its verdict, which is joined back to its documents:
  blocked  its shrunk rate is above MAX_HOST_RATE: most of what it has is refuse, so none of its documents is kept;
  trusted  at odds of two to one (TRUST standard deviations of the posterior) its rate is below that of all documents:
           documents that fail only the soft rule are kept, as symbols have a reason there;
  strict   any other host: its documents are kept if they pass all rules.
The prior pulls a host with few documents to the usual rate, so that it is neither blocked nor trusted for a few of them.

Edge cases: a null text has no words and fails; a null source is a host of its own; a null doc_id is carried
through; repeated rows count each; with one host, or hosts of equal rates, the prior weighs PRIOR_WEIGHT
documents; an empty table gives no row; extra columns are ignored. Windows of three words are compared by a
64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votemill.llm.common import materialize, small

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT = 50, 50, 10
MAX_HOST_RATE, PRIOR_WEIGHT = 0.5, 10.0
#: The point of the normal distribution that two thirds of it lie below.
TRUST = 0.4307


def let(value: Column, body) -> Column:
    """body(value), with value computed once though body may use it within lambdas."""
    return F.transform(F.array(value), body)[0]


def flat_spaces(text: Column) -> Column:
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(flat_spaces(text), " "), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more."""

    def covered(h: Column) -> Column:
        # Windows sorted by content: equal ones are neighbours. Then the union of their three-word spans.
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, d: s[k]["h"] == s[k + d]["h"]
        at = let(
            ordered,
            lambda s: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when((k > 0) & same(s, F.greatest(k, F.lit(1)), -1), True).otherwise(F.when(k < F.size(s) - 1, same(s, F.least(k, F.size(s) - 2), 1)).otherwise(False))),
                lambda k: s[k]["i"],
            ),
        )
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(at), start, step, lambda a: a["n"])

    def of(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(h, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(of(w)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"))
    flat = flat_spaces(F.col("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.replace(flat_spaces(x), F.lit(" "), F.lit(""))) > 0)
    counted = let(
        F.array_remove(F.split(flat, " "), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    df = df.select(
        "doc_id",
        "host",
        counted.alias("c"),
        F.length(F.replace(flat, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    words, repeats = F.col("c.n_words"), F.col("c.n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    soft = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")
    return df.select("doc_id", "host", words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), failed.alias("base_failed"), soft.alias("soft_failed"))


def host_rates(scored: DataFrame) -> DataFrame:
    """host, host_rate (the shrunk share of its documents that fail a rule) and host_verdict."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = scored.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed).alias("failed"))
    own = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(own).alias("m"), F.var_pop(own).alias("v"), (F.sum("failed") / F.sum("n")).alias("corpus"))
    weight = F.when(F.col("v") > 1e-12, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(0.0))).otherwise(F.lit(PRIOR_WEIGHT))
    hosts = hosts.join(F.broadcast(prior.select("m", "corpus", weight.alias("w"))))  # one row
    hosts = hosts.withColumn("host_rate", (F.col("failed") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w")))
    spread = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.col("w") + 1))
    verdict = F.when(F.col("host_rate") > MAX_HOST_RATE, "blocked").when(F.col("host_rate") + TRUST * spread <= F.col("corpus"), "trusted").otherwise("strict")
    return hosts.select("host", "host_rate", verdict.alias("host_verdict"))


def judged(scored: DataFrame) -> DataFrame:
    """scored with host_rate, host_verdict and kept."""
    hosts = materialize(host_rates(scored).withColumnRenamed("host", "h"), "hosts")
    joined = scored.join(small(hosts), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    own = (F.col("host_verdict") == "trusted") | ((F.col("host_verdict") == "strict") & ~F.col("soft_failed"))
    return joined.withColumn("kept", ~F.col("base_failed") & own)


def quality(docs: DataFrame) -> DataFrame:
    scored = judged(materialize(features(docs), "quality"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"), "host_verdict")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g),
p AS (SELECT r, least(3, i - lag(i, 1, -3) OVER (PARTITION BY r ORDER BY i)) AS n FROM c WHERE k > 1),
s AS (SELECT r, sum(n)::BIGINT AS n FROM p GROUP BY r),
f AS (SELECT w.doc_id, w.source AS host, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(s.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars AS soft_failed FROM f),
h AS (SELECT host, count(*) AS n, sum((base_failed OR soft_failed)::INT) AS failed FROM b GROUP BY host),
q AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v, sum(failed) / sum(n) AS corpus FROM h),
z AS (SELECT m, corpus, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 0.0) ELSE {PRIOR_WEIGHT} END AS w FROM q),
x AS (SELECT host, (failed + m * w) / (n + w) AS host_rate, n + w + 1 AS n, corpus FROM h, z),
k AS (SELECT host, host_rate, CASE WHEN host_rate > {MAX_HOST_RATE} THEN 'blocked' WHEN host_rate + {TRUST} * sqrt(host_rate * (1 - host_rate) / n) <= corpus THEN 'trusted' ELSE 'strict' END AS host_verdict FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (host_verdict = 'trusted' OR host_verdict = 'strict' AND NOT soft_failed) AS kept, round(host_rate, 9) AS host_rate, host_verdict
FROM b JOIN k ON b.host IS NOT DISTINCT FROM k.host
"""
