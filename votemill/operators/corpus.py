"""Building training sets: reject cascades, exact deduplication, decontamination, selections, pairs and samples.

Samples, shuffles and folds are orders of md5(seed | id), which any engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.functions.text import strip
from votemill.operators.ranges import hash_ranks, running


def draw(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def text_key(text: Column) -> Column:
    """A digest to group or join equal texts by, so that the texts themselves need not move."""
    return F.sha2(strip(F.coalesce(text, F.lit(""))), 256)


def cascade(docs: DataFrame, held_out: DataFrame, low: int = 50, high: int = 3000, needs: str = ".") -> DataFrame:
    """doc_id and the first reason to reject a document, null if it is kept: length, form, contamination, then repetition.

    Reasons are one CASE in order, as the first that holds is the one reported. Only digests are shuffled. A text
    counts as repeated when an earlier document with no other fault has it.
    """
    size = F.length(strip(F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", size.alias("n"), F.contains(F.coalesce("text", F.lit("")), F.lit(needs)).alias("ok"), text_key(F.col("text")).alias("key"))
    known = held_out.select(text_key(F.col("text")).alias("key")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "key", "left")
    reason = F.when(F.col("n") < low, "too_short").when(F.col("n") > high, "too_long").when(~F.col("ok"), "no_sentence").when(F.col("known"), "contaminated")
    rows = rows.withColumn("reason", reason)
    first = rows.filter("reason IS NULL").groupBy("key").agg(F.min("doc_id").alias("first"))  # partial sums: a frequent text is no hot group
    rows = rows.join(first, "key", "left")
    return rows.select("doc_id", "source", F.coalesce("reason", F.when(F.col("doc_id") > F.col("first"), "duplicate")).alias("drop_reason"))


def exact_first(docs: DataFrame) -> DataFrame:
    """doc_id of the first document of each text: the least id by digest, with partial aggregates."""
    return docs.groupBy(text_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def decontaminated(docs: DataFrame, held_out: DataFrame) -> DataFrame:
    known = held_out.select(text_key(F.col("text")).alias("key")).distinct()
    return docs.withColumn("key", text_key(F.col("text"))).join(known, "key", "left_anti").drop("key")


def sample(rows: DataFrame, n: int, seed: str = "123", key: str = "id") -> DataFrame:
    return rows.orderBy(draw(seed, key), key).limit(n)


def holdout(rows: DataFrame, fraction: float, seed: str = "42", key: str = "id", keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with `held_out`: the first floor(n * fraction) of each group in hash order."""
    ranked = hash_ranks(rows, draw(seed, key), keys, key)
    return ranked.select(*rows.columns, (F.col("r_") <= F.floor(F.col("n_") * fraction)).alias("held_out"))


def folds(rows: DataFrame, k: int, seed: str = "7", key: str = "id") -> DataFrame:
    """Fold by hash, which needs no global order."""
    return rows.withColumn("fold", (F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") % k).cast("int"))


def capped(rows: DataFrame, cap: int, by: tuple[str, ...], seed: str = "42", key: str = "id") -> DataFrame:
    """At most cap rows of each class, in hash order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key), key))
    return rows.withColumn("r_", rank).filter(F.col("r_") <= cap).drop("r_")


def balanced(rows: DataFrame, label: str, cap: int, seed: str = "42", key: str = "id") -> DataFrame:
    """As many positive as negative rows, cap of each at most."""
    sizes = rows.agg(F.least(F.sum(F.col(label).cast("long")), F.sum((1 - F.col(label)).cast("long")), F.lit(cap)).alias("k_"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, key), key))
    first = rows.withColumn("r_", rank).filter(F.col("r_") <= cap)  # a literal bound, so that tasks keep cap rows a label before the exchange
    return first.join(F.broadcast(sizes)).filter(F.col("r_") <= F.col("k_")).drop("r_", "k_")  # sizes is one row


def rejection_sampled(samples: DataFrame, gold: DataFrame, most: int = 3, head: int = 200) -> DataFrame:
    """The first `most` right solutions of each problem that differ in their first `head` characters."""
    right = samples.join(gold, "id").filter(F.col("ans") == F.col("gold"))
    first = right.groupBy("id", F.left("text", F.lit(head)).alias("head")).agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return first.withColumn("k", rank).filter(F.col("k") <= most).select("id", "pos", "k")


def marginal(samples: DataFrame, gold: DataFrame, low: int = 1, high: int = 2, most: int = 2) -> DataFrame:
    """The shortest right solutions of problems with low..high right ones."""
    right = samples.join(gold, "id").filter(F.col("ans") == F.col("gold"))
    w = Window.partitionBy("id")
    rows = right.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("len", "pos"))})
    return rows.filter(F.col("n").between(low, high) & (F.col("r") <= most)).select("id", "pos", "len", "n", "r")


def preference_pairs(samples: DataFrame, gold: DataFrame, most: int = 2, seed: str = "42", least: int = 50) -> DataFrame:
    """The k-th shortest right solution of a problem against the k-th wrong one in hash order; solutions of `least` length."""
    rows = samples.filter(F.col("ans").isNotNull() & (F.col("len") >= least)).join(gold, "id").withColumn("ok", F.col("ans") == F.col("gold"))
    w = Window.partitionBy("id", "ok")
    k = F.row_number().over(w.orderBy(F.when(F.col("ok"), F.lpad(F.col("len").cast("string"), 9, "0")).otherwise(draw(seed, "id", "pos")), "pos"))
    rows = rows.withColumn("k", k).filter(F.col("k") <= most)
    pick = lambda ok: F.max(F.when(F.col("ok") == ok, F.col("pos")))
    return rows.groupBy("id", "k").agg(pick(True).alias("chosen"), pick(False).alias("rejected")).filter("chosen IS NOT NULL AND rejected IS NOT NULL")


def reward_pairs(samples: DataFrame, gold: DataFrame, most: int = 4, seed: str = "42", held: float = 0.05, least: int = 50) -> DataFrame:
    """`most` right x wrong pairs of each problem, drawn evenly from all of them without repeats, and whether the pair is held out.

    Samples of fewer than `least` characters do not count; one without an answer is wrong. Of n pairs, numbers 0..n - 1 are drawn by Floyd's
    method (the i-th draw is a hash below n - most + i + 1, or that bound itself if it was drawn before) and split into the places of the
    right and the wrong sample, so that no product is formed. A share `held` of the pairs is held out, by hash ranks.
    """
    rows = samples.filter(F.col("len") >= least).join(gold.filter("gold IS NOT NULL"), "id").select("id", "pos", F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).alias("ok"))
    rows = rows.withColumn("place", (F.row_number().over(Window.partitionBy("id", "ok").orderBy("pos")) - 1).cast("long"))
    counts = rows.groupBy("id").agg(F.count(F.when(F.col("ok"), 1)).alias("p"), F.count(F.when(~F.col("ok"), 1)).alias("q")).filter("p > 0 AND q > 0")
    n = F.col("p") * F.col("q")
    hashed = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), i.cast("string"))), 1, 12), 16, 10).cast("long")

    def drawn(found: Column, i: Column) -> Column:
        top = n - F.least(F.lit(most), n) + i
        number = hashed(i) % (top + 1)
        return F.concat(found, F.array(F.when(F.array_contains(found, number), top).otherwise(number)))

    numbers = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(most), n).cast("int") - 1), F.array().cast("array<bigint>"), drawn)
    pairs = counts.select("id", "q", F.explode(numbers).alias("number")).withColumns({"good": F.call_function("div", F.col("number"), F.col("q")), "bad": F.col("number") % F.col("q")})
    side = lambda ok, name, to: rows.filter(F.col("ok") == ok).select("id", F.col("place").alias(name), F.col("pos").alias(to))
    pairs = pairs.join(side(True, "good", "chosen"), ["id", "good"]).join(side(False, "bad", "rejected"), ["id", "bad"])
    return holdout(pairs.select("id", "chosen", "rejected", F.concat_ws("-", "id", "chosen", "rejected").alias("pair")), held, f"{seed}h", "pair").drop("pair")


def length_bands(pairs: DataFrame, problem: str = "problem", solution: str = "solution") -> DataFrame:
    """pairs with v1 (solution of 50 to 2500 characters) and v2 (50 to 3000, and a problem of 1500 at most)."""
    n, p = F.length(strip(F.coalesce(solution, F.lit("")))), F.length(strip(F.coalesce(problem, F.lit(""))))
    return pairs.withColumns({"v1": n.between(50, 2500), "v2": n.between(50, 3000) & (p <= 1500)})


def int64_only(rows: DataFrame, column: str = "ans") -> DataFrame:
    """Rows whose integer text fits 64 bits, -2**63 included."""
    return rows.filter(F.col(column).try_cast("bigint").isNotNull())


def tagged(samples: DataFrame, gold: DataFrame, cap: int = 200) -> DataFrame:
    """Samples tagged hard or easy (by whether the problem's majority fails) and pos or neg, `cap` of each tag."""
    from votemill.operators.votes import majority

    rows = samples.filter("ans IS NOT NULL").join(gold, "id").join(majority(samples), "id")
    hard = F.when(F.col("answer") == F.col("gold"), "easy").otherwise("hard")
    tag = F.concat_ws("_", hard, F.when(F.col("ans") == F.col("gold"), "pos").otherwise("neg"))
    rows = rows.withColumns({"tag": tag, "key": F.concat_ws("-", "id", "pos")})
    return capped(rows, cap, ("tag",), key="key").select("id", "pos", "tag")


def wrong_records(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """Problems whose majority fails: gold, the answer, and all answers in order."""
    from votemill.operators.votes import majority

    answers = samples.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ans"))), lambda x: x["ans"]), ",", "-").alias("answers"))
    return majority(samples).join(gold, "id").filter("answer != gold").join(answers, "id").select("id", "gold", "answer", "answers")


def consistent(samples: DataFrame, verdict: Column, label: Column) -> DataFrame:
    """The first sample of each problem whose verdict agrees with its label."""
    return samples.filter(verdict == label).groupBy("id").agg(F.min("pos").alias("pos"))


def extended_set(old: DataFrame, pool: DataFrame, bad: DataFrame, used: DataFrame, n: int, seed: str = "99") -> DataFrame:
    """The old ids and n further ones of the pool, without bad ones; whether each was old or used in training."""
    fresh = sample(pool.join(bad, "id", "left_anti").join(old, "id", "left_anti").select("id"), n, seed)
    both = old.select("id").withColumn("in_old", F.lit(True)).unionByName(fresh.withColumn("in_old", F.lit(False)))
    return both.join(used.select("id").distinct().withColumn("u", F.lit(True)), "id", "left").select("id", "in_old", F.coalesce("u", F.lit(False)).alias("used"))


def chat(system: str, user: Column, assistant: Column) -> Column:
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(say("system", F.lit(system)), say("user", user), say("assistant", assistant))


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation with its messages in order of turn."""
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def first_exchange(conv: DataFrame, most: int = 4000) -> DataFrame:
    """First user and first assistant message; without either, or with an answer that is too long, the row goes."""
    first = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    return conv.select("conv_id", first("user").alias("question"), first("assistant").alias("solution")).filter(F.col("question").isNotNull() & F.col("solution").isNotNull() & (F.length("solution") <= most))


def fewshot(examples: DataFrame, queries: DataFrame, k: int = 2) -> DataFrame:
    """Messages of the k examples with the smallest ids, then the query's."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    shots = examples.orderBy("conv_id").limit(k).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "question", "solution"))), lambda e: F.array(F.struct(F.lit("user").alias("role"), e["question"].alias("content")), F.struct(F.lit("assistant").alias("role"), e["solution"].alias("content"))))).alias("shots"))
    return queries.join(F.broadcast(shots)).select("conv_id", F.concat("shots", F.array(say("user", "question"))).alias("messages"))  # one row of k examples


def chunked(rows: DataFrame, size: int, key: str = "id") -> DataFrame:
    """chunk and place of each row in runs of `size` by key."""
    n = F.col("k_") - 1
    return running(rows, [F.col(key)], {}, "k_").withColumns({"chunk": F.floor(n / size).cast("int"), "place": (n % size).cast("int")}).drop("k_")


HEADER = r"(?m)^#{2,4}\s*ID\s*[:：]\s*(\S+)\s*$"


def teacher_blocks(files: DataFrame) -> DataFrame:
    """id and solution of each '## ID: x' block of files (file, value), or of blocks that were read by records (with their place)."""
    parts = F.split("value", r"(?m)(?=^#{2,4}\s*ID\s*[:：])")
    blocks = files.select("file", "place", F.col("value").alias("block")) if "place" in files.columns else files.select("file", F.posexplode(parts).alias("place", "block"))
    blocks = blocks.withColumn("id", F.regexp_extract("block", HEADER, 1)).filter("id != ''")
    return blocks.select("file", "place", "id", strip(F.regexp_replace("block", HEADER, "")).alias("solution"))


def teacher_status(blocks: DataFrame, gold: DataFrame, answer: Column) -> DataFrame:
    """What becomes of each block: unknown id, repeated id, no answer, wrong answer, or kept."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("file", "place"))
    rows = blocks.withColumns({"answer": answer, "nth": nth}).join(gold, "id", "left")
    status = F.when(F.col("gold").isNull(), "unknown").when(F.col("nth") > 1, "duplicate").when(F.col("answer").isNull(), "no_answer").when(F.col("answer") != F.col("gold"), "wrong").otherwise("kept")
    return rows.select("file", "place", "id", "answer", status.alias("status"))


def replay(base: DataFrame, pool: DataFrame, k: int, seed: str = "42", key: str = "id") -> DataFrame:
    """base and k further rows of the pool."""
    return base.unionByName(sample(pool.join(base.select(key), key, "left_anti"), k, seed, key))
