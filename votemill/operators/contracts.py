"""Contract checks of submissions and dumps: each gives rows (check, level, value), where any FAIL is a verdict."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votemill.operators.votes import fits_int64, int64_safe

#: The limits of a submission and of a dump.
ZERO_WARN, ZERO_FAIL, LOST_FAIL, TRUNC_WARN, ZERO_SHARE = 0.045, 0.08, 0.01, 0.05, 0.02
HEADER = ["id", "answer"]


def row(check: str, value: Column, fail: Column, warn: Column | None = None) -> tuple[str, Column, Column]:
    level = F.when(F.coalesce(fail, F.lit(True)), "FAIL")
    if warn is not None:
        level = level.when(F.coalesce(warn, F.lit(False)), "WARN")
    return check, level.otherwise("OK"), value


def report(one: DataFrame, rows: list[tuple[str, Column, Column]]) -> DataFrame:
    """A single row of figures turned into one row a check."""
    made = F.array(*[F.struct(F.lit(c).alias("check"), level.alias("level"), F.round(v.cast("double"), 6).alias("value")) for c, level, v in rows])
    return one.select(F.explode(made).alias("r")).select("r.*")


def coverage(have: DataFrame, want: DataFrame) -> DataFrame:
    """One row: rows, distinct, duplicates, missing and extra ids of `have` against `want`."""
    ids = have.groupBy("id").agg(F.count("*").alias("n"))
    wanted = want.select("id").distinct().withColumn("w", F.lit(1))
    both = ids.join(wanted, "id", "full_outer")
    n = F.coalesce("n", F.lit(0))
    return both.agg(
        F.sum(n).alias("rows"), F.count("n").alias("ids"), F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).alias("duplicates"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("w").isNull(), 1)).alias("extra"), F.count("w").alias("wanted"),
    )


def submission_report(submission: DataFrame, want: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Checks of a submission read as text: header, rows, ids, and answers (blank, no integer, too long, zeros)."""
    named = list(submission.columns) if columns is None else columns
    a = F.trim(F.col("answer"))
    blank = a.isNull() | (a == "")
    whole = a.rlike("^-?[0-9]+$")
    values = submission.agg(
        F.count(F.when(blank, 1)).alias("blank"), F.count(F.when(~blank & ~whole, 1)).alias("not_int"), F.count(F.when(whole & ~fits_int64(a), 1)).alias("oversize"),
        F.avg(F.when(whole, F.when(F.regexp_replace(a, "^-?0*", "") == "", 1).otherwise(0)).otherwise(0)).alias("zeros"),
    )
    one = coverage(submission, want).join(F.broadcast(values))  # one row each
    c = F.col
    return report(one, [
        row("header", F.lit(float(named == HEADER)), F.lit(named != HEADER)),
        row("rows", c("rows"), c("rows") != c("wanted")),
        row("duplicates", c("duplicates"), c("duplicates") > 0),
        row("missing", c("missing"), c("missing") > 0),
        row("extra", c("extra"), c("extra") > 0),
        row("blank", c("blank"), c("blank") > 0),
        row("not_int", c("not_int"), c("not_int") > 0),
        row("oversize", c("oversize"), c("oversize") > 0),
        row("zero_rate", c("zeros"), c("zeros") > ZERO_FAIL, c("zeros") > ZERO_WARN),
    ])


def dump_report(ballots: DataFrame, want: DataFrame, n: int | None = None) -> DataFrame:
    """Checks of a dump of ballots: coverage, repeated (id, pos), samples a problem, lost answers and truncation."""
    per = ballots.groupBy("id").agg(F.count("*").alias("k"))
    sizes = per.agg(F.min("k").alias("least"), F.max("k").alias("most"))
    rates = ballots.agg(F.avg(F.col("ans").isNull().cast("int")).alias("lost"), F.avg(F.col("trunc").cast("int")).alias("cut"))
    twice = ballots.groupBy("id", "pos").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("twice"))
    one = coverage(per, want).join(F.broadcast(sizes)).join(F.broadcast(rates)).join(F.broadcast(twice))  # one row each
    c = F.col
    short = c("least") < n if n else c("least") != c("most")
    return report(one, [
        row("missing", c("missing"), c("missing") > 0),
        row("extra", c("extra"), c("extra") > 0),
        row("duplicates", c("twice"), c("twice") > 0),
        row("samples", c("least"), short),
        row("lost_answers", c("lost"), c("lost") > LOST_FAIL),
        row("truncation", c("cut"), F.lit(False), c("cut") > TRUNC_WARN),
    ])


def dump_warnings(ballots: DataFrame, want: DataFrame, n: int) -> DataFrame:
    """Warnings before a submission is made: problems without samples, with fewer than n, without an answer that fits 64
    bits although they have answers, and answers of zero beyond what is usual (five, or 2 %)."""
    per = want.select("id").distinct().join(ballots, "id", "left").groupBy("id").agg(F.count("pos").alias("k"), F.count("ans").alias("valid"), F.count(F.when(fits_int64(F.col("ans")), 1)).alias("fit"))
    zero = int64_safe(ballots).agg(F.count("*").alias("answers"), F.count(F.when(F.col("answer") == "0", 1)).alias("zeros"))
    one = per.agg(
        F.count(F.when(F.col("k") == 0, 1)).alias("empty"), F.count(F.when((F.col("k") > 0) & (F.col("k") < n), 1)).alias("short"), F.count(F.when((F.col("valid") > 0) & (F.col("fit") == 0), 1)).alias("oversized")
    ).join(F.broadcast(zero))  # one row each
    c = F.col
    no = F.lit(False)
    return report(one, [
        row("empty", c("empty"), no, c("empty") > 0),
        row("short", c("short"), no, c("short") > 0),
        row("all_oversized", c("oversized"), no, c("oversized") > 0),
        row("zeros", c("zeros"), no, c("zeros") > F.greatest(F.lit(5.0), ZERO_SHARE * c("answers"))),
    ])


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.max(F.col("level") == "FAIL"), "FAIL").otherwise("PASS").alias("verdict"), F.count(F.when(F.col("level") == "FAIL", 1)).alias("failures"))


def prediction_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common problems, and those on which two submissions differ."""
    return a.join(b.withColumnRenamed("answer", "other"), "id").agg(F.count("*").alias("common"), F.count(F.when(F.col("answer") != F.col("other"), 1)).alias("differ"))


class ContractError(ValueError):
    """A precondition of a dump or a table does not hold."""


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, after making sure that no key repeats."""
    twice = df.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ContractError(f"{key} repeats: {[r[0] for r in twice]}")
    return df


def require_coverage(ballots: DataFrame, want: DataFrame, allow_partial: bool = False) -> DataFrame:
    """The ballots, after making sure that every wanted problem has some."""
    if not allow_partial:
        lost = want.select("id").distinct().join(ballots.select("id"), "id", "left_anti").limit(5).collect()
        if lost:
            raise ContractError(f"no ballots for {[r[0] for r in lost]}")
    return ballots


