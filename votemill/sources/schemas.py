"""Schemas of the engine's relations, and resolution of column aliases.

Answers are texts: a JSON or CSV reader that infers types would lose integers of more than 18 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = "ans: string, logp: double, trunc: boolean, len: int"
SCHEMAS = {
    "problems": "id string, question string, answer string",
    "bad_ids": "id string",
    "sample_dump": f"id string, gold string, samples array<struct<{SAMPLE}>>",
    "token_dump": f"id string, gold string, samples array<struct<{SAMPLE}, tlp: array<double>>>",
    "rank_dump": f"id string, gold string, samples array<struct<{SAMPLE}, rank: array<string>>>",
    "sweep_dump": f"id string, lam double, tau double, partial boolean, gold string, samples array<struct<{SAMPLE}>>",
    "text_dump": f"id string, gold string, samples array<struct<{SAMPLE}, text: string>>",
    "sft": "id string, messages array<struct<role: string, content: string>>",
    "verifier": "id string, question string, solution string, label boolean",
    "pairs": "id string, question string, chosen string, rejected string",
    "teacher": "id string, solution string, answer string",
    "submission": "id string, answer string",
    "corrected_key": "id string, verdict string, gold string, ours string, truth string, note string",
    "strata": "stratum string, id string",
    "audit": "id string, verdict string, reason string, gold string, teacher_answer string",
}

#: The names under which problems come.
ID_NAMES = ["id", "ID", "Id", "problem_id", "index"]
QUESTION_NAMES = ["question", "Question", "problem", "Problem", "text"]


def resolve(columns: list[str], names: list[str]) -> str:
    """The first of the names that is a column, then the first that is one but for case; else an error that lists the columns."""
    for name in names:
        if name in columns:
            return name
    low = {c.lower(): c for c in reversed(columns)}
    for name in names:
        if name.lower() in low:
            return low[name.lower()]
    raise ValueError(f"none of {names} among the columns {columns}")


def normalize(df: DataFrame) -> DataFrame:
    """Problems with trimmed column names and id and question under their own names; the other columns stay."""
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    key, text = resolve(df.columns, ID_NAMES), resolve(df.columns, QUESTION_NAMES)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (key, text, "id", "question")]
    return df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("question"), *rest)


def ballots(dump: DataFrame, n: int | None = None) -> DataFrame:
    """A dump's samples as ballots, one row each with its position; only the first n of a problem if given."""
    samples = F.slice("samples", 1, n) if n is not None else F.col("samples")
    rest = [c for c in dump.columns if c != "samples"]
    return dump.select(*rest, F.posexplode(samples).alias("pos", "s")).select(*rest, "pos", "s.*")
