"""Rules, text functions and block segmentation for use in spark.sql: SQL functions with SQL bodies, and one table function.

register(spark) declares them for the session. Ballots are arrays of structs (ans STRING, logp DOUBLE, trunc BOOLEAN, len INT) in order of
position, as dumps hold them; rules compose, for instance vote_weighted(trim_lowconf(samples, 0.25), 2.0).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from votemill.functions import text as T

SAMPLES = "ARRAY<STRUCT<ans: STRING, logp: DOUBLE, trunc: BOOLEAN, len: INT>>"
#: Of scored answers in order of first appearance, the first with the highest score.
BEST = "aggregate({0}, CAST(NULL AS STRUCT<n: DOUBLE, v: STRING>), (m, t) -> CASE WHEN m IS NULL OR t.n > m.n THEN t ELSE m END).v"


def literal(text: str) -> str:
    """A raw SQL string literal."""
    return f"r'{text}'" if "'" not in text else f'r"{text}"'


def elected(score: str) -> str:
    """The best of the valid samples' answers x; {own} in score are an answer's samples."""
    answers = "array_distinct(transform(filter(s, y -> y.ans IS NOT NULL), y -> y.ans))"
    value = score.format(own="filter(s, y -> y.ans = x)")
    return "coalesce(" + BEST.format(f"transform({answers}, x -> struct(CAST(round({value}, 9) AS DOUBLE) AS n, x AS v))") + ", '0')"


DOUBLE = "try_cast(bare_number(t) AS DOUBLE)"
FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Name, arguments, type and body of each function; later ones use earlier ones (outside lambdas, where Spark allows no call).
FUNCTIONS = [
    ("canonical_int", "t STRING", "STRING", "CASE WHEN regexp_replace(t, '^[+-]?0*', '') = '' THEN '0' ELSE concat(if(startswith(t, '-'), '-', ''), regexp_replace(t, '^[+-]?0*', '')) END"),
    ("bare_number", "t STRING", "STRING", f"regexp_replace(regexp_replace(t, {literal(T.JUNK)}, ''), {literal(T.DOTS)}, '')"),
    (
        "parse_int", "t STRING", "STRING",
        f"CASE WHEN bare_number(t) RLIKE '^[+-]?[0-9]+(?:_[0-9]+)*$' THEN canonical_int(replace(bare_number(t), '_', '')) "
        f"WHEN bare_number(t) RLIKE {literal(FLOAT)} AND abs({DOUBLE} - rint({DOUBLE})) < 1e-6 THEN CAST(try_cast(rint({DOUBLE}) AS BIGINT) AS STRING) END",
    ),
    ("topic_of", "t STRING", "STRING", "CASE " + " ".join(f"WHEN lower(coalesce(t, '')) RLIKE {literal(p)} THEN '{n}'" for n, p in T.TOPICS) + f" ELSE '{T.OTHER_TOPIC}' END"),
    ("vote_majority", f"s {SAMPLES}", "STRING", elected("size({own})")),
    ("vote_weighted", f"s {SAMPLES}, scale DOUBLE", "STRING", elected("aggregate({own}, 0D, (a, y) -> a + exp((y.logp - array_max(transform(filter(s, z -> z.ans IS NOT NULL), z -> z.logp))) * scale))")),
    ("drop_truncated", f"s {SAMPLES}", SAMPLES, "CASE WHEN exists(s, y -> NOT y.trunc) THEN filter(s, y -> NOT y.trunc) ELSE s END"),
    ("by_confidence", f"s {SAMPLES}", SAMPLES, "transform(array_sort(transform(filter(s, y -> y.ans IS NOT NULL), (y, i) -> struct(-y.logp AS k, i AS i, y AS y))), z -> z.y)"),
    ("trim_lowconf", f"s {SAMPLES}, frac DOUBLE", SAMPLES, "CASE WHEN size(by_confidence(s)) < 4 THEN s ELSE slice(by_confidence(s), 1, CAST(greatest(2, floor(size(by_confidence(s)) * (1 - frac))) AS INT)) END"),
    ("first_n", f"s {SAMPLES}, n INT", SAMPLES, "slice(s, 1, n)"),
]


class IdBlocks:
    """place, id and solution of each '## ID: x' block of a text; none for null."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        heads = list(re.finditer(r"(?m)^#{2,4}\s*ID\s*[:：]\s*(\S+)\s*$", text or ""))
        for place, (head, following) in enumerate(zip(heads, [*heads[1:], None]), 1):
            yield place, head[1], text[head.end() : following.start() if following else len(text)].strip()


def register(spark: SparkSession) -> list[str]:
    """Declare all functions for the session; their names."""
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("id_blocks", udtf(IdBlocks, returnType="place int, id string, solution string"))
    return [*(f[0] for f in FUNCTIONS), "id_blocks"]
