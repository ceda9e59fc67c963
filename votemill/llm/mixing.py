"""Mixing to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed to cells of (source, language, topic). The tokens to be kept, a wanted fraction of all, are
raked over the cells until their source, language and topic marginals meet the targets, and no cell is given more than
it has: a raking step scales the cells of a value by one factor, but a cell that would go over its tokens is filled
and the others take the rest. Documents are then kept with the probability given / present tokens of their cell, which
is never above 1, so that the sample has the raked marginals; the draw is a hash of the document's id, so that it can be
repeated.

A target is either weights by value (values not named get none), or a power to which each observed marginal share is
raised (1 keeps a marginal, 0 makes it uniform). A value cannot be given more tokens than it has, so a target beyond that
is cut to all of them and the other values share the rest in their proportions; `marginals` shows targets and results.
The topic is the form of the text (licence notice, table, noise with many symbols, or prose), or a column of the caller's.

Cells are few numbers a combination of values, however many documents there are; they are raked in one task, since every
step needs all of them.

Edge cases: null source, language or text count as '' ; a text without words has weight 0 tokens but falls in
a cell like any other, and a cell without tokens is kept; a null doc_id draws as ''; repeated rows draw alike; an empty
table gives an empty one; extra columns pass through the sample untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votemill.llm.common import materialize
from votemill.llm.quality import words_of

POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS, FRACTION, SEED = 12, 0.6, "mix"
TINY, HUGE = 1e-300, 1e300
DIMS = ("m_source", "m_lang", "m_topic")


def topic_of(text: Column) -> Column:
    return (
        F.when(text.rlike("(?i)licen[cs]e|all rights reserved"), "licence")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(10 * F.regexp_count(text, F.lit("[#*$%&<>]")) > F.length(text), "noise")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The rows of docs packed in one column, with their cell, their number of words and their draw."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    cell = {"m_source": F.coalesce("source", F.lit("")), "m_lang": F.coalesce("lang", F.lit("")), "m_topic": topic}
    return docs.select(F.struct("*").alias("row"), *(v.alias(k) for k, v in cell.items()), F.size(words_of(text)).cast("long").alias("m_tokens"), draw(F.col("doc_id")).alias("m_draw"))


def draw(id_col: Column) -> Column:
    """A number in [0, 1) from the id."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"|{SEED}"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def filled(df: DataFrame, group: list[str], given: str, room: str, total: Column, name: str) -> DataFrame:
    """df with a column: given times one factor a group, at most room, so that the sum over the group is total.

    Rows that reach their room first are filled; the factor is that of the first row at which it does not go over.
    """
    ratio = F.col(room) / F.greatest(F.col(given), F.lit(TINY))
    order = Window.partitionBy(*group).orderBy(ratio, *DIMS)
    before = F.coalesce(F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(given).over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.select("*", ((total - before) / F.greatest(rest, F.lit(TINY))).alias("f_factor"))
    factor = F.max(F.when(F.col("f_factor") * F.col(given) <= F.col(room), F.col("f_factor"))).over(Window.partitionBy(*group))
    value = F.least(F.col(room), F.greatest(F.coalesce(factor, F.lit(HUGE)), F.lit(0.0)) * F.col(given))
    return df.select(*(c for c in df.columns if c not in (name, "f_factor")), value.alias(name))


def wanted(dim: str, targets) -> Column:
    """The weight that a value of dim is to have, before it is cut to what it has."""
    target = targets[dim[2:]]
    if isinstance(target, dict):
        return F.coalesce(F.create_map(*(x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))))[F.col(dim)], F.lit(0.0))
    return F.pow("share", F.lit(float(target)))


def rake(cells: DataFrame, targets=POWERS, rounds: int = ROUNDS, fraction: float = FRACTION) -> DataFrame:
    """cells (three dimensions and their tokens) with their share s, the raked share x, the targets t_dim and p.

    Shares are of the tokens to be kept, so a cell has room for s / fraction.
    """
    cells = cells.coalesce(1).filter("tokens > 0").withColumn("s", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    cells = cells.withColumn("room", F.col("s") / F.lit(fraction))
    for dim in DIMS:
        # The target of a value lies on the first of its cells; the others have neither target nor room there.
        w = Window.partitionBy(dim)
        first = F.row_number().over(w.orderBy(*DIMS)) == 1
        cells = cells.withColumns({"share": F.sum("s").over(w), "first": first})
        cells = cells.withColumns({"goal": F.when(F.col("first"), wanted(dim, targets)).otherwise(0.0), "most": F.when(F.col("first"), F.col("share") / F.lit(fraction)).otherwise(0.0)})
        cells = filled(cells, [], "goal", "most", F.lit(1.0), f"t_{dim}")
        cells = cells.withColumn(f"t_{dim}", F.max(f"t_{dim}").over(w)).drop("share", "first", "goal", "most")
    cells = cells.withColumn("x", F.col("s"))
    for _ in range(rounds):
        for dim in DIMS:
            cells = filled(cells, [dim], "x", "room", F.col(f"t_{dim}"), "x")
    p = F.round(F.least(F.lit(1.0), F.col("x") / F.col("room")), 9)
    return cells.select(*DIMS, "tokens", *(f"t_{d}" for d in DIMS), F.round(F.col("x") / F.col("s"), 9).alias("weight"), p.alias("p"))


def mix(docs: DataFrame, targets=POWERS, fraction: float = FRACTION, topic: Column | None = None) -> DataFrame:
    """row (the row of docs), m_source, m_lang, m_topic, m_tokens, weight, p, kept, and the targets of the cell."""
    wide = with_cells(docs, topic)
    cells = materialize(wide.groupBy(*DIMS).agg(F.sum("m_tokens").alias("tokens")), "cells")
    raked = materialize(rake(cells, targets, fraction=fraction), "raked").drop("tokens")
    if raked.count() <= 100_000:
        raked = F.broadcast(raked)
    joined = wide.join(raked, list(DIMS), "left")
    # A cell without any word has no share to rake: its documents hold no token and are kept.
    own = joined.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "p": F.coalesce("p", F.lit(1.0))})
    return own.withColumn("kept", F.col("m_draw") < F.col("p"))


def mixing(docs: DataFrame) -> DataFrame:
    own = F.col("row.doc_id").alias("doc_id")
    return mix(docs).select(own, F.col("m_source").alias("source"), F.col("m_lang").alias("lang"), F.col("m_topic").alias("topic"), F.col("m_tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "kept")


def mixed(docs: DataFrame, targets=POWERS, fraction: float = FRACTION, topic: Column | None = None) -> DataFrame:
    """The documents that the sample keeps, with the columns that they came with."""
    return mix(docs, targets, fraction, topic).filter("kept").select("row.*")


def marginals(docs: DataFrame, targets=POWERS, fraction: float = FRACTION, topic: Column | None = None) -> DataFrame:
    """dim, value, and its share of tokens: target, before, expected of the sample, and in the sample."""
    found = mix(docs, targets, fraction, topic)
    found = found.groupBy(*DIMS, "p", *(f"t_{d}" for d in DIMS)).agg(F.sum("m_tokens").alias("n"), F.sum(F.when(F.col("kept"), F.col("m_tokens")).otherwise(0)).alias("k"))
    each = F.explode(F.array(*(F.struct(F.lit(d[2:]).alias("dim"), F.col(d).alias("value"), F.col(f"t_{d}").alias("target")) for d in DIMS))).alias("v")
    found = found.filter("n > 0").select(each, "n", "k", (F.col("p") * F.col("n")).alias("e")).groupBy("v.dim", "v.value").agg(F.max("v.target").alias("target"), *(F.sum(c).alias(c) for c in "nke"))
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy("dim"))
    return found.select("dim", "value", "target", share("n").alias("before"), share("e").alias("expected"), share("k").alias("sample"))


def sql(docs: str = "documents") -> str:
    dims = ("source", "lang", "topic")
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM {docs})",
        "e AS (SELECT doc_id, source, lang, CASE WHEN regexp_matches(t, '(?i)licen[cs]e|all rights reserved') THEN 'licence' WHEN contains(t, ' | ') THEN 'table' "
        "WHEN 10 * (length(t) - length(regexp_replace(t, '[#*$%&<>]', '', 'g'))) > length(t) THEN 'noise' ELSE 'prose' END AS topic, "
        "len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM d)",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM e GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "c1 AS (SELECT *, tokens / sum(tokens) OVER () AS s FROM c0)",
    ]
    every = ", ".join(dims)

    def fill(source: str, group: str, given: str, room: str, total: str, name: str, keep: str) -> str:
        part = f"PARTITION BY {group}" if group else ""
        order = f"({part} ORDER BY {room} / greatest({given}, {TINY}), {every} ROWS BETWEEN"
        inner = (
            f"SELECT *, coalesce(sum({room}) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f_before, "
            f"sum({given}) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS f_rest FROM {source}"
        )
        inner = f"SELECT *, ({total} - f_before) / greatest(f_rest, {TINY}) AS f_factor FROM ({inner})"
        factor = f"greatest(coalesce(max(CASE WHEN f_factor * {given} <= {room} THEN f_factor END) OVER ({part}), {HUGE}), 0)"
        return f"SELECT {keep}, least({room}, {factor} * {given}) AS {name} FROM ({inner})"

    keep, last = f"{every}, s, room", "c2"
    parts.append(f"c2 AS (SELECT {every}, s, s / {FRACTION} AS room FROM c1)")
    for d in dims:
        goal = (
            f"SELECT *, CASE WHEN first THEN pow(share, {POWERS[d]}) ELSE 0.0 END AS goal, CASE WHEN first THEN share / {FRACTION} ELSE 0.0 END AS most FROM "
            f"(SELECT *, sum(s) OVER (PARTITION BY {d}) AS share, row_number() OVER (PARTITION BY {d} ORDER BY {every}) = 1 AS first FROM {last})"
        )
        parts.append(f"g_{d} AS ({fill(f'({goal})', '', 'goal', 'most', '1.0', 't', keep)})")
        parts.append(f"t_{d} AS (SELECT {keep}, max(t) OVER (PARTITION BY {d}) AS t_{d} FROM g_{d})")
        keep, last = f"{keep}, t_{d}", f"t_{d}"
    parts.append(f"x0 AS (SELECT *, s AS x FROM {last})")
    n = 0
    for _ in range(ROUNDS):
        for d in dims:
            parts.append(f"x{n + 1} AS ({fill(f'x{n}', d, 'x', 'room', f't_{d}', 'x', keep)})")
            n += 1
    parts.append(f"r AS (SELECT {every}, round(x / s, 9) AS weight, round(least(1.0, x / room), 9) AS p FROM x{n})")
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 1.0), 6) AS weight, round(coalesce(p, 1.0), 6) AS p, "
        f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}'), 1, 13))::BIGINT / {float(1 << 52)} < coalesce(p, 1.0) AS kept "
        "FROM e LEFT JOIN r USING (source, lang, topic)"
    )
