"""Training examples from conversations: label masks, padded batches, and rows of bounded length packed with several examples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.operators.corpus import chunked
from votemill.sources.scratch import written

# The chat template's marks.
TURN, END = "<|im_start|>", "<|im_end|>"
MARKER = f"{TURN}assistant\n"

#: Examples that one task packs, about.
RANGE_ROWS = 20_000


def rendered(conv: DataFrame) -> DataFrame:
    """conv_id and text of each conversation (conv_id, messages) in the chat template; null roles and contents are empty."""
    said = lambda m: F.concat(F.lit(TURN), F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(END + "\n"))
    return conv.select("conv_id", F.array_join(F.transform("messages", said), "").alias("text"))


def label_masks(texts: DataFrame, most: int = 2048) -> DataFrame:
    """conv_id, length, cut and labelled: a text of `most` characters at most, of which the first `cut` are masked: all turns and
    marks up to the last answer's marker, or everything where there is no marker. Characters stand for tokens."""
    text = F.left("text", F.lit(most))
    rows = texts.select("conv_id", text.alias("text"), F.length(text).alias("length"))
    answer = F.when(F.contains("text", F.lit(MARKER)), F.length(F.substring_index("text", MARKER, -1))).otherwise(0)
    return rows.select("conv_id", "length", (F.col("length") - answer).alias("cut"), answer.alias("labelled"))


def padded(masks: DataFrame, size: int = 8) -> DataFrame:
    """masks in batches of `size` by id: batch, place, and the padding that brings a row to its batch's longest."""
    longest = F.max("length").over(Window.partitionBy("chunk"))
    return chunked(masks, size, "conv_id").withColumn("padding", longest - F.col("length")).withColumnRenamed("chunk", "batch")


def first_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, in the order given: the first bin that has room, else a new one."""
    room, used, out = np.zeros(len(lengths), np.int64), 0, np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        at = int(np.argmax(room[:used] >= n)) if used else 0
        if not used or room[at] < n:
            at, used = used, used + 1
            room[at] = capacity
        room[at] = room[at] - n if room[at] >= n else -1  # a longer one leaves no room, not even for nothing
        out[i] = at
    return out


def packed(rows: DataFrame, capacity: int, key: str = "conv_id", length: str = "length", seed: str = "42", within: int = RANGE_ROWS) -> DataFrame:
    """key, length, pack (a number from 0), start (offset in it) and part_: examples first-fit by falling length, part by part.

    Parts are dealt by a hash of the key and the length and hold about `within` rows, so that a task's bins are bounded whatever the
    table's size; a part's packs follow those of the parts before. An example longer than the capacity has a pack of its own.
    """
    parts = max(1, -(-rows.count() // within))
    dealt = rows.select(key, F.col(length).cast("long").alias("length"), F.pmod(F.xxhash64(F.lit(seed), key, length), F.lit(parts)).cast("int").alias("part_"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", key], ascending=[False, True], kind="stable")
        own = first_fit(group["length"].to_numpy(), capacity)
        group["pack"] = own
        group["start"] = group.groupby("pack")["length"].cumsum() - group["length"]
        return group

    kind = {f.name: f.dataType.simpleString() for f in dealt.schema}
    fitted = written(dealt.groupBy("part_").applyInPandas(fit, f"{key} {kind[key]}, length long, part_ int, pack long, start long"))
    sizes = fitted.groupBy("part_").agg((F.max("pack") + 1).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    moved = fitted.join(F.broadcast(sizes.select("part_", before.alias("before_"))), "part_")
    return moved.select(key, "length", (F.col("pack") + F.col("before_")).alias("pack"), "start", "part_")
