"""Sequences: dense positions, vocabulary, token numbers, lookahead pairs, sliding windows, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.session import partitions, write_table

#: Positions of one sequence that a window function sees at once.
BLOCK = 4096


def token_sequence(rows: DataFrame, seq: str, order: list[str], token: str) -> DataFrame:
    """``seq_id, pos, token``: dense positions from 0 in ``order`` (a total order) within each sequence.

    One range sort; the position is the row's place in its range chunk plus the rows of the sequence in the chunks
    before, so a sequence that holds most rows is numbered by many tasks. Rows with a null sequence or token are
    dropped. An empty table gives no rows.
    """
    spark = rows.sparkSession
    names = [f"o{i}" for i in range(len(order))]
    kept = rows.where(F.col(seq).isNotNull() & F.col(token).isNotNull()).select(
        F.col(seq).cast("long").alias("seq_id"), F.col(token).alias("token"), *(F.col(o).alias(n) for o, n in zip(order, names))
    )
    ranged = kept.repartitionByRange(partitions(spark), "seq_id", *names).sortWithinPartitions("seq_id", *names)
    placed = write_table(ranged.select("seq_id", "token", F.monotonically_increasing_id().alias("at")), "sequence").df
    chunk = F.shiftright("at", 33)
    sizes = placed.groupBy("seq_id", chunk.alias("chunk")).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("seq_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("seq_id", "chunk", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.withColumn("chunk", chunk).join(offsets, ["seq_id", "chunk"]).select("seq_id", (F.col("at") - F.col("start") + F.col("offset")).alias("pos"), "token")


def concatenated(*parts: DataFrame) -> DataFrame:
    """The parts one after the other: positions of each go on after the end of those before, per sequence."""
    out = parts[0]
    for p in parts[1:]:
        length = out.groupBy("seq_id").agg((F.max("pos") + 1).alias("shift"))
        out = out.unionByName(p.join(length, "seq_id", "left").select("seq_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "token"))
    return out


def numbered(values: DataFrame, order: str) -> DataFrame:
    """``value, number``: distinct non-null values numbered from 0 in ``order`` (of one column ``value``), by many tasks."""
    each = values.where("value is not null").distinct().select(F.lit(0).alias("seq_id"), "value", F.expr(order).alias("at"))
    return token_sequence(each, "seq_id", ["at"], "value").select(F.col("token").alias("value"), F.col("pos").alias("number"))


def vocabulary(sequence: DataFrame) -> DataFrame:
    """``token, token_id``: distinct tokens numbered from 0 in byte order (the same in every run)."""
    return numbered(sequence.select(F.col("token").alias("value")), "value").select(F.col("value").alias("token"), F.col("number").alias("token_id"))


def numberify(sequence: DataFrame, vocab: DataFrame) -> DataFrame:
    """``seq_id, pos, token_id``; a token that isn't in the vocabulary is left out (:func:`unknown_tokens` counts them)."""
    return sequence.select("seq_id", "pos", "token").join(vocab.select("token", "token_id"), "token").select("seq_id", "pos", "token_id")


def unknown_tokens(sequence: DataFrame, vocab: DataFrame) -> int:
    return sequence.join(vocab, "token", "left_anti").count()


def blocked(sequence: DataFrame, ahead: int, behind: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds ``block`` and ``own``: every sequence is cut into blocks, each with copies of the ``behind`` positions before
    and the ``ahead`` positions after it, so that row windows can be partitioned by ``seq_id, block`` and no task ever
    holds a whole long sequence. Rows that aren't ``own`` are only looked at."""
    b = F.floor(F.col("pos") / block)
    first = F.floor((F.col("pos") - ahead) / block)
    last = F.floor((F.col("pos") + behind) / block)
    kept = sequence.select("seq_id", "pos", *(c for c in ("token", "token_id") if c in sequence.columns))
    each = kept.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return each.withColumn("own", b == F.col("block"))


def in_block() -> Window:
    return Window.partitionBy("seq_id", "block").orderBy("pos")


def lookahead_pairs(sequence: DataFrame, lookahead: int) -> DataFrame:
    """``seq_id, k, one, two, ctx, nxt``: each position with the tokens 1..lookahead places on. Pairs that reach beyond the end aren't there."""
    w = in_block()
    ahead = F.array(*(F.lead("token", k).over(w) for k in range(1, lookahead + 1)))
    rows = blocked(sequence, lookahead).select("seq_id", "pos", "token", "own", ahead.alias("ahead")).where("own")
    each = rows.select("seq_id", "pos", F.col("token").alias("ctx"), F.posexplode("ahead").alias("i", "nxt")).where("nxt is not null")
    return each.select("seq_id", (F.col("i") + 1).alias("k"), F.col("pos").alias("one"), (F.col("pos") + F.col("i") + 1).alias("two"), "ctx", "nxt")


def sliding_windows(numbered: DataFrame, window: int, k: int) -> DataFrame:
    """``seq_id, pos, win, label``: ``window`` consecutive token ids ending at ``pos`` and the one ``k`` places on; full windows with a label only."""
    w = in_block()
    span = w.rowsBetween(-(window - 1), 0)
    rows = blocked(numbered, k, window - 1).select(
        "seq_id", "pos", "own", F.collect_list("token_id").over(span).alias("win"), F.lead("token_id", k).over(w).alias("label")
    )
    return rows.where(F.col("own") & (F.size("win") == window) & F.col("label").isNotNull()).select("seq_id", "pos", "win", "label")


def one_hot(label: Column, size: int) -> Column:
    """An array of ``size`` zeros with a one at ``label``."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (j == label).cast("int"))


def batch_layout(sequence: DataFrame, size: int) -> DataFrame:
    """``seq_id, batches, last_batch``: number of batches of ``size`` rows and rows of the last (full batches stay full)."""
    n = sequence.groupBy("seq_id").agg(F.count("*").alias("n"))
    return n.select("seq_id", F.ceil(F.col("n") / size).cast("long").alias("batches"), ((F.col("n") - 1) % size + 1).alias("last_batch"))


def estimate_epochs(old: float, before: DataFrame, now: DataFrame, most_growth: float | None = 2.0, most: float | None = None) -> float:
    """Scales the epochs by the growth of the vocabulary, up to ``most_growth`` times and ``most`` in all; unchanged where there was none."""
    v = [d.select("token").distinct().count() for d in (before, now)]
    if not v[0]:
        return old
    growth = v[1] / v[0]
    out = (growth if most_growth is None else min(growth, most_growth)) * old
    return out if most is None else min(out, most)
