"""Problem 8: mixing sources to target weights.

Weighted fair queueing: each source's documents are shuffled and queued, repeats after the whole source; a document's
virtual finish time is the source's tokens up to it divided by the source's weight. The queues are merged by one
global range sort on the finish time, which is cut at the total budget. Running sums are taken per range chunk and
shifted by the sums of the chunks before, so a source that holds most documents is still spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.naming import source_name
from seqweave.llm.bpe import TOKENIZERS, token_counts
from seqweave.session import Written, partitions, ship, tables, write_table

#: Rows of the per-chunk sums (chunks times groups) that are sent to every task; more are joined by shuffle.
BROADCAST_SUMS = 500_000


def _local_sums(group: int, value: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        last, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).to_numpy(zero_copy_only=False)
            g = b.column(group).dictionary_encode()
            code = g.indices.to_numpy(zero_copy_only=False)
            cum = np.cumsum(v)
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            base = np.r_[0, cum[start[1:] - 1]]
            first = b.column(group)[0].as_py()
            local = cum - np.repeat(base, np.diff(np.r_[start, len(v)]))
            if first == last:
                local[: start[1] if len(start) > 1 else len(v)] += total
            last, total = b.column(group)[b.num_rows - 1].as_py(), int(local[-1])
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, chunk, np.int64)), pa.array(local)], names=[*b.schema.names, "chunk", "local_sum"])

    return run


def running_sum(rows: DataFrame, group: str, order: list[str], value: str, to: str) -> tuple[DataFrame, Written]:
    """Adds ``to``: the sum of ``value`` (a long) within ``group`` (a string) up to and with the row, in ``order`` (a total order)."""
    spark = rows.sparkSession
    ship(spark)
    parts = partitions(spark)
    keys = [group, *order]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = ", ".join([*(f"`{c}` {k}" for c, k in rows.dtypes), "chunk long", "local_sum long"])
    w = write_table(ranged.mapInArrow(_local_sums(rows.columns.index(group), rows.columns.index(value)), schema), "sums")
    sums = w.df.groupBy(group, "chunk").agg(F.max("local_sum").alias("s"))
    before = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    if parts + w.df.select(group).distinct().count() <= BROADCAST_SUMS:  # a group is in several chunks only where chunks meet
        offsets = F.broadcast(offsets)
    out = w.df.join(offsets, [group, "chunk"]).withColumn(to, F.col("offset") + F.col("local_sum"))
    return out.drop("chunk", "local_sum", "offset"), w


def sized_documents(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> Written:
    """Written table ``doc_id, source, tokens`` of all documents, the source in its one spelling."""
    return write_table(token_counts(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text"), folder, name), "sized")


def _usable(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents with tokens of the sources that have a share, with ``target_share, max_repeats``."""
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .where("source is not null and target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
    )
    return sized.where("tokens > 0").join(wanted, "source")


def _held(docs: DataFrame) -> DataFrame:
    """``source, held, share, room``: a source's tokens, and the total at which it runs out."""
    held = docs.groupBy("source").agg(F.sum("tokens").alias("held"), F.first("target_share").alias("share"), F.first("max_repeats").alias("repeats"))
    return held.select("source", "held", "share", (F.col("held") * F.col("repeats") / F.col("share")).alias("room"))


def _horizon(sources: list, budget: float) -> float:
    """A virtual time that no document within the budget finishes after.

    Up to time v each source has put out its share of v, but for its largest document at most, or all it may give. Past
    the time at which that makes up the budget, nothing gets in. ``sources`` have ``share, most, all_`` (what it may give).
    """
    v, total, rate = 0.0, -sum(s.most for s in sources), sum(s.share for s in sources)
    for s in sorted(sources, key=lambda s: s.all_ / s.share):
        end = s.all_ / s.share
        if rate > 0 and total + rate * (end - v) >= budget:
            break
        total, v, rate = total + rate * (end - v), end, rate - s.share
    else:
        return float("inf")
    return v + (budget - total) / rate * (1 + 1e-9)


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42) -> DataFrame:
    """The mixture in its order: ``doc_id, source, copy, tokens, finish, position_tokens``.

    ``targets`` has ``source, target_share, max_repeats``. A document is taken at most ``max_repeats`` times (null
    counts as 1), its repeats come after the whole source has been taken once more. ``budget`` is the total of tokens;
    by default the largest at which no source that has documents runs out, so that all of them keep their shares.
    Sources without documents, or of a share of 0 or less or null, give nothing, and the others share what they leave
    in proportion; beyond that total a source that has run out gives less. Documents of other or null sources and
    those without tokens aren't taken. Copies that can't get in any more are never built.
    """
    docs = _usable(sized, targets)
    # One row for each source that has a target.
    sources = docs.groupBy("source").agg(F.sum("tokens").alias("held"), F.max("tokens").alias("most"), F.first("target_share").alias("share"), F.first("max_repeats").alias("repeats")).withColumn("all_", F.col("held") * F.col("repeats")).collect()
    if budget is None:
        budget = math.floor(round(min(s.all_ / s.share for s in sources) * math.fsum(s.share for s in sources), 6)) if sources else 0
    last = _horizon(sources, budget)
    taken = [(s.source, min(s.repeats, 1 + math.floor(min(last, s.all_ / s.share) * s.share / s.held))) for s in sources]
    copies = docs.sparkSession.createDataFrame(taken, "source string, copies int")
    # The first hexadecimal digits of a digest put a source's documents in an order that has nothing to do with them.
    shuffled = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id", "source")), 1, 15), 16, 10).cast("long")
    queue = docs.join(copies, "source").select(
        "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), shuffled.alias("shuffled"), "doc_id", "tokens", "target_share",
    )
    with tables() as kept:
        summed, _ = running_sum(queue, "source", ["copy", "shuffled", "doc_id"], "tokens", "queued")
        timed = summed.select("doc_id", "source", "copy", "tokens", (F.col("queued") / F.col("target_share")).alias("finish"), F.lit("all").alias("everything"))
        merged, w = running_sum(timed.where(F.col("finish") <= last), "everything", ["finish", "source", "doc_id", "copy"], "tokens", "position_tokens")
        kept.append(w)
    return merged.where(F.col("position_tokens") <= budget).select("doc_id", "source", "copy", "tokens", "finish", "position_tokens")


def report(mixed: DataFrame, targets: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """Per target: ``source, target_share, actual_share, tokens, taken, documents``; sources without documents have 0.

    With ``sized``, the documents mixed, also ``unused``, the tokens of the source's documents that weren't taken even
    once, and ``binds``, whether the source is the one that runs out first and so sets the default budget.
    """
    own = mixed.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("taken"), F.sum(F.when(F.col("copy") == 1, 1)).alias("documents"),
        F.sum(F.when(F.col("copy") == 1, F.col("tokens"))).alias("once"),
    )
    all_ = mixed.agg(F.sum("tokens").alias("t")).first().t or 0
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share").dropDuplicates(["source"]).join(own, "source", "left")
    zero = F.lit(0).cast("long")
    more = []
    if sized is not None:
        held = _held(_usable(sized, targets))
        rows = rows.join(held.select("source", "held", "room"), "source", "left").crossJoin(F.broadcast(held.agg(F.min("room").alias("least"))))
        more = [(F.coalesce("held", zero) - F.coalesce("once", zero)).alias("unused"), F.coalesce(F.col("room") == F.col("least"), F.lit(False)).alias("binds")]
    return rows.select(
        "source", "target_share", (F.coalesce("tokens", zero) / F.lit(float(max(all_, 1)))).alias("actual_share"),
        *(F.coalesce(c, zero).alias(c) for c in ("tokens", "taken", "documents")),
        *more,
    )
