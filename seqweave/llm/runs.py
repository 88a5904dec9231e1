"""Problem 1: repeated consecutive events.

Associative run summaries: the events are range-sorted into chunks, each chunk encodes its runs by itself, and only
its first and last run can go on in a neighbour. Those two are merged over all chunks by a tree of fan-in ``FAN_IN``
whose step is associative, so a run may span any number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.events import sorted_events
from seqweave.session import partitions, ship, write_table

FAN_IN = 512
SUMMARY = "chunk long, ord int, open boolean, seq_id long, name string, first_pos long, last_pos long, n_events long, t_min long, t_max long"
_COLUMNS = ["chunk", "ord", "open", "seq_id", "name", "first_pos", "last_pos", "n_events", "t_min", "t_max"]
_NO_MIN, _NO_MAX = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _encode(least: int):
    """Batches of sorted events to run summaries; the open ones are the chunk's first and last run."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        carry: list | None = None  # the run that still goes on: seq, name, first, last, n, t_min, t_max
        ord_ = 0

        def rows(runs: list[list], opened: list[bool]) -> pa.RecordBatch:
            nonlocal ord_
            kept = [(r, o) for r, o in zip(runs, opened) if o or (r[1] is not None and r[4] >= least)]
            cols = list(zip(*[(chunk, ord_ + i, o, *r[:5], None if r[5] == _NO_MIN else r[5], None if r[6] == _NO_MAX else r[6]) for i, (r, o) in enumerate(kept)])) or [[]] * 10
            ord_ += len(kept)
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_COLUMNS)

        first = True
        for b in batches:
            if not b.num_rows:
                continue
            seq = b.column(0).to_numpy(zero_copy_only=False)
            pos = b.column(1).to_numpy(zero_copy_only=False)
            d = b.column(2).dictionary_encode()
            code = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = d.dictionary.to_pylist()
            t = b.column(3)
            has = np.asarray(t.is_valid())
            micros = t.fill_null(0).to_numpy(zero_copy_only=False)
            lo, hi = np.where(has, micros, _NO_MIN), np.where(has, micros, _NO_MAX)
            start = np.flatnonzero(np.r_[True, (seq[1:] != seq[:-1]) | (code[1:] != code[:-1])])
            end = np.r_[start[1:], len(seq)]
            t_min, t_max = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
            runs = [
                [s, names[c] if c >= 0 else None, p, q, n, x, y]
                for s, c, p, q, n, x, y in zip(seq[start].tolist(), code[start].tolist(), pos[start].tolist(), pos[end - 1].tolist(), (end - start).tolist(), t_min.tolist(), t_max.tolist())
            ]
            if carry is not None:
                if carry[0] == runs[0][0] and carry[1] == runs[0][1]:
                    _join(carry, runs[0])
                    runs[0] = carry
                else:
                    runs.insert(0, carry)
            carry = runs.pop()
            if runs:
                yield rows(runs, [first] + [False] * (len(runs) - 1))
                first = False
        if carry is not None:
            yield rows([carry], [True])

    return encode


def _join(a: list, b: list) -> None:
    a[3], a[4], a[5], a[6] = b[3], a[4] + b[4], min(a[5], b[5]), max(a[6], b[6])


def _merge(last: bool, least: int):
    """Joins the open runs of up to FAN_IN neighbouring chunks; what is inside is complete, the two ends stay open."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "ord"])
        merged: list[list] = []
        for chunk, seq, name, p, q, n, lo, hi in zip(pdf.chunk, pdf.seq_id, pdf.name_, pdf.first_pos, pdf.last_pos, pdf.n_events, pdf.t_min, pdf.t_max):
            run = [seq, name, p, q, n, _NO_MIN if pd.isna(lo) else int(lo), _NO_MAX if pd.isna(hi) else int(hi), chunk]
            if merged and merged[-1][0] == seq and merged[-1][1] == name and isinstance(name, str) and merged[-1][7] != chunk:
                _join(merged[-1], run)
                merged[-1][7] = chunk
            else:
                merged.append(run)
        block = int(pdf.chunk.iloc[0]) // FAN_IN
        out = []
        for i, r in enumerate(merged):
            open_ = not last and i in (0, len(merged) - 1)
            if open_ or (isinstance(r[1], str) and r[4] >= least):
                out.append((block, i, open_, *r[:5], None if r[5] == _NO_MIN else r[5], None if r[6] == _NO_MAX else r[6]))
        f = pd.DataFrame(out, columns=_COLUMNS)
        return f.astype({"t_min": "Int64", "t_max": "Int64"})

    return merge


def repeated_runs(ptb: DataFrame, least: int = 2) -> DataFrame:
    """Longest stretches of at least ``least`` consecutive events of one sequence that have the same name.

    ``seq_id, name, first_pos, last_pos, n_events, duration_s``. Lost positions don't end a stretch, an event
    without a name does and is in none; a second delivery of an event isn't a second event. ``duration_s`` is the
    span between the earliest and the latest known time of the stretch, null if none is known; times may step back.
    An empty table gives no rows; other columns of the input are ignored.
    """
    spark = ptb.sparkSession
    ship(spark)
    parts = partitions(spark)
    events = sorted_events(ptb, parts).withColumn("ts", F.unix_micros(F.col("ts")))
    level = write_table(events.mapInArrow(_encode(least), SUMMARY), "runs")
    out = level.df.where("not open")
    open_, chunks = level.df.where("open"), parts
    while True:
        last = chunks <= FAN_IN
        merged = (
            open_.withColumnRenamed("name", "name_")
            .groupBy((F.col("chunk") / FAN_IN).cast("long").alias("block"))
            .applyInPandas(_merge(last, least), SUMMARY)
        )
        chunks = -(-chunks // FAN_IN)
        if last:
            out = out.unionByName(merged)
            break
        level = write_table(merged, "runs")
        out = out.unionByName(level.df.where("not open"))
        open_ = level.df.where("open")
    return out.select("seq_id", "name", "first_pos", "last_pos", "n_events", ((F.col("t_max") - F.col("t_min")) / 1e6).alias("duration_s"))
