"""Problem 3: frequency of every distinct term.

Burst-trie counting: every worker keeps its terms in a trie whose leaves are small containers that burst into a node
when they grow; the leaves hold an occurrence and a record counter per term. Terms are then routed by adaptive
prefixes (short where terms are few, longer where they crowd), and matching subtrees are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.events import sorted_events
from seqweave.session import partitions, ship, write_table

BURST = 48
LOCAL = "term string, n_events long, n_sequences long, head_seq long, tail_seq long, listed boolean"
COUNTS = "term string, n_events long, n_sequences long, listed boolean"


class BurstTrie:
    """Terms to mutable counters. A node is a dict by first character, ``""`` being the term that ends there."""

    __slots__ = ("root", "burst")

    def __init__(self, burst: int = BURST):
        self.root: list = [False, {}]  # [is a node, container or children]
        self.burst = burst

    def at(self, term: str, new) -> list:
        """The counters of a term; ``new()`` makes them at its first sight."""
        node, i = self.root, 0
        while node[0]:
            c = term[i : i + 1]
            child = node[1].get(c)
            if child is None:
                child = node[1][c] = [False, {}]
            if not c:
                node, i = child, i
                break
            node, i = child, i + 1
        box = node[1]
        rest = term[i:]
        got = box.get(rest)
        if got is None:
            got = box[rest] = new()
            if len(box) > self.burst and len(box) > 1:
                self._burst(node)
        return got

    @staticmethod
    def _burst(node: list) -> None:
        children: dict = {}
        for rest, counters in node[1].items():
            child = children.setdefault(rest[:1], [False, {}])
            child[1][rest[1:]] = counters
        node[0], node[1] = True, children

    def items(self) -> Iterator[tuple[str, list]]:
        """All terms in the order of their characters."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node[0]:
                stack.extend((prefix + c, node[1][c]) for c in sorted(node[1], reverse=True))
            else:
                for rest in sorted(node[1]):
                    yield prefix + rest, node[1][rest]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts a range-sorted chunk. Sequences inside the chunk are complete; the first and the last may go on outside,
    so for them the term keeps the sequence itself, and the merge counts it once."""
    trie = BurstTrie()
    head = tail = None
    # counters: events, complete sequences, sequence seen last, is it in the head sequence
    for b in batches:
        if not b.num_rows:
            continue
        seqs = b.column(0)
        if head is None:
            head = seqs[0].as_py()
        tail = seqs[b.num_rows - 1].as_py()
        g = pa.table({"seq": seqs, "name": b.column(2)}).filter(b.column(2).is_valid()).group_by(["seq", "name"]).aggregate([([], "count_all")]).sort_by("seq")
        for seq, name, n in zip(g.column("seq").to_pylist(), g.column("name").to_pylist(), g.column("count_all").to_pylist()):
            c = trie.at(name, lambda: [0, 0, None, False])
            c[0] += n
            if c[2] != seq:
                c[1] += 1
                c[2] = seq
                if seq == head:
                    c[3] = True
    out: list[tuple] = []
    for term, (n, m, seen, in_head) in trie.items():
        in_tail = seen == tail
        inside = m - int(in_head) - int(in_tail and tail != head)
        out.append((term, n, inside, head if in_head else None, tail if in_tail and tail != head else None, False))
        if len(out) == 8192:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["term", "n_events", "n_sequences", "head_seq", "tail_seq", "listed"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the subtrees routed to one task."""
    trie = BurstTrie()
    for b in batches:
        for term, n, m, head, tail, listed in zip(*(b.column(i).to_pylist() for i in range(6))):
            c = trie.at(term, lambda: [0, 0, None, False])
            c[0] += n
            c[1] += m
            for s in (head, tail):
                if s is not None:
                    if c[2] is None:
                        c[2] = set()
                    c[2].add(s)
            c[3] |= listed
    out: list[tuple] = []
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["term", "n_events", "n_sequences", "listed"]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for term, (n, m, open_, listed) in trie.items():
        out.append((term, n, m + len(open_ or ()), listed))
        if len(out) == 8192:
            yield batch()
            out = []
    if out:
        yield batch()


def routes(terms: DataFrame, most: int) -> list[str]:
    """The crowded prefixes, by depth: a prefix shared by more than ``most`` rows is split by its next character.

    Their number is at most the depth times rows / most, whatever the data.
    """
    crowded: list[str] = []
    under, depth = terms, 0
    while True:
        depth += 1
        level = (
            under.where(F.length("term") >= depth)
            .groupBy(F.substring("term", 1, depth).alias("prefix"))
            .agg(F.count("*").alias("n"), F.max(F.length("term")).alias("longest"))
            .where((F.col("n") > most) & (F.col("longest") > depth))
            .select("prefix").collect()
        )
        if not level:
            return crowded
        found = [r.prefix for r in level]
        crowded += found
        under = under.join(_prefixes(terms, found), F.substring("term", 1, depth) == F.col("crowded"), "left_semi")


def _prefixes(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """``crowded``: prefixes as a table, sent to every task (their number is bounded, see :func:`routes`); in the plan it is one leaf."""
    return F.broadcast(rows.sparkSession.createDataFrame([(p,) for p in prefixes], "crowded string"))


def routed(rows: DataFrame, crowded: list[str]) -> DataFrame:
    """Adds ``route``, the shortest prefix of ``term`` that isn't crowded."""
    by_depth: dict[int, list[str]] = {}
    for p in crowded:
        by_depth.setdefault(len(p), []).append(p)
    depths = sorted(by_depth)
    out = F.substring("term", 1, (depths[-1] if depths else 0) + 1)
    for d in reversed(depths):
        rows = rows.join(_prefixes(rows, by_depth[d]).withColumnRenamed("crowded", f"crowded{d}"), F.substring("term", 1, d) == F.col(f"crowded{d}"), "left")
        out = F.when(F.col(f"crowded{d}").isNotNull(), out).otherwise(F.substring("term", 1, d))
    return rows.withColumn("route", out).drop(*(f"crowded{d}" for d in depths))


def term_counts(ptb: DataFrame, vocabulary: DataFrame, rare_below: int = 3, common_above: float = 0.5) -> DataFrame:
    """``token, n_events, n_sequences, mark`` for every token of the vocabulary.

    ``n_events`` counts events (deliveries of one event once), ``n_sequences`` the sequences that hold one. ``mark``
    is ``rare`` below ``rare_below`` sequences (0 included), ``common`` above the share ``common_above`` of all
    sequences, else null. Null vocabulary rows are skipped, repeated ones count once; events without a name count for
    nothing but their sequence counts as one. An empty ``ptb`` makes every token rare.
    """
    spark = ptb.sparkSession
    ship(spark)
    parts = partitions(spark)
    local = write_table(sorted_events(ptb, parts, with_time=False).mapInArrow(_local, LOCAL), "terms")
    listed = vocabulary.where("token is not null").select(
        F.col("token").alias("term"), *(F.lit(0).cast("long").alias(c) for c in ("n_events", "n_sequences")),
        *(F.lit(None).cast("long").alias(c) for c in ("head_seq", "tail_seq")), F.lit(True).alias("listed"),
    )
    rows = local.df.unionByName(listed)
    n = rows.count()
    crowded = routes(rows.select("term"), max(1000, n // (8 * parts)))
    counts = (
        routed(rows, crowded).repartition(parts, "route").drop("route")
        .mapInArrow(_merged, COUNTS)
        .where("listed")
    )
    sequences = ptb.where("seq_id is not null").select("seq_id").distinct().count()
    mark = F.when(F.col("n_sequences") < rare_below, "rare").when(F.col("n_sequences") > common_above * sequences, "common")
    return counts.select(F.col("term").alias("token"), "n_events", "n_sequences", mark.alias("mark"))
