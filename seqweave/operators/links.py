"""Links: which pairs of positions belong together, and the groups (activity instances) they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.operators.sequence import token_sequence
from seqweave.session import Written, partitions, ship, write_table

#: Pairs that a task joins at once (about 100 MB).
PORTION = 1_000_000
#: Pairs of centres that one task ends the joining of (PORTION at most); more take distributed rounds until so few are left.
LOCAL_CENTRES = 1_000_000


def link_edges(pairs: DataFrame, prob: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``seq_id, k, one, two``: pairs whose event is at least as probable as its threshold asks.

    Whether a pair links depends on its offset and its two tokens only, so that is decided once per triple and the
    pairs are semi-joined with the triples that link.
    """
    strong = prob.join(thresholds, prob.nxt == thresholds.token).where("p >= threshold").select("k", "ctx", "nxt")
    return pairs.join(strong, ["k", "ctx", "nxt"], "left_semi").select("seq_id", "k", "one", "two")


def delta_edges(pairs: DataFrame, deltas: DataFrame, rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """As :func:`link_edges`, by the rise of the probability since the position before instead of the probability.

    ``deltas`` has ``seq_id, pos, k, token, delta`` where it isn't 0, ``rows`` the ``k, ctx`` that have a row at all.
    """
    at = deltas.select("seq_id", "k", F.col("pos").alias("one"), F.col("token").alias("nxt"), "delta")
    scored = pairs.join(rows.select("k", "ctx"), ["k", "ctx"], "left_semi").join(at, ["seq_id", "k", "one", "nxt"], "left").join(thresholds, F.col("nxt") == thresholds.token)
    return scored.where(F.coalesce("delta", F.lit(0.0)) >= F.col("threshold")).select("seq_id", "k", "one", "two")


def score_edges(pairs: DataFrame, scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """As :func:`link_edges`, for estimators whose probabilities differ by position: ``scores`` has ``seq_id, pos, k, token, p``."""
    at = scores.join(thresholds, "token").where("p >= threshold").select("seq_id", "k", F.col("pos").alias("one"), F.col("token").alias("nxt"))
    return pairs.join(at, ["seq_id", "k", "one", "nxt"], "left_semi").select("seq_id", "k", "one", "two")


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by vectorised hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``seq_id, a, b`` to ``seq_id, v, p``: each node of a chunk with the least node of its group in the chunk. A chunk
    is what a task has, in portions of about PORTION pairs."""
    got: list[pa.RecordBatch] = []
    n = 0
    for x in batches:
        if x.num_rows:
            got.append(x)
            n += x.num_rows
        if n >= PORTION:
            yield _stars(got)
            got, n = [], 0
    if got:
        yield _stars(got)


def _stars(got: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(got)
    seq, a, b = (t.column(i).to_numpy() for i in range(3))
    of, at = np.concatenate([seq, seq]), np.concatenate([a, b])
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1])]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    of, at = of[new], at[new]
    label = local_labels(len(at), code[: len(seq)], code[len(seq) :])
    return pa.RecordBatch.from_arrays([pa.array(of), pa.array(at), pa.array(at[label])], names=["seq_id", "v", "p"])


def _jump(parents: DataFrame) -> Written:
    """``seq_id, v, p``: the root of each node of a forest (roots are their own parents); three jumps a job."""
    now, last = parents, None
    while True:
        for _ in range(3):
            up = now.select("seq_id", F.col("v").alias("p"), F.col("p").alias("q"))
            moved = now.join(up, ["seq_id", "p"]).select("seq_id", "v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            now = moved.select("seq_id", "v", "p")
        w = write_table(moved, "roots")
        if last is not None:
            last.drop()
        last, now = w, w.df.select("seq_id", "v", "p")
        if w.df.where("moved").isEmpty():
            return w


def _joined(pairs: DataFrame) -> DataFrame:
    """``seq_id, link_id, pos``: the connected components of pairs ``seq_id, a, b``, named by their least position.

    Each chunk of pairs is first reduced to its own stars. Where a node has stars in several chunks their centres belong
    together: only these take rounds of joins, in each of which every root hooks on the least root next to it if that is
    smaller, and pointers are shortened. A root that doesn't hook has only larger neighbours, which do, so at most half of
    the trees remain. Rounds go on until at most LOCAL_CENTRES pairs of centres are left, which one task joins.
    """
    spark = pairs.sparkSession
    ship(spark)
    stars = write_table(pairs.repartitionByRange(partitions(spark), "seq_id", "a", "b").mapInArrow(local_stars, "seq_id long, v long, p long"), "stars").df
    nodes = write_table(stars.groupBy("seq_id", "v").agg(F.min("p").alias("m"), F.count("*").alias("chunks")), "nodes").df
    several = nodes.where("chunks > 1").select("seq_id", "v", "m")
    now = write_table(stars.join(several, ["seq_id", "v"]).where("p <> m").select("seq_id", F.col("p").alias("a"), F.col("m").alias("b")).distinct(), "pairs")
    label = None
    while (left := now.df.count()) > LOCAL_CENTRES:
        if label is None:
            centres = now.df.select("seq_id", F.col("a").alias("v")).unionByName(now.df.select("seq_id", F.col("b").alias("v"))).distinct()
            label = write_table(centres.select("seq_id", "v", F.col("v").alias("p")), "components")
        ends = now.df.unionByName(now.df.select("seq_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("seq_id", "a").agg(F.min("b").alias("m"))
        root = _jump(least.select("seq_id", F.col("a").alias("v"), F.least("a", "m").alias("p")))
        to = root.df.select("seq_id", F.col("v").alias("p"), F.col("p").alias("q"))
        after = write_table(label.df.join(to, ["seq_id", "p"], "left").select("seq_id", "v", F.coalesce("q", "p").alias("p")), "components")
        qa, qb = to.select("seq_id", F.col("p").alias("a"), F.col("q").alias("na")), to.select("seq_id", F.col("p").alias("b"), F.col("q").alias("nb"))
        rest = write_table(now.df.join(qa, ["seq_id", "a"]).join(qb, ["seq_id", "b"]).where("na <> nb").select("seq_id", F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "pairs")
        label.drop(), now.drop(), root.drop()
        label, now = after, rest
    if not left and label is None:
        return nodes.select("seq_id", F.col("m").alias("link_id"), F.col("v").alias("pos"))
    end = label.df.select("seq_id", F.col("v").alias("m"), F.col("p").alias("to")) if label else None
    if left:
        last = now.df.coalesce(1).mapInArrow(local_stars, "seq_id long, v long, p long").select("seq_id", F.col("v").alias("to"), F.col("p").alias("root"))
        end = last.withColumnsRenamed({"to": "m", "root": "to"}) if end is None else end.join(last, ["seq_id", "to"], "left").select("seq_id", "m", F.coalesce("root", "to").alias("to"))
    return nodes.join(end, ["seq_id", "m"], "left").select("seq_id", F.coalesce("to", "m").alias("link_id"), F.col("v").alias("pos"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("one is not null and two is not null and one <> two and seq_id is not null")


def link_groups(edges: DataFrame) -> DataFrame:
    """``seq_id, link_id, pos``: groups as edges arrive in the order of offset and position.

    A position joins the group of its partner at its first edge, or both start a new one; later edges between placed
    positions change nothing. So groups are the trees that each position's first edge makes: the components of first edges.
    Repeated edges count once; edges with a null end or of a position with itself are dropped.
    """
    clean = _clean(edges).select("seq_id", "k", "one", "two")
    edge = F.struct("k", "one", "two").alias("e")
    ends = clean.select("seq_id", F.col("one").alias("v"), edge).unionByName(clean.select("seq_id", F.col("two").alias("v"), edge))
    return _joined(ends.groupBy("seq_id", "v").agg(F.min("e").alias("e")).select("seq_id", F.col("e.one").alias("a"), F.col("e.two").alias("b")))


def link_groups_merged(edges: DataFrame) -> DataFrame:
    """``seq_id, link_id, pos``: groups that merge when an edge joins them, the connected components of all edges.

    Same treatment of repeated, null and self edges as :func:`link_groups`.
    """
    return _joined(_clean(edges).select("seq_id", F.col("one").alias("a"), F.col("two").alias("b")))


def numbered_links(groups: DataFrame) -> DataFrame:
    """``seq_id, link_id, pos`` with links numbered over all sequences, in the order of sequence and least position.

    ``groups`` are named by their least position, so each has one row at which it is its own name.
    """
    heads = groups.where("pos = link_id").select(F.lit(0).alias("all"), "seq_id", "link_id", F.struct("seq_id", "link_id").alias("group"))
    number = token_sequence(heads, "all", ["seq_id", "link_id"], "group").select(F.col("token.seq_id").alias("seq_id"), F.col("token.link_id").alias("link_id"), F.col("pos").alias("number"))
    return groups.join(number, ["seq_id", "link_id"]).select("seq_id", F.col("number").alias("link_id"), "pos")


def link_contents(members: DataFrame, sequence: DataFrame) -> DataFrame:
    """``seq_id, link_id, tokens``: the tokens at a link's positions in their order; unknown positions add nothing."""
    rows = members.where("pos is not null").select("seq_id", "link_id", "pos").distinct().join(sequence.select("seq_id", "pos", "token"), ["seq_id", "pos"])
    return rows.groupBy("seq_id", "link_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("o")).select("seq_id", "link_id", F.col("o.token").alias("tokens"))


def link_span(members: DataFrame) -> DataFrame:
    """``seq_id, link_id, first_pos, last_pos, mean_pos, size``; repeated and null positions don't count."""
    rows = members.where("pos is not null").select("seq_id", "link_id", "pos").distinct()
    return rows.groupBy("seq_id", "link_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.avg("pos").alias("mean_pos"), F.count("*").alias("size"))
