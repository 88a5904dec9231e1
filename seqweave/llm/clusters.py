"""Problem 2: grouping records into similarity clusters.

Hierarchical density clustering. Records with equal sets of names form one class. All pairs of classes that share more
than half of their names are neighbours; a first pass over them gives each class its core distance, that of its third
nearest record, a second one the mutual-reachability graph, in which no edge is shorter than the core distances of its
ends. Borůvka's algorithm makes the graph's minimum spanning forest, connected components apart from each other: those
that fit a task are ended by one, larger ones take distributed rounds. The forest's edges, merged at every distance that
occurs, are the condensed hierarchy; the most stable clusters are selected from it, and their most persistent members
describe them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.components import components
from seqweave.operators.links import local_labels
from seqweave.operators.sequence import token_sequence
from seqweave.session import Written, partitions, ship, tables, write_table

#: Sets are neighbours if more than this share (a fraction) of the names in either is in both, which is more than half of
#: the names of each where they are of one size.
SHARED = (1, 3)
#: The distance (1 - Jaccard similarity) beyond which no sets are neighbours; the roots of the hierarchy are born there.
FARTHEST = 1 - SHARED[0] / SHARED[1]
#: Clusters that hold together at this distance aren't split further (the selection epsilon of Malzer and Baum, 2020):
#: sets that have most of the names in either in both belong together by the problem's statement.
TOGETHER = 0.5
#: The core distance is that of this many-th nearest other record.
NEIGHBOURS = 3
#: Classes of a rare name's list that stay together; a longer list falls into blocks of about as many, compared two by two.
BLOCK = 1024
#: Candidate pairs that a task looks at together.
AT_ONCE = 1_000_000
#: Sets of more names than this are compared one by one, smaller ones many at once.
WIDE = 64
#: Edges that a task holds before it reduces them.
HELD = 2_000_000
#: Components of more classes than this (each has no more edges than names to be listed under) are spread over all tasks.
GIANT = 100_000
_EPS = 1e-9
GRAPH = "a long, b long, d double, na int, nb int"
SOLVED = "class long, cluster long, d double"


def name_sets(link_names: DataFrame, least_names: int = 3) -> Written:
    """Written ``link_id, names``: the names of each link with enough of them, as numbers, the rarest name having the least."""
    rarity = link_names.groupBy("name").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    numbered = token_sequence(rarity, "all", ["n", "name"], "name").select(F.col("token").alias("name"), F.col("pos").alias("number"))
    sets = link_names.join(numbered, "name").groupBy("link_id").agg(F.sort_array(F.collect_list("number")).alias("names"))
    return write_table(sets.where(F.size("names") >= least_names), "sets")


def local_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of the minimum spanning forest's edges (Borůvka, vectorised); ties go to the smaller (d, a, b)."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    order = np.lexsort((y, x, d))
    x, y = x[order], y[order]
    comp = np.arange(len(nodes))
    alive = np.arange(len(a))
    chosen = []
    while True:
        cx, cy = comp[x[alive]], comp[y[alive]]
        apart = cx != cy
        if not apart.any():
            break
        alive, cx, cy = alive[apart], cx[apart], cy[apart]
        best = np.full(len(nodes), -1)
        back = np.arange(len(alive))[::-1]
        rank = np.concatenate([back, back])
        at = np.concatenate([cx[::-1], cy[::-1]])
        by = np.argsort(-rank, kind="stable")
        best[at[by]] = rank[by]  # the last write is the least edge
        has = np.flatnonzero(best >= 0)
        e = best[has]
        chosen.append(alive[np.unique(e)])
        parent = np.arange(len(nodes))
        other = np.where(cx[e] == has, cy[e], cx[e])
        parent[has] = other
        mutual = parent[parent[has]] == has
        low = has[mutual & (has < other)]
        parent[low] = low
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        comp = parent[comp]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


class _Sets:
    """Lists of numbers as they lie in a column, and for each 64 bits of which every element sets one."""

    def __init__(self, column: pa.Array):
        offsets = column.offsets.to_numpy()
        self.start, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        self.flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
        bit = np.uint64(1) << ((self.flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        self.bits = np.zeros(len(self.size), np.uint64)
        np.bitwise_or.at(self.bits, np.repeat(np.arange(len(self.size)), self.size), bit)
        self.matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def matrix(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists of up to ``width`` elements filled up with -1, a row each, and the row of each list."""
        if width not in self.matrices:
            own = np.flatnonzero(self.size <= width)
            row = np.full(len(self.size), -1)
            row[own] = np.arange(len(own))
            m = np.full((len(own), width), -1, np.int64)
            at = np.repeat(row, self.size)
            m[at[at >= 0], (np.arange(len(self.flat)) - np.repeat(self.start, self.size))[at >= 0]] = self.flat[at >= 0]
            self.matrices[width] = m, row
        return self.matrices[width]

    def shared(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many elements rows i and j share, and the first of them."""
        n, first = np.zeros(len(i), np.int64), np.full(len(i), -1, np.int64)
        width = np.maximum(self.size[i], self.size[j])
        done = 0
        while done < WIDE:  # sets of about one size together
            upto = max(8, 2 * done)
            own = np.flatnonzero((width > done) & (width <= upto))
            for lo in range(0, len(own), 20_000):
                m, row = self.matrix(upto)
                at = own[lo : lo + 20_000]
                p, q = (np.ascontiguousarray(m[row[x[at]]].T) for x in (i, j))
                count, least = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
                for c in p[::-1]:
                    hit = q[0] == c
                    for e in q[1:]:
                        hit |= e == c
                    hit &= c >= 0
                    least = np.where(hit, c, least)
                    count += hit
                n[at], first[at] = count, least
            done = upto
        for at in np.flatnonzero(width > WIDE):
            both = np.intersect1d(*(self.flat[self.start[x] : self.start[x] + self.size[x]] for x in (i[at], j[at])), assume_unique=True)
            n[at], first[at] = len(both), both[0] if len(both) else -1
        return n, first


def _least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least overlap of neighbours with x and y names."""
    num, den = SHARED
    return num * (x + y) // (num + den) + 1


def _pairs(cell: np.ndarray, key: np.ndarray, ids: np.ndarray, names: _Sets, own: np.ndarray, at: np.ndarray, half: np.ndarray | None = None):
    """All neighbours among the rows of each cell (they follow each other): indices i, j of rows, and distances.

    ``own`` are the rows' places in ``names``, ``key`` is the number of the name that the cell lists and ``at`` its place in the row's set. A pair is given in the
    cell of the first name it shares only. With ``half``, only rows of different halves are compared.
    """
    sizes, bits = names.size[own], names.bits[own]
    n = len(cell)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.append(starts[1:], n)
    later = np.repeat(ends, ends - starts) - np.arange(n) - 1
    upto = np.concatenate([[0], np.cumsum(later)])
    rest = sizes - at
    got, lo = [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), later[lo:hi])
        j = i + 1 + np.arange(len(i)) - (upto[i] - upto[lo])
        need = _least(sizes[i], sizes[j])
        possible = (ids[i] != ids[j]) & (np.minimum(rest[i], rest[j]) >= need)
        if half is not None:
            possible &= half[i] != half[j]
        i, j, need = i[possible], j[possible], need[possible]
        # A name of one set whose bit the other doesn't have isn't shared: most chance meetings end here.
        p, q = bits[i], bits[j]
        possible = np.minimum(sizes[i] - np.bitwise_count(p & ~q), sizes[j] - np.bitwise_count(q & ~p)) >= need
        i, j, need = i[possible], j[possible], need[possible]
        shared, first = names.shared(own[i], own[j])
        near = (shared >= need) & (first == key[i])
        i, j, shared = i[near], j[near], shared[near]
        got.append((i, j, 1 - shared / (sizes[i] + sizes[j] - shared)))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*got))


def _ends(i, j, d, t: pa.Table) -> tuple:
    """Each neighbour of each end: the end, the distance, and the records that the neighbour stands for."""
    ids, copies = t.column(5).to_numpy(), t.column(7).to_numpy()
    return np.concatenate([ids[i], ids[j]]), np.concatenate([d, d]), np.concatenate([copies[j], copies[i]])


def _edges(i, j, d, t: pa.Table) -> tuple:
    """Edges of mutual reachability, the smaller class first."""
    ids, copies, core = (t.column(x).to_numpy() for x in (5, 7, 8))
    turned = ids[i] > ids[j]
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    return ids[i], ids[j], np.maximum(d, np.maximum(core[i], core[j])), copies[i], copies[j]


def _nearest(held: list[tuple]) -> tuple:
    """The distances of the nearest records of each end, at most NEIGHBOURS."""
    v, d, n = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((d, v))
    v, d, n = v[order], d[order], n[order]
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    before = np.cumsum(n) - n
    keep = before - np.repeat(before[start], np.diff(np.r_[start, len(v)])) < NEIGHBOURS
    return v[keep], d[keep], n[keep]


def _reduced(held: list[tuple]) -> tuple:
    """The spanning forest of edges: an edge outside it can't be in the whole forest."""
    e = tuple(np.concatenate(x) for x in zip(*held))
    keep = local_forest(*e[:3])
    return tuple(x[keep] for x in e)


def _near_rows(e: tuple) -> Iterator[pa.RecordBatch]:
    v, d, n = e
    d, v = np.repeat(d, np.minimum(n, NEIGHBOURS)), np.repeat(v, np.minimum(n, NEIGHBOURS))
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    at = np.r_[start, len(v)].astype(np.int32)
    for lo in range(0, len(start), 50_000):
        hi = min(lo + 50_000, len(start))
        yield pa.RecordBatch.from_arrays([pa.array(v[start[lo:hi]]), pa.ListArray.from_arrays(pa.array(at[lo : hi + 1]), pa.array(d))], names=["class", "near"])


def _edge_rows(e: tuple) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(e[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in e], names=["a", "b", "d", "na", "nb"])


def _by_cell(found: Callable, reduced: Callable, rows: Callable):
    """Over cells ``key, p, q, mine, at, class, names, copies[, core]``, sorted by the first three: what ``found`` makes of
    all pairs of neighbours, held only as far as ``reduced`` needs it."""

    def alike(t: pa.Table) -> list[tuple]:
        key, p, q, mine, at, ids = (t.column(i).to_numpy() for i in range(6))
        cell = np.cumsum(_begins(t))
        names = _Sets(t.column(6).combine_chunks())
        out = []
        for own, halves in ((np.flatnonzero(p == q), False), (np.flatnonzero(p != q), True)):
            if len(own):
                i, j, d = _pairs(cell[own], key[own], ids[own], names, own, at[own], mine[own] if halves else None)
                out.append(found(own[i], own[j], d, t))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0
        tail: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if tail and _begins(pa.concat_tables([tail[-1].slice(tail[-1].num_rows - 1), t]))[1:].any():
                t = pa.concat_tables([*tail, t])
                tail = []
            last = int(np.flatnonzero(_begins(t))[-1]) if not tail else 0
            tail.append(t.slice(last))
            if last:
                new = alike(t.slice(0, last))
                held += new
                n_held += sum(len(x[0]) for x in new)
            if n_held > HELD:
                held = [reduced(held)]
                n_held = len(held[0][0])
        if tail:
            yield from rows(reduced(held + alike(pa.concat_tables(tail))))

    return run


def _begins(t: pa.Table) -> np.ndarray:
    """Whether each row begins a cell."""
    out = np.zeros(t.num_rows, bool)
    out[0] = True
    for i in range(3):
        x = t.column(i).to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def _long_lists(classes: DataFrame) -> Written:
    """``key, blocks``: the names under which more than BLOCK classes are listed."""
    listed = classes.select(F.explode(F.slice("names", F.lit(1), _prefix())).alias("key"))
    return write_table(listed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "long")


def _prefix():
    """The length of a set's rare end that is sure to hold the first name it shares with any neighbour."""
    n = F.size("names")
    return n - F.floor(n * F.lit(SHARED[0]) / F.lit(SHARED[1]) + _EPS).cast("int")


def _cells(classes: DataFrame, long: DataFrame) -> DataFrame:
    """Each class under the names of its rare end: the cells in which all rows are compared, sorted.

    A list of more than BLOCK classes falls into blocks, and each two blocks of it are a cell of their own.
    """
    more = [c for c in classes.columns if c not in ("class", "names")]
    listed = classes.select(F.posexplode(F.slice("names", F.lit(1), _prefix())).alias("at", "key"), "class", "names", *more)
    blocks = listed.join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = blocks.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = each.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")}).select("key", "p", "q", "mine", "at", "class", "names", *more)
    return cells.repartition(partitions(classes.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q")


def core_distances(classes: DataFrame, long: DataFrame) -> DataFrame:
    """``class, core``: the distance of the NEIGHBOURS-th nearest other record, for classes that have a neighbour.

    Taken from all pairs of neighbours. The other records of a class are at distance 0, a neighbouring class counts for
    all its records. A class with fewer records in reach has the distance of the last, so a pair may be a cluster.
    """
    ship(classes.sparkSession)
    found = _cells(classes, long).mapInArrow(_by_cell(_ends, _nearest, _near_rows), "class long, near array<double>")
    near = found.groupBy("class").agg(F.flatten(F.collect_list("near")).alias("near"))  # one short row for each name it is listed under
    own = near.join(classes.select("class", "copies"), "class")
    all_ = F.sort_array(F.concat(F.array_repeat(F.lit(0.0), F.least(F.col("copies") - 1, F.lit(NEIGHBOURS))), "near"))
    return own.select("class", F.element_at(all_, F.least(F.lit(NEIGHBOURS), F.size(all_))).alias("core"))


def neighbour_graph(classes: DataFrame, long: DataFrame) -> DataFrame:
    """``a, b, d, na, nb``: the mutual-reachability graph of ``class, names, copies, core``, of which each task that compares
    cells keeps only the spanning forest of its own edges; ``na, nb`` are the records of its ends."""
    ship(classes.sparkSession)
    return _cells(classes, long).mapInArrow(_by_cell(_edges, _reduced, _edge_rows), GRAPH)


def _hierarchy(x: np.ndarray, y: np.ndarray, d: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The cluster of each atom, -1 for none: the most stable of the condensed hierarchy of forest edges x-y of distance d.

    Atoms are what holds together at TOGETHER. Edges of one distance merge at once, whatever their order. A merge that
    holds one cluster continues it; one that holds several begins a new one, which competes with them: its stability is
    the sum, over its records, of the span of 1 / distance from where the record leaves it to where it is born itself.
    """
    n = len(size)
    top = list(range(n))  # union-find over atoms

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    count = size.tolist()
    # Per root: its condensed cluster (-1: a single record), the sum of its records' 1 / distance, what its parts make at best.
    cluster: list[int] = []
    keeps: list[bool] = []
    above: list[int] = []
    left = [0.0] * n
    parts = [0.0] * n
    entered = [-1] * n

    def begin() -> int:
        cluster_id = len(keeps)
        keeps.append(True)
        above.append(-1)
        return cluster_id

    for v in range(n):
        cluster.append(begin() if count[v] >= 2 else -1)
        left[v] = count[v] / TOGETHER
        entered[v] = cluster[v]

    def end(v: int, born: float) -> float:
        """Closes a root's cluster where it is born; gives what it or its parts make."""
        own = left[v] - count[v] / born
        keeps[cluster[v]] = own >= parts[v] - _EPS
        return max(own, parts[v])

    order = np.argsort(d, kind="stable")
    xs, ys, ds = x[order].tolist(), y[order].tolist(), d[order].tolist()
    at = 0
    while at < len(ds):
        upto = at
        met: dict[int, int] = {}

        def meet(v: int) -> int:
            while met.setdefault(v, v) != v:
                v = met[v]
            return v

        while upto < len(ds) and ds[upto] <= ds[at] + _EPS:
            p, q = meet(find(xs[upto])), meet(find(ys[upto]))
            if p != q:
                met[max(p, q)] = min(p, q)
            upto += 1
        born = ds[at]
        groups: dict[int, list[int]] = {}
        for v in met:
            groups.setdefault(meet(v), []).append(v)
        for root, members in groups.items():
            held = [v for v in members if cluster[v] >= 0]
            total = sum(count[v] for v in members)
            if len(held) == 1:
                own = cluster[held[0]]
                sum_, best = left[held[0]] + (total - count[held[0]]) / born, parts[held[0]]
            else:
                own = begin()
                sum_, best = total / born, 0.0
                for v in held:
                    best += end(v, born)
                    above[cluster[v]] = own
            for v in members:
                if cluster[v] < 0:
                    entered[v] = own
                top[v] = root
            cluster[root], count[root], left[root], parts[root] = own, total, sum_, best
        at = upto
    for v in range(n):
        if top[v] == v and cluster[v] >= 0:
            end(v, FARTHEST)
    chosen = [-1] * len(keeps)
    for c in reversed(range(len(keeps))):  # clusters begin after their parts
        up = chosen[above[c]] if above[c] >= 0 else -1
        chosen[c] = up if up >= 0 else c if keeps[c] else -1
    return np.array([chosen[e] if e >= 0 else -1 for e in entered], np.int64)


def _solved(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Whole components, edges ``comp, a, b, d, na, nb``: their forest, hierarchy and clusters, one row per class."""
    t = pa.Table.from_batches(batches)
    a, b, d, na, nb = (t.column(i).to_numpy() for i in range(1, 6))
    keep = local_forest(a, b, d)
    a, b, d, na, nb = a[keep], b[keep], d[keep], na[keep], nb[keep]
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    copies = np.zeros(len(nodes), np.int64)
    copies[x], copies[y] = na, nb
    near = np.full(len(nodes), np.inf)
    np.minimum.at(near, x, d)
    np.minimum.at(near, y, d)
    tight = d <= TOGETHER + _EPS
    atom = local_labels(len(nodes), x[tight], y[tight])
    heads, at = np.unique(atom, return_inverse=True)
    chosen = _hierarchy(at[x[~tight]], at[y[~tight]], d[~tight], np.bincount(at, copies).astype(np.int64))[at]
    cluster = pa.nulls(len(nodes), pa.int64())
    if len(heads) and (has := chosen >= 0).any():
        least = np.full(chosen.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, chosen[has], nodes[has])
        cluster = pa.array(least[chosen], mask=~has)
    return pa.RecordBatch.from_arrays([pa.array(nodes), cluster, pa.array(near)], names=["class", "cluster", "d"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components sorted by ``comp``; about HELD / 4 edges are worked on at once, whole components of no more than they have."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        comp = b.column(0).to_numpy()
        if held and n > HELD // 4:
            cut = int(np.searchsorted(comp, held[-1].column(0)[held[-1].num_rows - 1].as_py(), side="right"))
            if cut < len(comp):
                yield _solved([*held, b.slice(0, cut)])
                held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield _solved(held)


def _roots(best: DataFrame) -> Written:
    """``c, p``: the root of each component that hooks on another; pointer jumping, two jumps a job."""
    own = best.select("c", F.col("e.o").alias("p"))
    back = best.select(F.col("c").alias("p"), F.col("e.o").alias("pp"))
    # Of two components that chose each other the smaller is the root; there are no longer cycles, as edges are totally ordered.
    now = own.join(back, "p").select("c", F.when(F.col("pp") == F.col("c"), F.least("c", "p")).otherwise(F.col("p")).alias("p"))
    w = None
    while True:
        for _ in range(2):
            up = now.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            before = now
            now = before.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
            moved, now = now, now.select("c", "p")
        w2 = write_table(moved, "roots")
        if w is not None:
            w.drop()
        w = w2
        if w.df.where("moved").isEmpty():
            return w
        now = w.df.select("c", "p")


def forest(edges: DataFrame, levels: list[float]) -> tuple[list[DataFrame | None], list[DataFrame]]:
    """Distributed Borůvka over growing distances ``levels``.

    Gives, per level, the map ``c, p`` of the components that it joined (from those of the level before, at first the
    nodes; None if it joined none) and the forest's edges ``a, b, d``.
    """
    rest = write_table(edges.select("a", "b", "d", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    maps, trees = [], []
    for level in levels:
        active, own = rest.df.where(F.col("d") <= level + _EPS), None
        label: DataFrame | None = None
        while not active.isEmpty():
            ends = active.select(F.col("ca").alias("c"), F.struct("d", "a", "b", F.col("cb").alias("o")).alias("e")).unionByName(active.select(F.col("cb").alias("c"), F.struct("d", "a", "b", F.col("ca").alias("o")).alias("e")))
            best = write_table(ends.groupBy("c").agg(F.min("e").alias("e")), "best").df
            trees.append(best.select("e.a", "e.b", "e.d").distinct())
            root = _roots(best).df.select("c", "p")
            if label is None:
                label = root
            else:
                up = root.select(F.col("c").alias("p"), F.col("p").alias("q"))
                label = write_table(label.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p")), "labels").df
            after, before = write_table(_moved(active, root), "edges"), own
            if before is not None:
                before.drop()
            own, active = after, after.df
        if label is not None and level != levels[-1]:
            before, rest = rest, write_table(_moved(rest.df.where(F.col("d") > level + _EPS), label), "edges")
            before.drop()
        maps.append(label)
    return maps, trees


def _moved(edges: DataFrame, root: DataFrame) -> DataFrame:
    """The edges between the components that ``root`` (``c, p``) leaves; what it doesn't name stays as it is."""
    to_a, to_b = root.select(F.col("c").alias("ca"), F.col("p").alias("na")), root.select(F.col("c").alias("cb"), F.col("p").alias("nb"))
    both = edges.join(to_a, "ca", "left").join(to_b, "cb", "left")
    return both.select("a", "b", "d", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb")).where("ca <> cb")


def select_clusters(classes: DataFrame, maps: list[DataFrame | None], levels: list[float]) -> DataFrame:
    """``class, cluster``: as :func:`_hierarchy`, by joins, for components of any size; ``classes`` has ``class, copies``."""
    lam = [1 / b for b in (*levels, FARTHEST)]
    at = classes.select("class", "copies", F.col("class").alias("c"))
    for i, m in enumerate(maps):
        if m is not None:
            up = m.select("c", F.col("p").alias("q"))
            at = at.join(up, "c", "left").withColumn("c", F.coalesce("q", "c")).drop("q")
        at = at.withColumn(f"c{i}", F.col("c"))
    at = write_table(at.drop("c"), "levels").df
    # Bottom-up: the components of each level, what their cluster (the chain) and its parts make.
    below: DataFrame | None = None
    per_level = []
    for i in range(len(levels)):
        step = lam[i] - lam[i + 1]
        size = at.groupBy(f"c{i}").agg(F.sum("copies").alias("n"))
        if below is None:
            node = size.select(F.col(f"c{i}").alias("c"), "n", F.lit(0).alias("k"), F.lit(0.0).alias("chain"), F.lit(0.0).alias("sub"))
        else:
            link = at.select(F.col(f"c{i - 1}").alias("c"), F.col(f"c{i}").alias("q")).distinct()
            kids = below.where("n >= 2").join(link, "c").groupBy("q").agg(
                F.count("*").alias("k"), F.sum("chain").alias("kid_chain"), F.sum("sub").alias("kid_sub"), F.sum(F.greatest("chain", "sub")).alias("kid_best"),
            )
            one = F.col("k") == 1
            node = size.join(kids, F.col(f"c{i}") == F.col("q"), "left").select(
                F.col(f"c{i}").alias("c"), "n", F.coalesce("k", F.lit(0)).alias("k"),
                F.when(one, F.col("kid_chain")).otherwise(0.0).alias("chain"), F.when(one, F.col("kid_sub")).otherwise(F.coalesce("kid_best", F.lit(0.0))).alias("sub"),
            )
        below = write_table(node.withColumn("chain", F.col("chain") + F.col("n") * step), "nodes").df
        per_level.append(below)
    # Top-down: a chain's upper end decides for the chain.
    out = at.withColumn("cluster", F.lit(None).cast("long")).withColumn("top", F.lit(True))
    for i in reversed(range(len(levels))):
        t = per_level[i].select(F.col("c").alias(f"c{i}"), "n", "k", "chain", "sub")
        chosen = F.col("cluster").isNull() & F.col("top") & (F.col("n") >= 2) & (F.col("chain") >= F.col("sub") - _EPS)
        mark = F.when(chosen, F.col(f"c{i}") * len(levels) + i).otherwise(F.col("cluster"))
        out = out.join(t, f"c{i}").withColumn("cluster", mark).withColumn("top", F.col("k") != 1).drop("n", "k", "chain", "sub")
    return out.select("class", "cluster")


def _giants(edges: DataFrame) -> DataFrame:
    """``class, cluster, d`` of components too large for a task: distributed rounds for the forest, joins for the hierarchy.

    Its distances are those that the forest has: for sets of up to n names at most about n * n / 5.
    """
    maps, trees = forest(edges, [TOGETHER, FARTHEST])
    every = trees[0]
    for t in trees[1:]:
        every = every.unionByName(t)
    every = write_table(every, "forest").df
    levels = [TOGETHER, *sorted({round(r.d, 9) for r in every.where(F.col("d") > TOGETHER + _EPS).select(F.round("d", 9).alias("d")).distinct().collect()})]
    if len(levels) > 1:
        maps, _ = forest(every, levels)
    ends = edges.select(F.col("a").alias("class"), F.col("na").alias("copies"), "d").unionByName(edges.select(F.col("b").alias("class"), F.col("nb").alias("copies"), "d"))
    classes = write_table(ends.groupBy("class").agg(F.first("copies").alias("copies"), F.min("d").alias("d")), "giant-classes").df
    picked = write_table(select_clusters(classes, maps[: len(levels)], levels), "giant-picked").df
    least = picked.where("cluster is not null").groupBy("cluster").agg(F.min("class").alias("least"))
    return picked.join(least, "cluster", "left").join(classes.select("class", "d"), "class").select("class", F.col("least").alias("cluster"), "d")


def solved(graph: DataFrame) -> DataFrame:
    """``class, cluster, d`` of every class in the graph ``a, b, d, na, nb``: its cluster, named by its least class (null for
    none), and the distance at which it leaves it."""
    spark = graph.sparkSession
    groups = write_table(components(graph.select(F.lit(0).cast("long").alias("seq_id"), F.col("a").alias("one"), F.col("b").alias("two"))).select(F.col("group").alias("comp"), F.col("node").alias("a")), "components").df
    giant = write_table(groups.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > GIANT).select("comp"), "giant").df
    placed = graph.join(groups, "a").select("comp", "a", "b", "d", "na", "nb")
    some = not giant.isEmpty()
    small = placed.join(giant, "comp", "left_anti") if some else placed
    out = small.repartition(partitions(spark), "comp").sortWithinPartitions("comp").mapInArrow(_solve, SOLVED)
    if some:
        out = out.unionByName(_giants(write_table(placed.join(giant, "comp", "left_semi").drop("comp"), "giant-edges").df))
    return out


def similar_groups(link_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problem 2: ``cluster_id, link_id`` and ``link_id, persistence``.

    ``link_names`` has distinct ``link_id, name``. ``cluster_id`` is the smallest link of the cluster. Links with fewer
    than three names and links alike to no other are in no cluster; no links, no rows. ``persistence`` is 1 / distance at
    which the link leaves its cluster, that of equal sets being without bound (null).
    """
    with tables() as kept:
        sets = name_sets(link_names)
        classes = write_table(sets.df.groupBy("names").agg(F.min("link_id").alias("class"), F.count("*").cast("int").alias("copies")).select("class", "names", "copies"), "classes")
        long = _long_lists(classes.df).df
        core = write_table(core_distances(classes.df, long), "core").df
        graph = write_table(neighbour_graph(classes.df.join(core, "class"), long), "graph").df
        picked = write_table(solved(graph), "solved")
        kept += [sets, classes, picked]
    member = sets.df.join(classes.df, "names").select("class", "copies", "link_id").join(picked.df, "class", "left")
    # Equal sets that resemble no others are a cluster of their own.
    cluster = F.coalesce("cluster", F.when(F.col("d").isNull() & (F.col("copies") >= 2), F.col("class")))
    found = member.select(cluster.alias("cluster_id"), "link_id").where("cluster_id is not null")
    return found, member.select("link_id", F.when(F.col("copies") == 1, 1 / F.col("d")).alias("persistence"))


def describe(found: DataFrame, persistence: DataFrame, types: DataFrame, typical: int = 3) -> DataFrame:
    """``cluster_id, size, typical_links, type_name, type_share``: each cluster's size, its most persistent links and, as
    evidence, the name that most of its links had before (the smaller on ties, null if none had one) with its share."""
    order = (F.desc_nulls_first("persistence"), "link_id")
    part = found.join(persistence, "link_id").withColumn("part", F.pmod(F.xxhash64("link_id"), F.lit(256)))
    for by in (("cluster_id", "part"), ("cluster_id",)):  # a huge cluster is ranked in parts first
        part = part.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= typical)
    best = part.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("r", "link_id"))).alias("t"))
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("size"))
    named = types.where("type_name is not null").select("link_id", "type_name").distinct()
    votes = found.join(named, "link_id").groupBy("cluster_id", "type_name").agg(F.count("*").alias("n"))
    most = votes.groupBy("cluster_id").agg(F.max("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "type_name")).alias("w"))
    return (
        sizes.join(best, "cluster_id").join(most, "cluster_id", "left")
        .select("cluster_id", "size", F.col("t.link_id").alias("typical_links"), F.col("w.type_name").alias("type_name"), (F.col("n") / F.col("size")).alias("type_share"))
    )
