"""Problem 2 against brute force: neighbours, core distances, forest, hierarchy, clusters."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqweave.llm import clusters
from seqweave.session import write_table


def jaccard(a, b):
    return len(a & b) / len(a | b)


def parts(nodes, edges):
    """The components of nodes under edges."""
    p = {v: v for v in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        p[find(a)] = find(b)
    out = {}
    for v in nodes:
        out.setdefault(find(v), set()).add(v)
    return list(out.values())


def planted(rnd, n=12, size=9):
    sets, of = {}, {}
    k = 0
    for c in range(n):
        base = [f"N{c}_{j}" for j in range(8)]
        for _ in range(rnd.choice([2, size])):
            s = set(rnd.sample(base, rnd.randint(6, 8))) | ({f"X_{rnd.randint(0, 400)}"} if rnd.random() < 0.4 else set())
            sets[k], of[k] = s, c
            k += 1
    for _ in range(15):
        sets[k] = {f"Y_{rnd.randint(0, 10**6)}" for _ in range(6)}
        k += 1
    sets[k], sets[k + 1] = {"Q_1", "Q_2"}, {"Q_1", "Q_2"}
    return sets, of


def names_df(spark, sets):
    return spark.createDataFrame([(k, n) for k, s in sets.items() for n in sorted(s)], "link_id long, name string")


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster_id, set()).add(r.link_id)
    return out


def test_clusters(spark):
    sets, of = planted(random.Random(7))
    for i in (900, 901):  # copies that resemble nothing else are a cluster, a single one isn't
        sets[i], of[i] = {"Z_1", "Z_2", "Z_3"}, "copies"
    df = names_df(spark, sets).withColumn("n", F.lit(0))
    found, persistence = clusters.similar_groups(df.select("link_id", "name"))
    got = grouped(found.collect())
    want = {}
    for i, c in of.items():
        want.setdefault(c, set()).add(i)
    assert set(map(frozenset, got.values())) == set(map(frozenset, want.values()))
    assert all(c == min(m) for c, m in got.items())
    kinds = spark.createDataFrame([(i, f"t{c}") for i, c in of.items()] + [(0, None)], "link_id long, type_name string")
    told = clusters.describe(found, persistence, kinds).collect()
    assert {r.cluster_id: r["size"] for r in told} == {c: len(m) for c, m in got.items()}
    assert all(r.type_share == 1.0 and set(r.typical_links) <= got[r.cluster_id] for r in told)
    nothing, _ = clusters.similar_groups(df.select("link_id", "name").where("false"))
    assert nothing.count() == 0


def test_most_persistent_members_are_typical(spark):
    sets = {1: set("abcdefgh"), 2: set("abcdefgx"), 3: set("abcdefgy"), 4: set("abcdefgz"), 5: set("abcdemno"), 6: set("abcdefgh")}
    found, persistence = clusters.similar_groups(names_df(spark, sets))
    assert grouped(found.collect()) == {1: {1, 2, 3, 4, 5, 6}}
    told = {r.link_id: r.persistence for r in persistence.collect()}
    assert told[1] is told[6] is None and told[5] == min(v for v in told.values() if v)
    assert clusters.describe(found, persistence, spark.createDataFrame([], "link_id long, type_name string")).first().typical_links == [1, 6, 2]


def random_classes(rnd, n=260, popular=9):
    """Groups of five sets that share two own numbers, six popular ones and a rare one each."""
    rows = []
    for c in range(n // 5):
        own = [1000 + 2 * c, 1001 + 2 * c]
        shared = rnd.sample(range(5000, 5000 + popular), 6)
        for _ in range(5):
            rows.append((len(rows), sorted({len(rows), *own, *shared}), rnd.choice([1, 1, 1, 2, 5])))
    return rows


def brute_cores(rows, k):
    out = {}
    for c, names, copies in rows:
        near = sorted([0.0] * (copies - 1) + [d for o, other, m in rows if o != c and (d := 1 - jaccard(set(names), set(other))) < clusters.FARTHEST - 1e-9 for _ in range(m)])
        if any(o != c and 1 - jaccard(set(names), set(other)) < clusters.FARTHEST - 1e-9 for o, other, _ in rows):
            out[c] = near[min(k, len(near)) - 1]
    return out


@pytest.mark.parametrize("block", [1024, 40])
def test_graph_is_whole(spark, monkeypatch, block):
    """Core distances are those of all neighbours, and at each distance the graph has the components of the whole
    mutual-reachability graph, whether a popular name's list stays together or falls into blocks."""
    monkeypatch.setattr(clusters, "BLOCK", block)
    rows = random_classes(random.Random(11))
    df = write_table(spark.createDataFrame(rows, "class long, names array<long>, copies int"), "classes").df
    long = clusters._long_lists(df).df
    assert long.isEmpty() == (block == 1024)
    core = clusters.core_distances(df, long)
    want = brute_cores(rows, clusters.NEIGHBOURS)
    got = {r["class"]: r.core for r in core.collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    edges = [(r.a, r.b, r.d) for r in clusters.neighbour_graph(df.join(core, "class"), long).collect()]
    of = {c: set(n) for c, n, _ in rows}
    whole = [(a, b, max(d, want[a], want[b])) for a, b in combinations(of, 2) if (d := 1 - jaccard(of[a], of[b])) < clusters.FARTHEST - 1e-9]
    for far in sorted({round(d, 9) for *_, d in whole}):
        a, b = ([e[:2] for e in es if e[2] <= far + 1e-9] for es in (edges, whole))
        assert set(map(frozenset, parts(of, a))) == set(map(frozenset, parts(of, b)))


def test_no_neighbour_is_lost_on_a_list_of_ten_thousand(spark):
    """Every set has the same name first; twins, which share three others of four, stand anywhere in its list."""
    n = 10_000
    rows = [(i, [0, *(10 + 3 * (i % (n // 2)) + j for j in range(3)), 10**6 + i], 1) for i in range(n)]
    df = write_table(spark.createDataFrame(rows, "class long, names array<long>, copies int"), "classes").df
    long = clusters._long_lists(df).df
    assert [tuple(r) for r in long.collect()] == [(0, 10)]
    core = clusters.core_distances(df, long)
    edges = clusters.neighbour_graph(df.join(core, "class"), long).collect()
    assert sorted((r.a, r.b) for r in edges) == [(i, i + n // 2) for i in range(n // 2)] and all(abs(r.d - 1 / 3) < 1e-9 for r in edges)


def test_shared_elements_of_sets_of_any_size():
    rnd = random.Random(3)
    lists = [sorted(rnd.sample(range(400), rnd.choice([1, 3, 8, 9, 20, 64, 65, 200]))) for _ in range(120)] + [[]]
    sets = clusters._Sets(pa.array([[7], *lists], pa.list_(pa.int64()))[1:])
    i, j = (np.array(x) for x in zip(*combinations(range(len(lists)), 2)))
    n, first = sets.shared(i, j)
    for a, b, k, f in zip(i, j, n, first):
        both = set(lists[a]) & set(lists[b])
        assert k == len(both) and f == min(both, default=-1)


def random_graph(rnd, n=70, m=110, levels=(0.2, 0.5, 0.52, 0.55, 0.58, 0.6, 0.64)):
    copies = [rnd.choice([1, 1, 1, 2, 4]) for _ in range(n)]
    edges = {tuple(sorted(rnd.sample(range(n), 2))): rnd.choice(levels) for _ in range(m)}
    return copies, [(a, b, d, copies[a], copies[b]) for (a, b), d in edges.items()]


def best_clusters(nodes, edges, copies):
    """Top-down by the definition: the sets of nodes of the most stable clusters."""

    def walk(own, born):
        left, kids = 0.0, []
        now = set(own)
        while now:
            inside = [e for e in edges if e[0] in now and e[1] in now]
            top = max((d for _, _, d, *_ in inside), default=0)
            if top <= clusters.TOGETHER:
                left += sum(copies[v] for v in now) / clusters.TOGETHER
                break
            pieces = parts(now, [e[:2] for e in inside if e[2] < top])
            if len(pieces) == 1:
                edges[:] = [e for e in edges if not (e in inside and e[2] == top)]
                continue
            large = [p for p in pieces if sum(copies[v] for v in p) >= 2]
            if len(large) == 1:
                left += sum(copies[v] for v in now - large[0]) / top
                now = large[0]
                continue
            left += sum(copies[v] for v in now) / top
            kids = [walk(p, top) for p in large]
            break
        own_value = left - sum(copies[v] for v in own) / born
        best = sum(v for v, _ in kids)
        return (own_value, [frozenset(own)]) if own_value >= best - 1e-9 else (best, [c for _, cs in kids for c in cs])

    out = set()
    for comp in parts(nodes, [e[:2] for e in edges]):
        if sum(copies[v] for v in comp) >= 2:
            out |= set(walk(comp, clusters.FARTHEST)[1])
    return out


def clusters_of(rows):
    out = {}
    for r in rows:
        if r.cluster is not None:
            out.setdefault(r.cluster, set()).add(r["class"])
    assert all(c == min(m) for c, m in out.items())
    return set(map(frozenset, out.values()))


@pytest.mark.parametrize("seed, giant", [(1, 100_000), (1, 0), (2, 25)])
def test_hierarchy(spark, monkeypatch, seed, giant):
    """Components solved by a task, and those spread over all tasks, have the clusters that the definition gives."""
    monkeypatch.setattr(clusters, "GIANT", giant)
    copies, edges = random_graph(random.Random(seed))
    df = write_table(spark.createDataFrame(edges, clusters.GRAPH), "graph").df
    rows = clusters.solved(df).collect()
    nodes = {v for e in edges for v in e[:2]}
    assert sorted(r["class"] for r in rows) == sorted(nodes)
    assert clusters_of(rows) == best_clusters(nodes, list(edges), copies)
    assert all(abs(r.d - min(e[2] for e in edges if r["class"] in e[:2])) < 1e-9 for r in rows)


def test_local_hierarchy_on_many_graphs():
    for seed in range(10, 60):
        copies, edges = random_graph(random.Random(seed), 40, 55)
        batch = pa.RecordBatch.from_arrays([pa.array([0] * len(edges)), *(pa.array(c, t) for c, t in zip(zip(*edges), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())))], names=["comp", "a", "b", "d", "na", "nb"])
        t = clusters._solved([batch])
        out = {}
        for v, c, _ in zip(*(x.to_pylist() for x in t.columns)):
            if c is not None:
                out.setdefault(c, set()).add(v)
        nodes = {v for e in edges for v in e[:2]}
        assert set(map(frozenset, out.values())) == best_clusters(nodes, list(edges), copies), seed


def test_local_forest_is_minimal():
    rnd = random.Random(9)
    edges = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(300)})
    d = [rnd.choice([0.1, 0.3, 0.5, 0.52, 0.58, 0.65]) for _ in edges]
    p, total = list(range(60)), []

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for w, a, b in sorted((w, *e) for e, w in zip(edges, d)):
        if find(a) != find(b):
            p[find(a)] = find(b)
            total.append(w)
    keep = clusters.local_forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), np.array(d))
    assert sorted(d[i] for i in keep) == sorted(total)
