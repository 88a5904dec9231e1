import os

import pytest
from pyspark.sql import functions as F

from seqweave.functions.naming import event_name, source_name
from seqweave.operators import links, model, rewrite, sequence, similarity, thresholds, types
from seqweave.plans import pipeline
from seqweave.schema import LINK_TYPES, LINKSET, SEQUENCE, TYPE_FORMS, Params
from seqweave.sources import text


def seq_of(spark, tokens, seq_id=0):
    return spark.createDataFrame([(seq_id, i, t) for i, t in enumerate(tokens)], SEQUENCE)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def members_of(spark, *groups):
    return spark.createDataFrame([(0, i, p) for i, g in enumerate(groups) for p in g], LINKSET)


def test_names(spark):
    given = ["ADY_11", " ady-011;", "Ady/11=on", "ADY__11 #16", "ady 11(3)", "ADY11=22.5", "\tady.0", "A_00", "", "  ", None, "77", "ABC"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", event_name(F.col("t")).alias("n"))
    assert [r.n for r in got.orderBy("i").collect()] == ["ADY_11"] * 6 + ["ADY_0", "A_0"] + [None] * 5
    s = spark.createDataFrame([(" Tech-Report",), ("tech_report",), ("lecture notes ",), (" ",), (None,)], "s string").select(source_name(F.col("s")))
    assert [r[0] for r in s.collect()] == ["tech_report", "tech_report", "lecture_notes", None, None]


def test_token_sequence_of_one_long_sequence_and_dirty_rows(spark):
    data = [(1, (i * 7919) % 5000, f"t{i % 3}") for i in range(5000)] + [(2, 1, "x"), (2, 1, None), (None, 1, "x")]
    df = spark.createDataFrame(data, "s long, o long, t string").withColumn("pos", F.lit("clash")).withColumn("chunk", F.lit(1))
    got = sequence.token_sequence(df, "s", ["o"], "t")
    one = {r.pos: r.token for r in got.where("seq_id = 1").collect()}
    assert one == {o: t for _, o, t in data[:5000]}
    assert rows(got.where("seq_id = 2")) == [(2, 0, "x")]
    assert sequence.token_sequence(df.where("false"), "s", ["o"], "t").count() == 0


def test_pairs_and_windows_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(sequence.blocked, "__defaults__", (0, 4))
    tokens = [f"t{i}" for i in range(11)]
    s = seq_of(spark, tokens).withColumn("block", F.lit("clash"))
    got = rows(sequence.lookahead_pairs(s, 5), "k", "one", "two", "ctx", "nxt")
    assert got == sorted((k, i, i + k, tokens[i], tokens[i + k]) for k in range(1, 6) for i in range(11 - k))
    ids = s.select("seq_id", "pos", F.col("pos").alias("token_id"))
    win = {r.pos: (r.win, r.label) for r in sequence.sliding_windows(ids, 6, 2).collect()}
    assert win == {i: (list(range(i - 5, i + 1)), i + 2) for i in range(5, 9)}


def test_vocabulary_batches_epochs(spark):
    s = seq_of(spark, list("banana"))
    v = sequence.vocabulary(s)
    assert rows(v) == [("a", 0), ("b", 1), ("n", 2)]
    assert rows(sequence.numberify(s, v), "pos", "token_id") == list(enumerate([1, 0, 2, 0, 2, 0]))
    assert sequence.unknown_tokens(seq_of(spark, ["z", "a"]), v) == 1
    assert rows(sequence.batch_layout(s, 3)) == [(0, 2, 3)] and rows(sequence.batch_layout(s, 4)) == [(0, 2, 2)]
    assert spark.range(1).select(sequence.one_hot(F.lit(1), 3)).first()[0] == [0, 1, 0]
    assert sequence.estimate_epochs(10, seq_of(spark, "ab"), seq_of(spark, "abc")) == 15
    assert sequence.estimate_epochs(10, seq_of(spark, "a"), seq_of(spark, "abc"), 2.0, 12) == 12
    assert sequence.estimate_epochs(10, s.where("false"), s) == 10


def test_model_probabilities_and_deltas(spark, tmp_path):
    s = seq_of(spark, list("abac"))
    m = model.MarkovEstimator(2).fit(s)
    p = {(r.k, r.ctx, r.nxt): r.p for r in m.prob.collect()}
    assert p == {(1, "a", "b"): 0.5, (1, "a", "c"): 0.5, (1, "b", "a"): 1.0, (2, "a", "a"): 1.0, (2, "b", "c"): 1.0}
    m.save(str(tmp_path / "m"))
    assert rows(model.MarkovModel.load(spark, str(tmp_path / "m")).prob) == rows(m.prob)
    assert m.transform(s).where("pos = 0").count() == 3
    wide = model.probability_rows(m.prob, sequence.vocabulary(s))
    d = {(r.pos, r.k, r.token_id): r.delta for r in model.probability_deltas(s, wide).collect()}
    assert d[0, 1, 1] == 0.5 and d[1, 1, 1] == -0.5 and d[1, 1, 0] == 1.0
    assert rows(model.matrix_shape(s, wide)) == [(1, 3, 3), (2, 3, 3)]
    assert rows(model.probability_column(m.prob, "b")) == [(1, "a", 0.5, 2)]
    some = model.sampled(spark.range(10000), 0.2, keys=["id"])
    assert 1800 < some.count() < 2200 and rows(some) == rows(model.sampled(spark.range(10000), 0.2, keys=["id"]))


def test_two_means_is_the_best_cut(spark):
    import itertools
    import random

    rnd = random.Random(3)
    cols = {f"c{j}": [round(rnd.random(), 3) for _ in range(rnd.randint(2, 8))] for j in range(30)} | {"same": [0.4, 0.4]}
    got = {r.token: r.threshold for r in thresholds.two_means_thresholds(spark.createDataFrame([(c, p, 1) for c, ps in cols.items() for p in ps], "token string, p double, w long")).collect()}
    assert got["same"] == pytest.approx(0.4)

    def loss(parts):
        return sum(sum((x - sum(p) / len(p)) ** 2 for x in p) for p in parts)

    for c, ps in cols.items():
        if len(set(ps)) > 1:
            best = min((loss((a, b)), (sum(a) / len(a) + sum(b) / len(b)) / 2) for r in range(1, len(ps)) for ix in itertools.combinations(range(len(ps)), r) for a in [[ps[i] for i in ix]] for b in [[x for i, x in enumerate(ps) if i not in ix]])
            assert got[c] == pytest.approx(best[1]) or loss_close(ps, got[c], best[0], loss)
    assert rows(spark.createDataFrame([(1.0,), (30.0,), (99.0,)], "x double").select(thresholds.nearest(F.col("x"), [10.0, 50.0]))) == [(0,), (0,), (1,)]
    with pytest.raises(ValueError):
        thresholds.k_means_centres(None, 1)
    values = spark.createDataFrame([("a", float(x), 1) for x in (0, 1, 2, 10, 11, 12, 50)] + [("b", 3.0, 2), ("b", 5.0, 1), ("c", 7.0, 9)], "token string, p double, w long")
    assert {r.token: r.centres for r in thresholds.k_means_centres(values, 3).collect()} == {"a": [1.0, 11.0, 50.0], "b": [3.0, 5.0], "c": [7.0]}
    assert {r.token: r.threshold for r in thresholds.k_means_thresholds(values, 3).collect()} == {"a": 30.5, "b": 4.0, "c": 7.0}
    assert thresholds.k_means_thresholds(values.where("false"), 3).count() == 0


def test_thresholds_of_a_sample_are_those_of_the_whole(spark):
    """Whole rows are drawn, so cells that weren't drawn don't count as zeros."""
    import random

    rnd = random.Random(4)
    tokens = [f"t{rnd.choices(range(8), range(1, 9))[0]}" for _ in range(4000)]
    s = seq_of(spark, tokens)
    whole, half = ({r.token: r.threshold for r in pipeline.find_edges(s, Params(lookahead=2, sample=x)).thresholds.collect()} for x in (None, 0.5))
    assert whole.keys() == half.keys() and all(abs(whole[t] - half[t]) < 0.02 for t in whole)


def test_sparse_deltas_are_the_dense_ones(spark):
    s = seq_of(spark, list("abcabdacbbdaecab"))
    prob = model.next_event_prob(sequence.lookahead_pairs(s, 3))
    vocab = sequence.vocabulary(s)
    dense = {(r.pos, r.k, r.token): r.delta for r in model.probability_deltas(s, model.probability_rows(prob, vocab)).join(vocab, "token_id").collect()}
    sparse = {(r.pos, r.k, r.token): r.delta for r in model.sparse_deltas(s, prob).collect()}
    assert sparse.keys() <= dense.keys() and len(sparse) < len(dense)
    assert all(v == pytest.approx(sparse.get(c, 0.0)) for c, v in dense.items())


def loss_close(ps, threshold, best, loss):
    a, b = [x for x in ps if x < threshold], [x for x in ps if x >= threshold]
    return a and b and loss((a, b)) == pytest.approx(best)


def sequential_groups(edges):
    groups = []
    for k, one, two in sorted(edges):
        a = next((g for g in groups if one in g), None)
        b = next((g for g in groups if two in g), None)
        if a is None and b is None:
            groups.append({one, two})
        elif b is None:
            a.add(two)
        elif a is None:
            b.add(one)
    return {frozenset(g) for g in groups}


def test_groups_as_edges_arrive(spark):
    import random

    rnd = random.Random(1)
    all_, expected, merged = [], {}, {}
    for s in range(12):
        es = {(k, i, i + k) for k in (1, 2, 3) for i in range(40) if rnd.random() < 0.25}
        all_ += [(s, *e) for e in es]
        expected[s] = sequential_groups(es)
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for _, a, b in es:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        g = {}
        for v in list(parent):
            g.setdefault(find(v), set()).add(v)
        merged[s] = {frozenset(x) for x in g.values()}
    edges = spark.createDataFrame(all_ + all_[:5] + [(1, 1, None, 3), (1, 0, 7, 7), (2, None, 4, None)], "seq_id long, k int, one long, two long")
    for got, want in ((links.link_groups(edges), expected), (links.link_groups_merged(edges), merged)):
        found = {}
        for r in got.collect():
            found.setdefault((r.seq_id, r.link_id), set()).add(r.pos)
        assert {s: {frozenset(g) for (q, _), g in found.items() if q == s} for s in range(12)} == want
        assert all(i == min(g) for (_, i), g in found.items())
    assert links.link_groups(edges.where("false")).count() == 0 and links.link_groups_merged(edges.where("false")).count() == 0


def test_groups_over_chunk_borders(spark):
    """Long chains fall into the chunks of all tasks, which are joined by rounds over their centres."""
    import random

    rnd = random.Random(2)
    names = {s: rnd.sample(range(10_000), 900) for s in (1, 2)}
    pairs = [(s, a, b) for s, ns in names.items() for chain in (ns[:600], ns[600:]) for a, b in zip(chain, chain[1:])]
    rnd.shuffle(pairs)
    got = links.link_groups_merged(spark.createDataFrame([(s, 1, a, b) for s, a, b in pairs], "seq_id long, k int, one long, two long"))
    assert rows(got) == sorted((s, min(chain), v) for s, ns in names.items() for chain in (ns[:600], ns[600:]) for v in chain)


def test_groups_of_the_documented_case(spark):
    edges = spark.createDataFrame([(0, 1, 0, 1), (0, 1, 4, 5), (0, 4, 1, 5)], "seq_id long, k int, one long, two long")
    assert rows(links.link_groups(edges), "link_id", "pos") == [(0, 0), (0, 1), (4, 4), (4, 5)]
    assert rows(links.link_groups_merged(edges), "link_id", "pos") == [(0, 0), (0, 1), (0, 4), (0, 5)]


def test_similarity(spark):
    sim = lambda a, b, i=False: spark.range(1).select(similarity.bag_similarity(F.lit(a), F.lit(b), i)).first()[0]
    assert sim(["A"] * 3, ["A"]) == pytest.approx(1 / 3)
    assert sim(["A"] * 3, ["A"], True) == 1.0
    assert sim(["A"], ["B"]) == 0.0
    empty = spark.range(1).select(similarity.bag_similarity(F.array().cast("array<string>"), F.array(F.lit("A")))).first()[0]
    assert empty == 0.0


def contents_of(spark, *bags):
    return spark.createDataFrame([(i, list(b)) for i, b in enumerate(bags)], "link_id long, tokens array<string>")


def test_similar_bags_are_all_found(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    bags = [[rnd.choice("ABCDEFGH") for _ in range(rnd.randint(1, 7))] for _ in range(80)]
    own = similarity.bags(contents_of(spark, *bags))

    def measure(a, b):
        return min(sum(x in a for x in b) / len(a), sum(x in b for x in a) / len(b))

    kept = {r.bag_id: r.tokens for r in own.collect()}
    for t in (0.4, 0.6, 0.9):
        monkeypatch.setattr(similarity, "MEETINGS", 4_000_000 if t == 0.4 else 50)
        got = {(r.one, r.two) for r in similarity.similar_bags(own, t).collect()}
        assert got == {(i, j) for i in kept for j in kept if i < j and measure(kept[i], kept[j]) >= t}


@pytest.mark.parametrize("local", [1_000_000, 40, 0])
def test_clusters_are_cliques_that_cannot_be_combined(spark, monkeypatch, local):
    import random

    monkeypatch.setattr(types, "LOCAL_PAIRS", local)

    rnd = random.Random(6)
    bags = [[rnd.choice("ABCDEF") for _ in range(rnd.randint(1, 6))] for _ in range(60)] + [[]]
    got = {r.link_id: r.cluster_id for r in types.cluster_links(contents_of(spark, *bags), 0.6).collect()}
    assert 60 not in got and len(got) == 60

    def ok(a, b):
        return sorted(a) == sorted(b) or min(sum(x in a for x in b) / len(a), sum(x in b for x in a) / len(b)) >= 0.6

    clusters = {}
    for i, c in got.items():
        clusters.setdefault(c, []).append(i)
    for c, m in clusters.items():
        assert min(m) == c and all(ok(bags[i], bags[j]) for i in m for j in m)
    names = sorted(clusters)
    for x in names:
        for y in names:
            if x < y:
                assert not all(ok(bags[i], bags[j]) for i in clusters[x] for j in clusters[y])
    SEEN.add(tuple(sorted(got.items())))
    assert len(SEEN) == 1  # the same by one task, distributed rounds, or both


SEEN = set()


def test_types(spark):
    contents = contents_of(spark, ["A", "B"], ["A", "C"], ["A", "B", "B"], ["D"])
    named = spark.createDataFrame([(0, "7"), (1, "7"), (2, "7"), (2, "7"), (3, "2"), (9, "5"), (8, None)], "link_id long, type_name string")
    forms = types.canonical_forms(contents, named, 0.6)
    assert {r.type_name: r.tokens for r in forms.collect()} == {"7": ["A", "B"], "2": ["D"], "5": []}
    previous = spark.createDataFrame([(1, "new_event_1", ["A", "B"]), (2, "new_event_3", ["B", "A"]), (3, "new_event_4", []), (4, "new_event_5", None)], "ord int, type_name string, tokens array<string>")
    m = types.match_previous(forms, previous, 0.6)
    assert rows(m) == [("7", "new_event_3")]
    assert rows(types.renamed_by_match(named, m).where("link_id = 0")) == [(0, "new_event_3")]
    assert {r.type_name for r in types.forms_after_match(forms, m).collect()} == {"new_event_3", "2", "5"}
    data = seq_of(spark, ["x", "new_event_4", "new_event_x"])
    assert types.newest_event(data) == 5 and types.newest_event(seq_of(spark, ["x"])) == 0
    names = types.new_names(named, 5)
    assert rows(names) == [("2", "new_event_5"), ("5", "new_event_6"), ("7", "new_event_7")]
    assert rows(types.rename_types(named, names).where("link_id = 3")) == [(3, "new_event_5")]


def test_rewriting(spark):
    s = seq_of(spark, list("ABCDEF"))
    members = members_of(spark, [1, 2, 3])
    kinds = spark.createDataFrame([(0, 0, "new_event_3"), (0, 5, None)], LINK_TYPES)
    assert [r.token for r in rewrite.update_dataset(s, members, kinds).orderBy("pos").collect()] == ["A", "new_event_3", "new_event_3", "new_event_3", "E", "F"]
    assert [r.token for r in rewrite.compress_sequence(s, members, kinds).orderBy("pos").collect()] == ["A", "new_event_3", "E", "F"]
    at = rewrite.anchors(members_of(spark, [0, 1, 5], [10, 14, 15], [20, 25]))
    assert rows(at, "link_id", "anchor") == [(0, 0), (1, 15), (2, 20)]
    n = {r.split: r["count"] for r in rewrite.split_sequence(seq_of(spark, ["x"] * 45)).groupBy("split").count().collect()}
    assert n == {"train": 32, "valid": 9, "test": 4}
    held = rewrite.holdout_split(seq_of(spark, ["x"] * 40), 0.25).where("held_out").select("pos").collect()
    at = sorted(r.pos for r in held)
    assert len(at) == 10 and at == list(range(at[0], at[0] + 10))
    assert rows(links.link_span(members)) == [(0, 0, 1, 3, 2.0, 3)]


def test_layers(spark, tmp_path):
    # Planted activities: runs of A, B and C events, interleaved.
    tokens = []
    for i in range(60):
        tokens += [["A_0", "A_1", "A_2"], ["B_0", "B_1"], ["C_0", "C_1", "C_2"]][(i * 7) % 3 if i % 5 else (i * 3) % 3]
    s = seq_of(spark, tokens)
    layers = pipeline.run_layers(s, 2, Params(lookahead=3), str(tmp_path / "out"))
    first = layers[0]
    sizes = first.linkset.groupBy("link_id").count()
    removed = sum(r["count"] - 1 for r in sizes.collect())
    assert first.compressed.count() == len(tokens) - removed
    assert first.linkset.count() == first.linkset.select("seq_id", "pos").distinct().count()
    assert first.uncompressed.count() == len(tokens)
    assert first.link_types.where("type_name not like 'new_event_%'").count() == 0
    assert os.path.isdir(tmp_path / "out/layer=1/compressed/split=train")
    found = pipeline.find_edges(s, Params(lookahead=2, score_source="delta"))
    assert found.edges.count() > 0 and found.deltas.count() > 0
    again = pipeline.find_edges(s, Params(lookahead=2, do_train=False, do_deltify=True), stored=found.prob)
    plain = pipeline.find_edges(s, Params(lookahead=2))
    assert rows(again.edges) == rows(plain.edges) and again.deltas.count() == found.deltas.count() and plain.deltas is None
    with pytest.raises(ValueError):
        pipeline.find_edges(s, Params(do_train=False))
    pipeline.run_layer(s, None, Params(lookahead=2, do_deltify=True, k_means=3)).save(str(tmp_path / "deltas"), Params())
    assert os.path.isdir(tmp_path / "deltas/deltas/k=2")


def test_nothing_is_left_in_the_shared_folder(spark):
    from seqweave import session

    session.sweep()
    before = set(os.listdir(session.shared_dir(spark)))
    with session.tables():
        layer = pipeline.run_layer(seq_of(spark, list("abcabcabdabc")), None, Params(lookahead=2))
        assert layer.compressed.count() > 0
    assert set(os.listdir(session.shared_dir(spark))) == before


def test_links_are_numbered_over_all_sequences(spark):
    g = spark.createDataFrame([(1, 5, 5), (1, 5, 7), (2_000_000_000_000, 1, 1), (2_000_000_000_000, 1, 9), (1, 0, 0)], LINKSET)
    assert rows(links.numbered_links(g)) == [(1, 0, 0), (1, 1, 5), (1, 1, 7), (2_000_000_000_000, 2, 1), (2_000_000_000_000, 2, 9)]


def test_text_formats(spark, tmp_path):
    d = str(tmp_path)
    for name, body in {"train": "B_0 C_0\nB_1  C_1\n", "valid": "C_2 A_3", "test": "A_0 A_1 A_2\n"}.items():
        (tmp_path / f"ptb.{name}.txt").write_text(body)
    s = text.read_sequence(spark, d)
    assert [r.token for r in s.orderBy("pos").collect()] == "B_0 C_0 B_1 C_1 C_2 A_3 A_0 A_1 A_2".split()
    text.write_splits(rewrite.split_sequence(s), d + "/out")
    assert rows(text.read_sequence(spark, d + "/out"), "pos", "token") == rows(s, "pos", "token")
    v = sequence.vocabulary(s)
    text.write_vocabulary(v, d + "/vocab")
    assert rows(text.read_vocabulary(spark, d + "/vocab")) == rows(v)
    assert (tmp_path / "vocab").read_text().split("\n") == ["A_0 A_1 A_2 A_3 B_0 B_1 C_0 C_1 C_2 "]  # one line of one file
    text.write_vocabulary(v, d + "/vocab-parts", one_file=False)
    assert os.path.isdir(tmp_path / "vocab-parts") and rows(text.read_vocabulary(spark, d + "/vocab-parts")) == rows(v)
    (tmp_path / "links").write_text("0 1 5\n\n2 3\n")
    l = text.read_linkset(spark, d + "/links")
    assert rows(l, "link_id", "pos") == [(0, 0), (0, 1), (0, 5), (1, 2), (1, 3)]
    text.write_linkset(l, d + "/links2")
    assert rows(text.read_linkset(spark, d + "/links2")) == rows(l)
    (tmp_path / "types").write_text("new_event_0 \nnew_event_1\n")
    t = text.read_link_types(spark, d + "/types")
    assert rows(t, "link_id", "type_name") == [(0, "new_event_0"), (1, "new_event_1")]
    text.write_link_types(t, d + "/types2")
    assert rows(text.read_link_types(spark, d + "/types2")) == rows(t)
    (tmp_path / "forms").write_text("a: x y \n\nb: \n")
    f = text.read_type_forms(spark, d + "/forms")
    assert rows(f) == [("a", ["x", "y"]), ("b", [])]
    text.write_type_forms(f, d + "/forms2")
    assert rows(text.read_type_forms(spark, d + "/forms2")) == rows(f)
    (tmp_path / "bad").write_text("a: x: y\n")
    with pytest.raises(Exception, match="not a type form"):
        text.read_type_forms(spark, d + "/bad").collect()
    (tmp_path / "thr").write_text("0.5 0.25")
    assert rows(text.read_thresholds(spark, d + "/thr")) == [(0, 0.5), (1, 0.25)]
    (tmp_path / "m").write_text("0.5 0.5\n1.0 0.0\n")
    m = text.read_matrix(spark, d + "/m", 2)
    assert rows(m) == [(2, 0, [0.5, 0.5]), (2, 1, [1.0, 0.0])]
    text.write_matrix(m, d + "/m2")
    assert rows(text.read_matrix(spark, d + "/m2", 2)) == rows(m)
    assert spark.createDataFrame([], TYPE_FORMS).count() == 0


def test_network_learns_a_cycle(spark, tmp_path):
    from seqweave.operators import network

    s = seq_of(spark, list("abcd") * 30)
    vocab = sequence.vocabulary(s)
    net = network.NetworkEstimator(2, 3, embedding=10, epochs="auto", rate=0.03).fit(s, vocab)
    scored = network.scores(net.transform(s, vocab), vocab)
    best = {(r.pos, r.k): r.t for r in scored.groupBy("pos", "k").agg(F.max_by("token", "p").alias("t")).collect()}
    assert len(best) == 2 * 118
    right = sum(t == "abcd"[(pos + k) % 4] for (pos, k), t in best.items())
    assert right / len(best) >= 0.8
    total = scored.groupBy("pos", "k").agg(F.sum("p").alias("p")).agg(F.min("p"), F.max("p")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    net.save(spark, str(tmp_path / "net"))
    again = network.NetworkModel.load(spark, str(tmp_path / "net"), 3, 4)
    assert again.transform(s, vocab).select("pos", "k", F.transform("p", lambda x: F.round(x, 5))).exceptAll(net.transform(s, vocab).select("pos", "k", F.transform("p", lambda x: F.round(x, 5)))).count() == 0
    assert sorted(network.NetworkModel.load(spark, str(tmp_path / "net"), 3, 4, [2]).nets) == [2]
    assert network.NetworkEstimator(1, 200).fit(s, vocab).transform(s, vocab).count() == 0
    with pytest.raises(ValueError):
        network.Lstm(10**6, 100, [20])
    assert network.hidden_layers(120, 2) == [24, 24] and network.hidden_layers(50, 1) == [20]
    assert network.stop([0.1, 0.85]) and network.stop([0.5, 0.5, 0.5]) and not network.stop([0.5, 0.6, 0.5])
    found = pipeline.find_edges(s, Params(lookahead=2, window=3, estimator="network", network_layers=2, epochs=4))
    edges, thr = found.edges, found.thresholds
    assert thr.count() == 4 and edges.where("two - one = k").count() == edges.count() > 0


def test_gradient_of_the_network():
    import numpy as np

    from seqweave.operators.network import Lstm

    rnd = np.random.default_rng(0)
    net, windows, labels = Lstm(5, 7, [4, 3]), rnd.integers(0, 5, (6, 4)), rnd.integers(0, 5, 6)
    g = net.gradient(windows, labels)

    def loss():
        return -np.log(net.forward(windows)[np.arange(6), labels]).mean()

    for i in rnd.choice(len(g), 60, replace=False):
        at = net.weights[i]
        net.weights[i] = at + 1e-6
        up = loss()
        net.weights[i] = at - 1e-6
        assert (up - loss()) / 2e-6 == pytest.approx(g[i], abs=1e-6)
        net.weights[i] = at


def test_preloaded_matrices(spark, tmp_path):
    from seqweave.operators import network

    spark.range(6).select((F.col("id") % 2 + 1).cast("int").alias("k"), "id").write.parquet(str(tmp_path / "m"))
    held = network.Preloaded(spark)
    a = held.matrix(str(tmp_path / "m"), 1)
    assert a is held.matrix(str(tmp_path / "m"), 1) and a.count() == 3
    held.unload()
    assert a is not held.matrix(str(tmp_path / "m"), 1)
    held.unload()


def test_thresholds_as_text(spark, tmp_path):
    t = spark.createDataFrame([(0, 0.5), (1, 0.25)], "token_id long, threshold double")
    text.write_thresholds(t, str(tmp_path / "t"))
    assert rows(text.read_thresholds(spark, str(tmp_path / "t"))) == rows(t)


def test_concatenation_per_sequence(spark):
    a, b = seq_of(spark, "ab", 1), seq_of(spark, "c", 1).unionByName(seq_of(spark, "d", 2))
    assert rows(sequence.concatenated(a, b)) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")]


def test_sql_agrees_on_the_smallest_tables(spark, small):
    import duckdb

    from seqweave.plans import oracle, queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "ptb", "linkset", "link_types", "type_forms", "edges"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    # All queries are compared on larger tables by the driver; here those of which each part has one.
    for name in ("token_sequence", "thresholds_of_sample", "link_groups", "compress_sequence", "match_previous_types", "rename_types", "link_similarity", "cluster_links", "two_layer_pipeline", "text_linkset"):
        df = queries.queries()[name](spark, small)
        r = con.sql(oracle.oracle_sql()[name])
        order = [list(r.columns).index(c) for c in df.columns]
        want = sorted((str(tuple(round(v, 6) if isinstance(v, float) else v for v in (row[i] for i in order))) for row in r.fetchall()))
        assert sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in row)) for row in df.collect()) == want, name


def test_registered_queries_look_ten_ahead(spark, small):
    from seqweave.plans import queries

    q = queries.queries()
    assert {r[0] for r in rows(q["link_edges"](spark, small), "k")} == set(range(1, 11))
    assert (queries.LOOKAHEAD, queries.WINDOW) == (10, 10)


def test_groups_across_chunks_end_in_one_task(spark, monkeypatch):
    n = 300
    edges = spark.createDataFrame([(0, 1, i, i + 1) for i in range(n) if i % 100 != 99] + [(1, 1, 5, 7)], "seq_id long, k int, one long, two long")
    want = [(0, i - i % 100, i) for i in range(n)] + [(1, 5, 5), (1, 5, 7)]
    monkeypatch.setattr(links, "LOCAL_CENTRES", 0)
    assert rows(links.link_groups_merged(edges)) == want
    monkeypatch.undo()

    def none(parents):
        raise AssertionError("rounds of jobs for a few pairs")

    monkeypatch.setattr(links, "_jump", none)
    assert rows(links.link_groups_merged(edges)) == want


def test_layers_write_each_table_once(spark, monkeypatch):
    s = seq_of(spark, list("abcabcabdabc") * 5)
    made = []
    real = pipeline.write_table
    monkeypatch.setattr(pipeline, "write_table", lambda df, label: made.append(label) or real(df, label))
    layer = pipeline.run_layer(s, None, Params(lookahead=3))
    assert made and len(made) == len(set(made)), made
    assert layer.prob.count() > 0 and layer.link_types.count() > 0 and layer.compressed.count() > 0


def test_heap_is_relieved_at_written_tables(spark, monkeypatch):
    from seqweave import session

    calls = []
    monkeypatch.setattr(session, "release", calls.append)
    for share, n in ((2.0, 0), (0.0, 1)):
        monkeypatch.setattr(session, "HEAP_SHARE", share)
        session.write_table(spark.range(1), "heap").drop()
        assert len(calls) == n


def test_network_in_single_precision():
    import numpy as np

    from seqweave.operators import network

    rnd = np.random.default_rng(1)
    windows, labels = rnd.integers(0, 5, (120, 6)), rnd.integers(0, 5, 120)
    wide = network.Lstm(5, 8, [6, 4])
    net = network.Lstm(5, 8, [6, 4], wide.weights, kind=np.float32)
    g = net.gradient(windows, labels)
    assert g.dtype == np.float32 and abs(g - wide.gradient(windows, labels)).max() < 1e-6
    p = net.forward(windows)
    assert p.dtype == np.float64 and abs(p - wide.forward(windows)).max() < 1e-6 and abs(p.sum(axis=1) - 1).max() < 1e-12
    for x in (wide, net):
        x.learn(windows, labels, 3, 1)
    assert net.weights.dtype == np.float32 and abs(net.weights - wide.weights).max() < 1e-4
    net.weights *= 1e4  # gates that are shut or open entirely
    assert np.isfinite(net.forward(windows)).all() and np.isfinite(net.gradient(windows, labels)).all()


def test_network_reads_windows_once_for_all_offsets(spark, monkeypatch):
    from seqweave.operators import network

    s = seq_of(spark, list("abcde") * 8)
    vocab = sequence.vocabulary(s)
    net = network.NetworkEstimator(3, 4, embedding=6, layers=2, epochs=2).fit(s, vocab)
    one = net.transform(s, vocab)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert plan(one) == 1 and one.count() == 3 * 37
    monkeypatch.setattr(network, "MOST_WEIGHTS", max(len(n.weights) for n in net.nets.values()))
    apart = net.transform(s, vocab)
    assert plan(apart) == 3 and rows(apart, "pos", "k", "p") == rows(one, "pos", "k", "p")
