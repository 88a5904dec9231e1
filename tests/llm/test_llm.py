import importlib.util
import math
import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seqweave.llm import bpe, clusters, components, cooccurrence, events, mixing, overlap, queries, runs, terms, visual

PTB = "seq_id long, pos long, token string, split string, ts timestamp, arrived_at timestamp"
T0 = datetime(2020, 1, 1)


def ptb_of(spark, rows):
    return spark.createDataFrame([(s, p, t, "train", T0 + timedelta(seconds=p) if p % 7 else None, T0 + timedelta(seconds=p + d)) for s, p, t, d in rows], PTB)


def spelled(rnd, name):
    letters, n = name.split("_")
    return rnd.choice(["", " ", "\t"]) + rnd.choice([letters, letters.lower(), letters.title()]) + rnd.choice(["_", "__", "-", "/", ".", " ", ""]) + rnd.choice(["", "0", "00"]) + n + rnd.choice(["", "=on", "=26.5", ";", "(3)", " #12", "  "])


def random_ptb(rnd, seqs=6, n=150):
    rows, truth = [], {}
    for s in range(seqs):
        pos = 0
        for _ in range(n if s else 4 * n):
            pos += rnd.choice([1, 1, 1, 2])
            name = rnd.choice(["AA_1", "AA_1", "AA_1", "BB_0", "C_12", None])
            truth[s, pos] = name
            for d in range(rnd.choice([1, 1, 2])):
                rows.append((s, pos, spelled(rnd, name) if name else rnd.choice([None, "", "  "]), d))
    rnd.shuffle(rows)
    return rows, truth


def expected_runs(truth):
    out, cur = set(), None
    for (s, p), name in sorted(truth.items()):
        if cur and name and cur[0] == s and cur[1] == name:
            cur[3], cur[4] = p, cur[4] + 1
            continue
        if cur and cur[4] > 1:
            out.add(tuple(cur))
        cur = [s, name, p, p, 1] if name else None
    return out | ({tuple(cur)} if cur and cur[4] > 1 else set())


@pytest.mark.parametrize("fan_in", [512, 2])
def test_runs(spark, monkeypatch, fan_in):
    monkeypatch.setattr(runs, "FAN_IN", fan_in)
    rows, truth = random_ptb(random.Random(1))
    truth |= {(99, p): "ZZ_9" for p in range(900)}  # one run over several chunks
    rows += [(99, p, "zz_09", 0) for p in range(900)]
    got = runs.repeated_runs(ptb_of(spark, rows).withColumn("name", F.lit("clash")))
    assert {tuple(r)[:5] for r in got.select("seq_id", "name", "first_pos", "last_pos", "n_events").collect()} == expected_runs(truth)
    long = got.where("seq_id = 99").first()
    assert long.duration_s == 899 - 1 - 0 - (0 if 899 % 7 else 1)
    assert runs.repeated_runs(ptb_of(spark, rows).where("false")).count() == 0


def test_terms(spark):
    rows, truth = random_ptb(random.Random(2))
    vocab = spark.createDataFrame([("AA_1", 1), ("BB_0", 2), ("C_12", 3), ("C_12", 3), ("NEVER_1", 4), (None, 5)], "token string, token_id int")
    got = {r.token: (r.n_events, r.n_sequences, r.mark) for r in terms.term_counts(ptb_of(spark, rows), vocab).collect()}
    n = Counter(v for v in truth.values() if v)
    q = {t: len({s for (s, _), v in truth.items() if v == t}) for t in n}
    assert got == {t: (n[t], q.get(t, 0), "rare" if q.get(t, 0) < 3 else "common" if q[t] > 3 else None) for t in ("AA_1", "BB_0", "C_12", "NEVER_1")}
    empty = terms.term_counts(ptb_of(spark, rows).where("false"), vocab).collect()
    assert {(r.n_events, r.mark) for r in empty} == {(0, "rare")} and len(empty) == 4


def test_burst_trie_against_a_dict():
    rnd = random.Random(3)
    trie, plain = terms.BurstTrie(burst=4), Counter()
    for _ in range(5000):
        t = "".join(rnd.choices("abé", k=rnd.randint(0, 6)))
        trie.at(t, lambda: [0])[0] += 1
        plain[t] += 1
    assert {t: c[0] for t, c in trie.items()} == plain
    assert [t for t, _ in trie.items()] == sorted(plain)


def test_routes_split_crowded_prefixes(spark):
    df = spark.createDataFrame([("aaaa%03d" % i,) for i in range(300)] + [("b",), ("",), ("aaaa",)] * 3, "term string")
    crowded = terms.routes(df, 40)
    routed = terms.routed(df, crowded).withColumnRenamed("route", "r")
    assert "aaaa" in crowded
    assert routed.groupBy("r").count().agg(F.max("count")).first()[0] <= 100
    assert routed.groupBy("term").agg(F.countDistinct("r").alias("n")).where("n > 1").count() == 0


def names_df(spark, sets, key="link_id", kind="long"):
    return spark.createDataFrame([(k, n) for k, s in sets.items() for n in s], f"{key} {kind}, name string")


def test_cooccurrence(spark, monkeypatch):
    rnd = random.Random(4)
    sets = {i: set(rnd.sample("ABCDEFGHIJ", rnd.randint(1, 5))) for i in range(120)}
    one, two = Counter(x for s in sets.values() for x in s), Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    for block in (8192, 3):
        monkeypatch.setattr(cooccurrence, "BLOCK", block)
        got = {(r.token_a, r.token_b): (r.n_a, r.n_b, r.n_ab, round(r.lift, 6)) for r in cooccurrence.pairs_of_names(names_df(spark, sets), least=10, least_lift=1.1).collect()}
        assert got == {(a, b): (one[a], one[b], n, round(n * 120 / (one[a] * one[b]), 6)) for (a, b), n in two.items() if n >= 10 and n * 120 / (one[a] * one[b]) >= 1.1} and got
    assert cooccurrence.pairs_of_names(names_df(spark, sets).where("false")).count() == 0


@pytest.mark.parametrize("items, block", [(200_000, 1024), (0, 1024), (0, 3)])
def test_all_pairs_that_occur_together(spark, small, monkeypatch, items, block):
    import duckdb

    monkeypatch.setattr(cooccurrence, "BROADCAST_ITEMS", items)
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    con = duckdb.connect()
    for t in ("ptb", "linkset"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    every = con.sql(queries._PAIRS + "SELECT token_a, token_b, a.n, b.n, n_ab, round(CAST(n_ab * n.n AS DOUBLE) / (a.n * b.n), 6) FROM two JOIN one a ON a.name = token_a JOIN one b ON b.name = token_b, n").fetchall()
    got = [(r.token_a, r.token_b, r.n_a, r.n_b, r.n_ab, round(r.lift, 6)) for r in queries.queries()["p4_all_pairs"](spark, small).collect()]
    key = lambda r: r[:5]
    assert sorted(map(key, got)) == sorted(map(key, every)) and any(r[4] == 1 for r in got) and any(r[5] < 1 for r in got)
    lift = {r[:2]: r[5] for r in every}
    assert all(abs(lift[r[:2]] - r[5]) < 2e-6 for r in got)


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("small, meetings", [(0, 10**6), (0, 50), (4, 50), (6, 10**6), (20, 7)])
def test_overlap(spark, small, meetings, monkeypatch):
    rnd = random.Random(5)
    left = {i: set(rnd.sample("ABCDEFGHIJKL", rnd.randint(1, 9))) for i in range(80)}
    right = {f"t{i}": set(rnd.sample("ABCDEFGHIJKL", rnd.randint(1, 8))) for i in range(60)}
    left[80], left[81], right["t60"] = set("ABC"), set("ABC"), set("ABCDE")
    monkeypatch.setattr(overlap.similar_sets, "__defaults__", (3, 5, min(small, 8)))
    monkeypatch.setattr(overlap, "MEETINGS", meetings)
    left[82], right["t61"] = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("?!")
    got = [(r.link_id, r.type_name) for r in overlap.links_and_types(names_df(spark, left), names_df(spark, right, "type_name", "string")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, t) for i, a in left.items() for t, b in right.items() if len(a & b) * 5 >= 3 * len(a | b)}
    assert (80, "t60") in got
    assert overlap.links_and_types(names_df(spark, left), names_df(spark, right, "type_name", "string").where("false")).count() == 0


def test_form_names(spark):
    forms = spark.createDataFrame([("a", ["ab_1", " AB-01;", None, ""]), ("a", ["AB_1"]), ("b", []), ("c", None), (None, ["X_1"])], "type_name string, tokens array<string>")
    assert [tuple(r) for r in queries.form_names(forms).collect()] == [("a", "AB_1")]


def test_components(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randint(0, 2), *rnd.sample(range(400), 2)) for _ in range(450)] + [(7, i, i + 1) for i in range(300)] + [(8, 0, i) for i in range(1, 300)] + [(8, 500, 299)]
    dirty = [(1, 3, 3), (1, None, 4), (1, 4, None), (1, 900, 900), (None, 1, 2)]
    df = spark.createDataFrame(pairs + [(s, b, a) for s, a, b in pairs[::3]] + pairs[::5] + dirty, "seq_id long, one long, two long").withColumn("k", F.lit(None).cast("int")).withColumn("hi", F.lit("clash"))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in pairs:
        x, y = find((s, a)), find((s, b))
        parent[max(x, y)] = min(x, y)
    got = [tuple(r) for r in components.components(df).select("seq_id", "group", "node").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(s, find((s, p))[1], p) for s, p in list(parent)}
    assert components.components(df.where("false")).count() == 0


TEXTS = ["", None, "   a  b\n\n  c", "a" * 3000, " " * 2000, "-" * 500 + "=-" * 200, "it's we'll <|endoftext|> I'm", "日本語テキスト" * 20, "  x　y 12345 ½", "naïve café"]


def test_token_ids(spark):
    import tokenizers

    spec = importlib.util.spec_from_file_location("public_tokenizers", "/opt/tokenizers/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in bpe.token_ids(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert bpe.token_ids(df.where("false")).count() == 0
    n = {r.doc_id: r.tokens for r in bpe.token_counts(df.select("doc_id", "text")).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_long_words():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    rnd = random.Random(21)
    words = ["".join(rnd.choices(letters, k=n)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "щжыё", "=-_", "é\u0301a") for n in (49, 300, 3000)]
    words += ["a" * 20_000, "=" * 5001, "the" * 900, "internationalisation" * 60, " " * 777 + "x"]
    e = bpe.Encoder(bpe.TOKENIZERS, "byte_bpe_50k.json")
    assert e.ordered
    for ordered in (True, False):  # out of turn or not, the ids are the same
        e.known, e.ordered = {}, ordered
        assert bpe.encode_batch(e, words).to_pylist() == [x.ids for x in t.encode_batch(words, add_special_tokens=False)]


def test_ids_decode_to_the_texts(spark):
    texts = ["", "a  b\n", "naïve \U0001f469\u200d\U0001f52c", "x" * 5000, "\u2028", "<|endoftext|>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    assert [r.text for r in bpe.texts(bpe.token_ids(df)).orderBy("doc_id").collect()] == [t or "" for t in texts]
    assert bpe.texts(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None
    assert bpe.texts(bpe.token_ids(df.where("false"))).count() == 0


def test_the_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "SYMBOLS", 40)
    e = bpe.Encoder(bpe.TOKENIZERS, "byte_bpe_50k.json")
    texts = ["one two three", "three four five six seven", "one eight " + "z" * 300]
    first = bpe.encode_batch(e, texts).to_pylist()
    again = [bpe.encode_batch(e, [t]).to_pylist()[0] for t in texts]
    assert first == again and len(e.known) <= 10  # the words of the last batch that held new ones


def test_mixing(spark):
    rnd = random.Random(10)
    docs = [(i, rnd.choices(["Big", "mid-size", " small ", None, "other"], [60, 25, 3, 5, 7])[0], rnd.randint(0, 90)) for i in range(3000)]
    sized = spark.createDataFrame([(i, None if s is None else s.strip().lower().replace("-", "_"), n) for i, s, n in docs], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.3, 2), ("small", 0.15, 3), ("none", 0.05, 2), ("small", 0.15, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets)
    rows = mixed.orderBy("position_tokens").collect()
    held = Counter()
    for i, s, n in [tuple(r) for r in sized.collect()]:
        held[s] += n
    budget = int(min(held["big"] / 0.5, held["mid_size"] * 2 / 0.3, held["small"] * 3 / 0.15) * 0.95)
    total = Counter()
    for r in rows:
        total[r.source] += r.tokens
    assert 0 <= budget - sum(total.values()) <= 90
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    for s, share in (("big", 0.5), ("mid_size", 0.3), ("small", 0.15)):
        assert total[s] / sum(total.values()) == pytest.approx(share / 0.95, abs=0.01)
    copies = Counter((r.doc_id, r.source) for r in rows)
    assert max(n for (_, s), n in copies.items() if s == "big") == 1 and max(n for (_, s), n in copies.items() if s == "small") <= 3
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    told = {r.source: r for r in mixing.report(mixed, targets).collect()}
    assert told["none"].actual_share == 0 and told["big"].tokens == total["big"] and len(told) == 4
    more = mixing.mix(sized, targets, budget=10**9)
    assert more.agg(F.sum("tokens")).first()[0] == held["big"] + 2 * held["mid_size"] + 3 * held["small"]
    assert mixing.mix(sized.where("false"), targets).count() == 0
    for part in (1, 40, budget // 3, int(budget * 1.5)):  # copies that aren't built wouldn't have got in
        got = {(r.source, r.doc_id, r.copy, r.position_tokens) for r in mixing.mix(sized, targets, budget=part).collect()}
        assert got == {(r.source, r.doc_id, r.copy, r.position_tokens) for r in more.where(F.col("position_tokens") <= part).collect()}


def test_the_report_names_the_source_that_binds(spark):
    sized = spark.createDataFrame([(i, "big", 10) for i in range(100)] + [(100, "tiny", 5), (101, "other", 7)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Tiny", 0.5, 2), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    told = {r.source: r for r in mixing.report(mixing.mix(sized, targets), targets, sized).collect()}
    assert {s: (r.tokens, r.taken, r.unused, r.binds) for s, r in told.items()} == {"big": (10, 1, 990, False), "tiny": (10, 2, 0, True), "none": (0, 0, 0, False)}


def test_running_sum(spark):
    rnd = random.Random(11)
    data = [(rnd.choice("aaaab"), i, rnd.randint(0, 9)) for i in range(2000)]
    got = {(r.g, r.o): r.t for r in mixing.running_sum(spark.createDataFrame(data, "g string, o long, v long"), "g", ["o"], "v", "t")[0].collect()}
    sums, want = Counter(), {}
    for g, o, v in data:
        sums[g] += v
        want[g, o] = sums[g]
    assert got == want


SAME = [
    ("café", "café"), ("ＡＢ x", "AB x"), ("a b", "a b"), ("a b", "a b"), ("a​b﻿", "ab"), ("co­op", "coop"), ("аbc", "abc"),
    ("K", "K"), ("µm", "μm"), ("ﬁn", "fin"), ("a‑b", "a-b"), ("ё", "ë"), ("й", "й"), ("e​́", "é"), ("a\r\nb", "a\nb"), ("ﾊﾟ", "パ"), ("ạ́", "ạ́"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("x²", "x2"), ("a-b", "a–b"), ("–", "—"), ("a b", "ab"), ("\U0001f469‍\U0001f52c", "\U0001f469\U0001f52c"), ("й", "и"), ("a  b", "a b"), ("1", "l"), ("ı", "i"), ("α", "a"), ("г", "r"), ("æ", "ae"), ("I", "l"), ("Л", "Λ"), ("Ю", "IO"), ("½", "1/2"), ("ſ", "f"), ("О", "0")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(spark, a, b):
    form = visual.one_form(spark)
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(spark, a, b):
    form = visual.one_form(spark)
    assert form(a) != form(b)


def test_forms_are_stable(spark):
    form = visual.one_form(spark)
    chars = [chr(n) for n in range(0x80, 0x3000) if not 0xD800 <= n < 0xE000]
    rnd = random.Random(12)
    for _ in range(3000):
        t = "".join(rnd.choices(chars + list("abc ́̈​‍"), k=rnd.randint(1, 6)))
        f = form(t)
        assert form(f) == f, ascii(t)
    assert form(None) is None and form("") == ""


def test_the_mapping_matches_the_longest():
    t = visual.Transducer({"ж": "1", "жы": "2", "жыщ": "", "\r\n": "n", "\r": "r"})
    assert t.walk("жыщжыжъ") == "21ъ" and t("\r\n\r") == "nr"


@pytest.mark.parametrize("meetings", [10**6, 3])
def test_look_alikes(spark, monkeypatch, meetings):
    monkeypatch.setattr(visual, "MEETINGS", meetings)
    texts = [x for p in SAME for x in p] + [x for p in DIFFERENT for x in p] + [None, "", " ", "​", " ", "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit("clash"))
    rows = [tuple(r) for r in visual.look_alikes(df).collect()]
    got, form = set(rows), list(map(visual.one_form(spark), texts))
    assert len(rows) == len(got) and got == {(i, j) for i, j in combinations(range(len(texts)), 2) if texts[i] and texts[j] and form[i].strip() and form[i] == form[j] and texts[i] != texts[j]}
    assert all((2 * i, 2 * i + 1) in got for i in range(len(SAME)))
    assert [r.form for r in visual.unified(df).orderBy("doc_id").collect()] == form
    of = {r.doc_id: (r.class_id, r.same_text) for r in visual.look_classes(df).collect()}
    assert of.keys() == {i for p in got for i in p}
    assert all(c == min(j for j in of if form[j] == form[i]) and t == min(j for j in of if texts[j] == texts[i]) for i, (c, t) in of.items())
    assert visual.look_alikes(df.where("false")).count() == 0


def test_link_names(spark, tmp_path):
    ptb_of(spark, [(1, 0, "a_1", 0), (1, 0, "A-01", 1), (1, 1, None, 0), (2, 0, "B_2", 0)]).write.parquet(str(tmp_path / "ptb.parquet"))
    spark.createDataFrame([(1, 10, 0), (1, 10, 0), (1, 10, 1), (1, 10, None), (1, 10, 7), (2, 11, 0)], "seq_id long, link_id long, pos long").write.parquet(str(tmp_path / "linkset.parquet"))
    assert sorted(tuple(r) for r in events.link_names(spark, str(tmp_path)).df.collect()) == [(10, "A_1"), (11, "B_2")]


def test_queries_run_on_the_smallest_tables(spark, small):
    for name, q in queries.queries().items():
        assert q(spark, small).count() > 0, name


def test_star_rounds_alone(spark):
    edges = spark.createDataFrame([(0, i + 1, i) for i in range(200)] + [(1, 9, i) for i in range(9)] + [(2, 5, 1), (2, 7, 5), (2, 7, 3)], "seq_id long, hi long, lo long")
    got = {(r.seq_id, r.hi): r.lo for r in components.star_rounds(edges).collect()}
    assert got == {(0, i): 0 for i in range(1, 201)} | {(1, i): 0 for i in range(1, 10)} | {(2, i): 1 for i in (3, 5, 7)}
