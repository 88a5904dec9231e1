"""SQL that gives the same results as the queries of the core."""

from __future__ import annotations

from seqweave.operators.types import TIE

_SEQ = "seq AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"
_VOCAB = "vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT token FROM seq))"


def _pairs(seq: str = "seq", to: str = "pairs") -> str:
    return f"""{to} AS (SELECT a.seq_id, CAST(o.k AS INTEGER) AS k, a.pos AS one, b.pos AS two, a.token AS ctx, b.token AS nxt
FROM {seq} a, (SELECT unnest(range(1, 11)) AS k) o JOIN {seq} b ON b.seq_id = a.seq_id AND b.pos = a.pos + o.k)"""


def _prob(pairs: str = "pairs", to: str = "prob") -> str:
    return f"""{to}_n AS (SELECT k, ctx, nxt, count(*) AS n FROM {pairs} GROUP BY k, ctx, nxt),
{to} AS (SELECT k, ctx, nxt, n, CAST(sum(n) OVER (PARTITION BY k, ctx) AS BIGINT) AS n_ctx, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY k, ctx) AS p FROM {to}_n)"""


def _values(prob: str = "prob", to: str = "vals") -> str:
    """The values of each token's column with their weights, zeros included."""
    return f"""{to}_seen AS (SELECT nxt AS token, p, sum(n_ctx) AS w FROM {prob} GROUP BY nxt, p),
{to}_total AS (SELECT sum(n_ctx) AS n FROM (SELECT DISTINCT k, ctx, n_ctx FROM {prob})),
{to} AS (SELECT token, p, w FROM {to}_seen UNION ALL SELECT token, 0.0, (SELECT n FROM {to}_total) - sum(w) FROM {to}_seen GROUP BY token HAVING (SELECT n FROM {to}_total) > sum(w))"""


def _cut(values: str = "vals", to: str = "thr") -> str:
    """The best cut of each token's values into two clusters."""
    return f"""{to}_sums AS (SELECT token, p, sum(w) OVER a AS i, sum(w * p) OVER a AS s, sum(w) OVER (PARTITION BY token) AS n, sum(w * p) OVER (PARTITION BY token) AS t FROM {values} WINDOW a AS (PARTITION BY token ORDER BY p)),
{to}_cuts AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY round(CASE WHEN i < n THEN s * s / i + (t - s) * (t - s) / (n - i) ELSE -1 END, 9) DESC, p) AS r FROM {to}_sums),
{to} AS (SELECT token, CASE WHEN i < n THEN (s / i + (t - s) / (n - i)) / 2 ELSE p END AS threshold FROM {to}_cuts WHERE r = 1)"""


def _linked(pairs: str = "pairs", prob: str = "prob", thr: str = "thr", to: str = "found") -> str:
    return f"{to} AS (SELECT seq_id, k, one, two FROM {pairs} JOIN {prob} USING (k, ctx, nxt) JOIN {thr} ON {thr}.token = nxt WHERE p >= threshold)"


def _reach(edges: str = "e", to: str = "groups") -> str:
    """Components of undirected edges, named by their least position."""
    return f"""{to}_reach(seq_id, pos, g) AS (SELECT DISTINCT seq_id, a, a FROM {edges} UNION SELECT x.seq_id, x.b, r.g FROM {to}_reach r JOIN {edges} x ON x.seq_id = r.seq_id AND x.a = r.pos WHERE r.g < x.b),
{to} AS (SELECT seq_id, min(g) AS link_id, pos FROM {to}_reach GROUP BY seq_id, pos)"""


def _first(found: str = "found", to: str = "e") -> str:
    """Each position's first edge, both ways."""
    return f"""{to}_ends AS (SELECT seq_id, one AS v, two AS o, k, one FROM {found} UNION ALL SELECT seq_id, two, one, k, one FROM {found}),
{to}_first AS (SELECT seq_id, v, o FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, v ORDER BY k, one) AS r FROM {to}_ends) WHERE r = 1),
{to} AS (SELECT seq_id, v AS a, o AS b FROM {to}_first UNION SELECT seq_id, o, v FROM {to}_first)"""


def _numbered(groups: str = "groups", to: str = "own") -> str:
    return f"{to} AS (SELECT seq_id, dense_rank() OVER (ORDER BY seq_id, link_id) - 1 AS link_id, pos FROM {groups})"


def _bags(held: str, to: str = "bag") -> str:
    """Distinct contents of links, and all pairs that are similar."""
    return f"""{to} AS (SELECT min(link_id) AS bag_id, tokens FROM (SELECT link_id, list(token ORDER BY token) AS tokens FROM {held} GROUP BY link_id) GROUP BY tokens),
{to}_c AS (SELECT bag_id, token, count(*) AS n FROM (SELECT bag_id, unnest(tokens) AS token FROM {to}) GROUP BY bag_id, token),
{to}_pair AS (SELECT a.bag_id AS one, b.bag_id AS two, sum(a.n) AS c1, sum(b.n) AS c2 FROM {to}_c a JOIN {to}_c b ON a.token = b.token AND a.bag_id < b.bag_id GROUP BY 1, 2),
{to}_rated AS (SELECT one, two, least(CAST(c2 AS DOUBLE) / len(x.tokens), CAST(c1 AS DOUBLE) / len(y.tokens)) AS similarity FROM {to}_pair JOIN {to} x ON x.bag_id = one JOIN {to} y ON y.bag_id = two),
{to}_similar AS (SELECT one, two, similarity FROM {to}_rated WHERE similarity >= CAST(0.6 AS DOUBLE))"""


def _clusters(held: str, bag: str = "bag", to: str = "cluster") -> str:
    """``link_id, cluster_id``: rounds in which clusters that name each other as the best they could be combined with are combined."""
    m, x, y = TIE
    st = f"{to}_st"
    return f"""{st}(r, pair, a, b, n, na, nb, least) AS (
  SELECT 0, true, one, two, CAST(1 AS HUGEINT), CAST(1 AS HUGEINT), CAST(1 AS HUGEINT), similarity FROM {bag}_similar
  UNION ALL SELECT 0, false, bag_id, bag_id, 0, 0, 0, 0.0 FROM {bag}
  UNION ALL (
    WITH p AS (SELECT *, {{'s': -least, 'h': ((a % {m}) * {x} + (b % {m}) * {y}) % {m}, 'x': a, 'y': b}} AS rank FROM {st} WHERE pair),
    named AS (SELECT c, min(rank) AS rank FROM (SELECT a AS c, rank FROM p UNION ALL SELECT b, rank FROM p) GROUP BY c),
    agreed AS (SELECT rank.x AS x, rank.y AS y FROM named GROUP BY ALL HAVING count(*) = 2),
    into_ AS (SELECT x AS c, x AS t FROM agreed UNION ALL SELECT y, x FROM agreed),
    size AS (SELECT coalesce(t, c) AS c, sum(n) AS n FROM (SELECT DISTINCT c, n FROM (SELECT a AS c, na AS n FROM p UNION ALL SELECT b, nb FROM p)) LEFT JOIN into_ USING (c) GROUP BY ALL),
    moved AS (SELECT least(ta, tb) AS a, greatest(ta, tb) AS b, n, least FROM (SELECT coalesce(i.t, p.a) AS ta, coalesce(j.t, p.b) AS tb, p.n, p.least FROM p LEFT JOIN into_ i ON i.c = p.a LEFT JOIN into_ j ON j.c = p.b) WHERE ta <> tb),
    merged AS (SELECT a, b, sum(n) AS n, min(least) AS least FROM moved GROUP BY a, b)
    SELECT (SELECT max(r) FROM {st}) + 1, true, a, b, merged.n, s.n, t.n, least FROM merged JOIN size s ON s.c = a JOIN size t ON t.c = b WHERE merged.n = s.n * t.n
    UNION ALL SELECT r + 1, false, a, coalesce(t, b), 0, 0, 0, 0.0 FROM {st} LEFT JOIN into_ ON c = b WHERE NOT pair AND EXISTS (SELECT 1 FROM p)
  )
),
{to} AS (SELECT link_id, s.b AS cluster_id FROM (SELECT link_id, list(token ORDER BY token) AS tokens FROM {held} GROUP BY link_id) JOIN {bag} USING (tokens) JOIN (SELECT a, b FROM {st} WHERE NOT pair AND r = (SELECT max(r) FROM {st})) s ON s.a = bag_id)"""


def _layer(i: int, seq: str, previous: str | None) -> tuple[str, ...]:
    """One layer over the sequence ``seq``: ``links_i, types_i, forms_i`` and the compressed sequence ``seq_i``."""
    n = lambda name: f"{name}_{i}"
    known = "" if previous is None else f"""
prev_{i} AS (SELECT type_name AS previous_name, unnest(tokens) AS token FROM {previous}),
x_{i} AS (SELECT type_name, len(tokens) AS x FROM raw_{i}), y_{i} AS (SELECT type_name AS previous_name, len(tokens) AS y FROM {previous}),
match_{i} AS (SELECT type_name, max(previous_name) AS previous_name FROM (SELECT r.type_name, previous_name, count(*) AS c FROM (SELECT type_name, unnest(tokens) AS token FROM raw_{i}) r JOIN prev_{i} USING (token) GROUP BY ALL)
JOIN x_{i} USING (type_name) JOIN y_{i} USING (previous_name) WHERE least(CAST(c AS DOUBLE) / x, CAST(c AS DOUBLE) / y) >= CAST(0.6 AS DOUBLE) GROUP BY type_name),"""
    match = f"LEFT JOIN match_{i} USING (type_name)" if previous else "CROSS JOIN (SELECT CAST(NULL AS VARCHAR) AS previous_name)"
    return (
        _pairs(seq, n("pairs")), _prob(n("pairs"), n("prob")), _values(n("prob"), n("vals")), _cut(n("vals"), n("thr")), _linked(n("pairs"), n("prob"), n("thr"), n("found")),
        _first(n("found"), n("e")), _reach(n("e"), n("groups")), _numbered(n("groups"), n("links")),
        f"held_{i} AS (SELECT l.seq_id, l.link_id, l.pos, s.token FROM links_{i} l JOIN {seq} s USING (seq_id, pos))", _bags(n("held"), n("bag")), _clusters(n("held"), n("bag"), n("cluster")),
        f"""n_{i} AS (SELECT cluster_id, count(*) AS n FROM cluster_{i} GROUP BY cluster_id),
df_{i} AS (SELECT cluster_id, token, count(DISTINCT link_id) AS df FROM cluster_{i} JOIN held_{i} USING (link_id) GROUP BY cluster_id, token),
raw_{i} AS (SELECT CAST(cluster_id AS VARCHAR) AS type_name, coalesce(list(token ORDER BY token) FILTER (df >= n * CAST(0.6 AS DOUBLE)), []) AS tokens FROM df_{i} JOIN n_{i} USING (cluster_id) GROUP BY cluster_id),{known}
named_{i} AS (SELECT r.type_name, tokens, coalesce(previous_name, r.type_name) AS name FROM raw_{i} r {match}),
first_{i} AS (SELECT coalesce(max(CAST(regexp_extract(token, '^new_event_([0-9]+)', 1) AS BIGINT)) + 1, 0) AS o FROM {seq} WHERE regexp_matches(token, '^new_event_[0-9]+')),
new_{i} AS (SELECT name, 'new_event_' || (dense_rank() OVER (ORDER BY CAST(name AS BIGINT)) - 1 + o) AS new_name FROM (SELECT DISTINCT name FROM named_{i} WHERE regexp_matches(name, '^[0-9]+$')), first_{i}),
forms_{i} AS (SELECT coalesce(new_name, name) AS type_name, arg_max(tokens, type_name) AS tokens FROM named_{i} LEFT JOIN new_{i} USING (name) GROUP BY ALL),
types_{i} AS (SELECT link_id, coalesce(new_name, name) AS type_name FROM cluster_{i} JOIN named_{i} ON type_name = CAST(cluster_id AS VARCHAR) LEFT JOIN new_{i} USING (name)),
kinds_{i} AS (SELECT link_id, CASE WHEN avg(pos) > (min(pos) + max(pos)) / 2 THEN max(pos) ELSE min(pos) END AS anchor FROM links_{i} GROUP BY link_id),
small_{i} AS (SELECT s.seq_id, s.pos, coalesce(t.type_name, s.token) AS token FROM {seq} s LEFT JOIN links_{i} l USING (seq_id, pos) LEFT JOIN kinds_{i} USING (link_id) LEFT JOIN types_{i} t USING (link_id) WHERE l.pos IS NULL OR anchor = s.pos),
seq_{i} AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS pos, token FROM small_{i})""",
    )


def _three_means(values: str, to: str = "centres", rounds: int = 15) -> str:
    """``token, i, x``: the centres of three clusters of each token's values ``token, p, w``."""
    out = [f"""{to}_d AS (SELECT token, p, sum(w) AS w FROM {values} GROUP BY token, p),
{to}_0 AS (SELECT token, row_number() OVER (PARTITION BY token ORDER BY x) AS i, x FROM (SELECT DISTINCT token, x FROM (SELECT token, unnest(quantile_disc(p, [1 / 6, 0.5, 5 / 6])) AS x FROM {to}_d GROUP BY token)))"""]
    for r in range(rounds):
        last = "" if r < rounds - 1 else f",\n{to} AS (SELECT * FROM {to}_{rounds})"
        out.append(f"""{to}_a{r} AS (SELECT token, p, w, i FROM (SELECT d.token, p, w, i, row_number() OVER (PARTITION BY d.token, p ORDER BY abs(p - x), i) AS r FROM {to}_d d JOIN {to}_{r} c ON c.token = d.token) WHERE r = 1),
{to}_{r + 1} AS (SELECT token, row_number() OVER (PARTITION BY token ORDER BY x) AS i, x FROM (SELECT c.token, coalesce(m, x) AS x FROM {to}_{r} c LEFT JOIN (SELECT token, i, sum(p * w) / sum(w) AS m FROM {to}_a{r} GROUP BY token, i) a ON a.token = c.token AND a.i = c.i)){last}""")
    return ",\n".join(out)


_SPELLING = "^[^A-Za-z0-9]*([A-Za-z]+)[^A-Za-z0-9]*([0-9]+)"


def _name(token: str) -> str:
    return f"CASE WHEN regexp_matches({token}, '{_SPELLING}') THEN upper(regexp_extract({token}, '{_SPELLING}', 1)) || '_' || CAST(CAST(regexp_extract({token}, '{_SPELLING}', 2) AS BIGINT) AS VARCHAR) END"


_NAMED = f"named AS (SELECT seq_id, pos, min(token) AS token FROM (SELECT seq_id, pos, {_name('token')} AS token FROM ptb) WHERE token IS NOT NULL GROUP BY seq_id, pos)"
_CONTENTS = "held AS (SELECT DISTINCT l.seq_id, l.link_id, l.pos, n.token FROM linkset l JOIN named n ON n.seq_id = l.seq_id AND n.pos = l.pos)"
_FORMS = """t AS (SELECT DISTINCT link_id, type_name FROM link_types WHERE type_name IS NOT NULL), tn AS (SELECT type_name, count(*) AS n FROM t GROUP BY type_name),
df AS (SELECT type_name, token, count(DISTINCT link_id) AS df FROM t JOIN held USING (link_id) GROUP BY type_name, token),
form AS (SELECT type_name, token FROM df JOIN tn USING (type_name) WHERE df >= n * CAST(0.6 AS DOUBLE))"""
_NUMBER = "CAST('0x' || substr(md5(concat_ws('|', '42', seq_id)), 1, 8) AS BIGINT)"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def oracle_sql() -> dict[str, str]:
    pairs, prob = _pairs(), _prob()
    edges = (_SEQ, pairs, prob, _values(), _cut(), _linked())
    kinds = """kinds AS (SELECT link_id, 'new_event_' || count(*) AS type_name, CASE WHEN avg(pos) > (min(pos) + max(pos)) / 2 THEN max(pos) ELSE min(pos) END AS anchor FROM own GROUP BY link_id)"""
    stream = "seq AS (SELECT CAST(0 AS BIGINT) AS seq_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events WHERE event_type IS NOT NULL)"
    cells = "cells AS (SELECT c.k, c.ctx, v.token_id, v.token, coalesce(prob.p, 0) AS p FROM (SELECT DISTINCT k, ctx FROM prob) c CROSS JOIN vocab v LEFT JOIN prob ON prob.k = c.k AND prob.ctx = c.ctx AND prob.nxt = v.token)"
    deltas = "deltas AS (SELECT seq_id, pos, k, token_id, cells.token, p - coalesce(lag(p) OVER (PARTITION BY seq_id, k, token_id ORDER BY pos), 0) AS delta FROM seq JOIN cells ON ctx = seq.token)"
    layer_1, layer_2 = _layer(1, "seq", None), _layer(2, "seq_1", "forms_1")
    cut = "z AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM {seq}), y AS (SELECT *, round_even(n * CAST(0.1 AS DOUBLE), 0) AS te, round_even(n * CAST(0.2 AS DOUBLE), 0) AS va FROM z)"
    split = "SELECT seq_id, pos, token, CASE WHEN pos < n - te - va THEN 'train' WHEN pos < n - te THEN 'valid' ELSE 'test' END AS split FROM y"
    matched = f"""prev AS (SELECT DISTINCT type_name AS previous_name, token FROM (SELECT type_name, {_name('t')} AS token FROM (SELECT type_name, unnest(tokens) AS t FROM type_forms WHERE type_name IS NOT NULL)) WHERE token IS NOT NULL),
x AS (SELECT type_name, count(*) AS x FROM form GROUP BY type_name), y AS (SELECT previous_name, count(*) AS y FROM prev GROUP BY previous_name),
m AS (SELECT type_name, previous_name, count(*) AS c FROM form JOIN prev USING (token) GROUP BY type_name, previous_name),
matched AS (SELECT type_name, max(previous_name) AS previous_name FROM m JOIN x USING (type_name) JOIN y USING (previous_name) WHERE least(CAST(c AS DOUBLE) / x, CAST(c AS DOUBLE) / y) >= CAST(0.6 AS DOUBLE) GROUP BY type_name)"""
    return {
        "token_sequence": _with(_SEQ) + "SELECT seq_id, pos, token FROM seq",
        "vocabulary": _with(_SEQ, _VOCAB) + "SELECT token, token_id FROM vocab",
        "numberify": _with(_SEQ, _VOCAB) + "SELECT seq_id, pos, token_id FROM seq JOIN vocab USING (token)",
        "lookahead_pairs": _with(_SEQ, pairs) + "SELECT seq_id, k, one, two, ctx, nxt FROM pairs",
        "sliding_windows": _with(_SEQ, _VOCAB) + """, w AS (SELECT seq_id, pos, list(token_id) OVER s AS win, lead(token_id) OVER (PARTITION BY seq_id ORDER BY pos) AS label
FROM seq JOIN vocab USING (token) WINDOW s AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT seq_id, pos, array_to_string(win, ' ') AS win, label FROM w WHERE len(win) = 10 AND label IS NOT NULL""",
        "one_hot_labels": _with(_SEQ, _VOCAB) + "SELECT seq_id, pos, repeat('0', CAST(token_id AS BIGINT)) || '1' || repeat('0', CAST((SELECT count(*) FROM vocab) - 1 - token_id AS BIGINT)) AS label FROM seq JOIN vocab USING (token)",
        "batch_layout": _with(_SEQ) + "SELECT seq_id, CAST(ceil(count(*) / 50.0) AS BIGINT) AS batches, (count(*) - 1) % 50 + 1 AS last_batch FROM seq GROUP BY seq_id",
        "next_event_prob": _with(_SEQ, pairs, prob) + "SELECT k, ctx, nxt, n, n_ctx, p FROM prob",
        "probability_column": _with(_SEQ, pairs, prob) + "SELECT k, ctx, p, n_ctx AS n FROM prob WHERE nxt = 'click' AND p >= 0",
        "matrix_shape": _with(_SEQ, _VOCAB, pairs, prob) + "SELECT k, count(*) AS n_rows, (SELECT count(*) FROM vocab) AS n_columns FROM seq JOIN (SELECT DISTINCT k, ctx FROM prob) ON ctx = token GROUP BY k",
        "probability_deltas": _with(_SEQ, _VOCAB, pairs, prob, cells, deltas) + "SELECT seq_id, pos, k, token_id, round(delta, 9) AS delta FROM deltas",
        "sampled_scan": _with(_SEQ, pairs) + "SELECT seq_id, k, one, two, ctx, nxt FROM pairs WHERE substr(md5(concat_ws('|', seq_id, k, one)), 1, 4) < '3333'",
        "thresholds": _with(_SEQ, pairs, prob, _values(), _cut()) + "SELECT token, round(threshold, 9) AS threshold FROM thr",
        "thresholds_of_sample": _with(_SEQ, pairs, prob, "half AS (SELECT * FROM pairs WHERE substr(md5(concat_ws('|', seq_id, k, one)), 1, 4) < '8000')", "rows_n AS (SELECT k, ctx, count(*) AS n_ctx FROM half GROUP BY k, ctx)",
            "drawn AS (SELECT k, ctx, nxt, p, rows_n.n_ctx FROM prob JOIN rows_n USING (k, ctx))", _values("drawn"), _cut()) + "SELECT token, round(threshold, 9) AS threshold FROM thr",
        "thresholds_of_three": _with(_SEQ, pairs, prob, _values(), _three_means("vals")) + "SELECT token, round(CASE WHEN count(*) > 1 THEN (max(x) FILTER (r = 1) + max(x) FILTER (r = 2)) / 2 ELSE max(x) END, 9) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY x DESC) AS r FROM centres) GROUP BY token",
        "kmeans_assign": _with("v AS (SELECT event_type AS token, value AS p, 1 AS w FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)", _three_means("v")) + """SELECT event_id, CAST(i - 1 AS INTEGER) AS centre, round(x, 6) AS at FROM (SELECT event_id, CASE WHEN value IS NOT NULL THEN i END AS i, CASE WHEN value IS NOT NULL THEN x END AS x, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - x), i) AS r FROM events LEFT JOIN centres ON token = event_type WHERE event_type IS NOT NULL) WHERE r = 1""",
        "estimate_epochs": f"WITH n AS (SELECT split, {_name('token')} AS token FROM ptb) SELECT round(least(count(DISTINCT token) / CAST(count(DISTINCT CASE WHEN split = 'train' THEN token END) AS DOUBLE), 2) * 16, 6) AS epochs FROM n",
        "link_edges": _with(*edges) + "SELECT seq_id, k, one, two FROM found",
        "link_groups": _with(*edges, _first(), _reach(), recursive=True) + "SELECT seq_id, link_id, pos FROM groups",
        "link_groups_merged": _with(*edges, "e AS (SELECT seq_id, one AS a, two AS b FROM found UNION SELECT seq_id, two, one FROM found)", _reach(), recursive=True) + "SELECT seq_id, link_id, pos FROM groups",
        "link_contents": _with(_NAMED, _CONTENTS) + "SELECT seq_id, link_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM held GROUP BY seq_id, link_id",
        "link_span": "SELECT seq_id, link_id, min(pos) AS first_pos, max(pos) AS last_pos, avg(pos) AS mean_pos, count(*) AS size FROM (SELECT DISTINCT seq_id, link_id, pos FROM linkset WHERE pos IS NOT NULL) GROUP BY seq_id, link_id",
        "link_similarity": _with(_NAMED, _CONTENTS, _bags("held")) + "SELECT one, two, round(similarity, 9) AS similarity FROM bag_similar",
        "cluster_links": _with(_NAMED, _CONTENTS, _bags("held"), _clusters("held"), recursive=True) + "SELECT link_id, cluster_id FROM cluster",
        "delta_edges": _with(_SEQ, _VOCAB, pairs, prob, cells, deltas, "vals AS (SELECT token, delta AS p, count(*) AS w FROM deltas WHERE delta >= 0 GROUP BY token, delta)", _cut()) + "SELECT pairs.seq_id, pairs.k, one, two FROM pairs JOIN deltas d ON d.seq_id = pairs.seq_id AND d.pos = one AND d.k = pairs.k AND d.token = nxt JOIN thr ON thr.token = nxt WHERE delta >= threshold",
        "canonical_forms": _with(_NAMED, _CONTENTS, _FORMS) + "SELECT type_name, coalesce(string_agg(token, ' ' ORDER BY token), '') AS tokens FROM tn LEFT JOIN form USING (type_name) GROUP BY type_name",
        "match_previous_types": _with(_NAMED, _CONTENTS, _FORMS, matched) + "SELECT type_name, previous_name FROM matched",
        "rename_matched": _with(_NAMED, _CONTENTS, _FORMS, matched) + "SELECT DISTINCT link_id, coalesce(previous_name, l.type_name) AS type_name FROM (SELECT DISTINCT link_id, type_name FROM link_types) l LEFT JOIN matched m ON m.type_name = l.type_name",
        "rename_types": """WITH r AS (SELECT DISTINCT link_id, CASE WHEN link_id % 3 <> 0 THEN regexp_extract(type_name, '([0-9]+)$', 1) ELSE type_name END AS type_name FROM link_types),
o AS (SELECT coalesce(max(CAST(regexp_extract(type_name, '^new_event_([0-9]+)', 1) AS BIGINT)) + 1, 0) AS o FROM type_forms WHERE regexp_matches(type_name, '^new_event_[0-9]+')),
n AS (SELECT type_name, 'new_event_' || (dense_rank() OVER (ORDER BY CAST(type_name AS BIGINT)) - 1 + o) AS new_name FROM (SELECT DISTINCT type_name FROM r WHERE regexp_matches(type_name, '^[0-9]+$')), o)
SELECT link_id, coalesce(new_name, type_name) AS type_name FROM r LEFT JOIN n USING (type_name)""",
        "update_dataset": _with(_NAMED) + """, t AS (SELECT link_id, max(type_name) AS type_name FROM link_types WHERE type_name IS NOT NULL GROUP BY link_id),
last_link AS (SELECT seq_id, pos, arg_max(type_name, link_id) AS type_name FROM linkset JOIN t USING (link_id) WHERE pos IS NOT NULL GROUP BY seq_id, pos)
SELECT seq_id, pos, coalesce(type_name, token) AS token FROM named LEFT JOIN last_link USING (seq_id, pos)""",
        "compress_sequence": _with(*edges, _first(), _reach(), _numbered(), kinds, recursive=True) + """SELECT s.seq_id, s.pos, coalesce(kinds.type_name, s.token) AS token FROM seq s
LEFT JOIN own ON own.seq_id = s.seq_id AND own.pos = s.pos LEFT JOIN kinds USING (link_id) WHERE own.pos IS NULL OR kinds.anchor = s.pos""",
        "split_sequence": _with(_SEQ, cut.format(seq="seq")) + split,
        "holdout_split": _with(_SEQ) + f""", z AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM seq), y AS (SELECT *, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS len FROM z),
x AS (SELECT *, {_NUMBER} % greatest(n - len, 1) AS start FROM y)
SELECT seq_id, pos, token, pos >= start AND pos < start + len AS held_out FROM x""",
        "activity_pipeline": _with(_SEQ, *layer_1, cut.format(seq="seq_1"), recursive=True) + split,
        "activity_links": _with(_SEQ, *layer_1, recursive=True) + "SELECT seq_id, link_id, pos, type_name FROM links_1 LEFT JOIN types_1 USING (link_id)",
        "two_layer_pipeline": _with(_SEQ, *layer_1, *layer_2, recursive=True) + "SELECT seq_id, pos, token FROM seq_2",
        "text_sequence": _with(stream) + "SELECT seq_id, pos, token FROM seq",
        "text_vocabulary": f"SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT {_name('token')} AS token FROM ptb) WHERE token IS NOT NULL",
        "text_thresholds": _with(_SEQ, _VOCAB, pairs, prob, _values(), _cut()) + "SELECT token_id, round(threshold, 9) AS threshold FROM thr JOIN vocab USING (token)",
        "text_probabilities": _with(stream, _VOCAB, pairs, prob, cells) + "SELECT k, pos, token_id, round(p, 9) AS p FROM seq JOIN cells ON ctx = seq.token",
        "text_deltas": _with(stream, _VOCAB, pairs, prob, cells, deltas) + "SELECT k, pos, token_id, round(delta, 9) AS p FROM deltas",
        "text_linkset": "SELECT DISTINCT CAST(0 AS BIGINT) AS seq_id, dense_rank() OVER (ORDER BY link_id) - 1 AS link_id, pos FROM linkset WHERE pos IS NOT NULL AND link_id IS NOT NULL",
        "text_link_types": "SELECT CAST(0 AS BIGINT) AS seq_id, row_number() OVER (ORDER BY link_id) - 1 AS link_id, coalesce(trim(min(type_name)), '') AS type_name FROM link_types GROUP BY link_types.link_id",
        "text_type_forms": _with(_NAMED, _CONTENTS, _FORMS) + "SELECT type_name, coalesce(string_agg(token, ' ' ORDER BY token), '') AS tokens FROM tn LEFT JOIN form USING (type_name) GROUP BY type_name",
        "stored_model": _with(_SEQ, pairs, prob) + "SELECT seq_id, pos, k, nxt AS token, round(p, 9) AS p FROM seq JOIN prob ON ctx = token",
        "preloaded_matrix": _with(_SEQ, pairs, prob) + "SELECT k, ctx, nxt, n, n_ctx, p FROM prob WHERE k = 1",
    }
