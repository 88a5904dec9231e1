"""Problem 7: encoding of the whole corpus with a public tokenizer.

Each task splits its texts into words by the tokenizer's pattern and encodes every word it hasn't met yet, once, in
an in-process DuckDB: token-position rows join the merge table, and a recursive query contracts pairs until no word has
one left. In every round it contracts the minimum-rank pair of each word (leftmost first, where occurrences overlap) and
all pairs that come before whatever could still touch them, so a long word takes no more rounds than a short one. An
ordered aggregation gives the word's ids; a document's ids are those of its words in order. Another ordered aggregation
decodes ids to texts. No shuffle: documents stay where they were read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqweave.session import ship

#: Where the public tokenizers' files lie on every machine.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern of byte-level files that use the format's own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contractions of one recursive query; words that need more go on in the next.
ROUNDS = 16
#: Words of more characters than this are encoded as long ones.
LONG = 48
#: Symbols of new words that one query takes, and words that a worker remembers.
SYMBOLS, REMEMBERED = 300_000, 400_000

# One round: the minimum-rank pair of every word is contracted, leftmost first where its occurrences overlap.
_ENCODE = """
WITH RECURSIVE bpe(w, p, t, n) AS (
  SELECT w, p, t, 0 FROM symbols
  UNION ALL
  SELECT w, p, CASE WHEN hit THEN made ELSE t END, n + 1 FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY p), false) AS used FROM (
      SELECT *, here AND row_number() OVER (PARTITION BY w, here, i - seen ORDER BY i) % 2 = 1 AS hit FROM (
        SELECT *, sum(here::INT) OVER (PARTITION BY w ORDER BY i) AS seen FROM (
          SELECT *, coalesce(rank = best, false) AS here FROM (
            SELECT w, p, t, n, i, m.rank AS rank, m.made AS made, min(m.rank) OVER (PARTITION BY w) AS best
            FROM (
              SELECT w, p, t, n, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt, row_number() OVER (PARTITION BY w ORDER BY p) AS i
              FROM bpe WHERE n < $rounds
            ) AS s LEFT JOIN merges AS m ON m.l = s.t AND m.r = s.nt
          ) WHERE best IS NOT NULL
        )
      )
    )
  ) WHERE NOT used
)
SELECT w, max(n) = $rounds AS more, list(t ORDER BY p) AS ids
FROM (SELECT *, max(n) OVER (PARTITION BY w) AS top FROM bpe) WHERE n = top GROUP BY w
"""
# One round of long words. They fall into pieces (``q``) where no merge joins what ends with the token on the left to what
# begins with the one on the right, now or later; a piece without a pair is done. In a piece the minimum-rank pair is contracted and
# every pair of which nothing of a rank up to its own can take the left token away to the left, nor the right one to the
# right: not the token that is beside it now, and either no longer one that this could grow into, or this can't grow
# before (``x``: the least rank of a merge of the pair's token with one that ends with its neighbour; ``x2``: of the neighbour
# with one that ends with the token beyond). Such a pair's turn comes before anything touches its two tokens, and what
# comes before its turn has ranks of up to its own, while all merges of the token it makes have greater ones: the result
# is the same.
NEVER = 2**31 - 1
_ENCODE_LONG = f"""
WITH RECURSIVE bpe(w, g, p, t, n, done) AS (
  SELECT w, 0, p, t, 0, false FROM symbols
  UNION ALL
  SELECT w, piece, p, CASE WHEN hit THEN made ELSE t END, n + 1, best IS NULL FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY w, piece ORDER BY p), false) AS used FROM (
      SELECT *, first OR (here AND row_number() OVER (PARTITION BY w, piece, here, i - seen ORDER BY i) % 2 = 1) AS hit FROM (
        SELECT *, sum(here::INT) OVER (PARTITION BY w, piece ORDER BY i) AS seen FROM (
          SELECT *, coalesce(rank = best, false) AS here FROM (
            SELECT *, min(rank) OVER (PARTITION BY w, g, q) AS best, min(p) OVER (PARTITION BY w, g, q) AS piece,
              coalesce($ordered AND rank < least(coalesce(lag(rank) OVER o, rank + 1), coalesce(lead(rank) OVER o, rank + 1), greatest(x, x2), greatest(y, y2)), false) AS first
            FROM (
              SELECT *, coalesce(sum(dead) OVER (PARTITION BY w, g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM (
                SELECT s.*, m.rank AS rank, m.made AS made, coalesce(x.rank, {NEVER}) AS x, coalesce(x2.rank, {NEVER}) AS x2, coalesce(y.rank, {NEVER}) AS y, coalesce(y2.rank, {NEVER}) AS y2, (j.e IS NULL)::INT AS dead
                FROM (
                  SELECT w, g, p, t, n, lag(t) OVER o AS pt, lag(t, 2) OVER o AS ppt, lead(t) OVER o AS nt, lead(t, 2) OVER o AS nnt, lead(t, 3) OVER o AS nnnt, row_number() OVER o AS i
                  FROM bpe WHERE n < $rounds AND NOT done WINDOW o AS (PARTITION BY w, g ORDER BY p)
                ) AS s LEFT JOIN merges AS m ON m.l = s.t AND m.r = s.nt LEFT JOIN joined AS j ON j.e = s.t AND j.b = s.nt
                LEFT JOIN to_left AS x ON x.e = s.pt AND x.r = s.t LEFT JOIN to_left AS x2 ON x2.e = s.ppt AND x2.r = s.pt
                LEFT JOIN to_right AS y ON y.l = s.nt AND y.b = s.nnt LEFT JOIN to_right AS y2 ON y2.l = s.nnt AND y2.b = s.nnnt
              )
            ) WINDOW o AS (PARTITION BY w, g ORDER BY p)
          )
        )
      )
    )
  ) WHERE NOT used
)
SELECT w, NOT bool_and(done) AS more, list(t ORDER BY p) AS ids FROM bpe WHERE done OR n = $rounds GROUP BY w
"""
_DECODE = "SELECT d, string_agg(letters, '' ORDER BY p) AS s FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM rows) JOIN vocabulary USING (id) GROUP BY d"
#: Memory of a worker's DuckDB, and bytes a symbol takes in it: a longer word gets as much as it needs.
MEMORY_MB, PER_SYMBOL = 300, 600


class Encoder:
    """Encodes words with the merge table of a byte-level BPE file; remembers them up to a bound."""

    def __init__(self, folder: str, name: str):
        import duckdb
        import regex

        with open(os.path.join(folder, name), encoding="utf-8") as f:
            tokenizer = json.load(f)
        model = tokenizer["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.split = regex.compile(_pattern(tokenizer)).findall
        letters = _byte_letters()
        byte = {c: i for i, c in enumerate(letters)}
        self.bytes_of = str.maketrans({c: chr(i) for c, i in byte.items()})
        self.of_byte = np.array([ids[c] for c in letters], dtype=np.int32)
        # Nothing is spilled: symbols are taken in bounded portions, and no folder of one machine is needed.
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self._table("merges", {
            "l": pa.array([ids[a] for a, _ in pairs], pa.int32()), "r": pa.array([ids[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()), "made": pa.array([ids[a + b] for a, b in pairs], pa.int32()),
        })
        # Only where every merge of a token comes after those that make it, as trained ones do, are pairs contracted out of turn.
        made = {ids[a + b]: rank for rank, (a, b) in enumerate(pairs)}
        self.ordered = len(made) == len(pairs) and all(max(made.get(ids[a], -1), made.get(ids[b], -1)) < rank for rank, (a, b) in enumerate(pairs))
        self._table("vocabulary", {"id": pa.array(list(ids.values()), pa.int32()), "letters": pa.array(list(ids), pa.string())})
        self.ids, self.pairs, self.has_long = ids, pairs, False
        self.known: dict[str, list[int]] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("columns_in", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM columns_in")
        self.db.unregister("columns_in")

    def _long_tables(self) -> None:
        """For each token that ends (begins) another one: the least rank at which that other one takes a right (left)
        neighbour, and the tokens between which a merge can ever join."""
        ends, begins, both = [], [], set()
        for rank, (a, b) in enumerate(self.pairs):
            of_a, of_b = ([self.ids[x] for x in xs if x in self.ids] for xs in ((a[i:] for i in range(len(a))), (b[:i] for i in range(1, len(b) + 1))))
            ends += [(e, self.ids[b], rank) for e in of_a]
            begins += [(self.ids[a], x, rank) for x in of_b]
            both.update((e, x) for e in of_a for x in of_b)
        for name, columns, rows in (("to_left", ("e", "r"), ends), ("to_right", ("l", "b"), begins)):
            self._table("rows_in", dict(zip((*columns, "rank"), (pa.array(c, pa.int32()) for c in zip(*rows)))))
            self.db.execute(f"CREATE TABLE {name} AS SELECT {', '.join(columns)}, min(rank) AS rank FROM rows_in GROUP BY ALL")
            self.db.execute("DROP TABLE rows_in")
        self._table("joined", dict(zip("eb", (pa.array(c, pa.int32()) for c in zip(*both)))))

    def learn(self, words: list[str]) -> None:
        """Encodes new words, a bounded number of symbols at a time; long ones in their own queries."""
        for own, long in (([w for w in words if len(w) <= LONG], False), ([w for w in words if len(w) > LONG], True)):
            part: list[str] = []
            symbols: list[np.ndarray] = []
            n = 0
            for w in own:
                t = self.of_byte[np.frombuffer(w.encode(), np.uint8)]
                if n + len(t) > SYMBOLS and part:
                    self._encode(part, symbols, long)
                    part, symbols, n = [], [], 0
                part.append(w)
                symbols.append(t)
                n += len(t)
            if part:
                self._encode(part, symbols, long)

    def _encode(self, words: list[str], symbols: list[np.ndarray], long: bool) -> None:
        if long and not self.has_long:
            self._long_tables()
            self.has_long = True
        todo = list(range(len(words)))
        while todo:
            sizes = np.array([len(symbols[i]) for i in todo])
            n = int(sizes.sum())
            rounds = max(1, min(ROUNDS, ROUNDS * SYMBOLS // max(n, 1)))
            self.db.execute(f"SET memory_limit = '{max(MEMORY_MB, n * PER_SYMBOL >> 20)}MB'")
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.db.register("symbols", pa.table({"w": np.repeat(np.array(todo, np.int32), sizes), "p": (np.arange(n) - starts).astype(np.int32), "t": np.concatenate([symbols[i] for i in todo]).astype(np.int32)}))
            given = {"rounds": rounds} | ({"ordered": self.ordered} if long else {})
            got = self.db.sql(_ENCODE_LONG if long else _ENCODE, params=given).to_arrow_table()
            self.db.unregister("symbols")
            again = []
            for w, more, ids in zip(*(got.column(c).to_pylist() for c in ("w", "more", "ids"))):
                if not more:
                    self.known[words[w]] = ids
                else:
                    symbols[w] = np.array(ids, np.int32)
                    again.append(w)
            todo = again

    def decode(self, ids: pa.ListArray) -> list[str | None]:
        """Texts of lists of ids; null stays null, no ids give the empty text. Ids that aren't in the vocabulary are an error."""
        out: list[str | None] = ["" if valid else None for valid in ids.is_valid().to_pylist()]
        self.db.register("rows", pa.table({"d": np.arange(len(ids), dtype=np.int32), "ids": ids}))
        for d, s in self.db.sql(_DECODE).fetchall():
            out[d] = s.translate(self.bytes_of).encode("latin-1").decode("utf-8", "replace")
        self.db.unregister("rows")
        return out


def _pattern(tokenizer: dict) -> str:
    """The pattern that splits texts before merging: the one the tokenizer's file names, or the one of byte-level files that name none."""
    for step in tokenizer["pre_tokenizer"].get("pretokenizers", [tokenizer["pre_tokenizer"]]):
        if "Regex" in (pattern := step.get("pattern", {})):
            return pattern["Regex"]
    return PATTERN


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(256)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str, name: str) -> Encoder:
    """One per worker process; what it has learnt serves the later tasks of that worker too."""
    if (folder, name) not in _encoders:
        _encoders[folder, name] = Encoder(folder, name)
    return _encoders[folder, name]


def _ids(folder: str, name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, 256)
                at += part.num_rows
                ids = encode_batch(encoder(folder, name), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return encode


def encode_batch(e: Encoder, texts: list[str | None]) -> pa.ListArray:
    """New words of the whole batch are encoded in one go."""
    words = [e.split(t) if t else [] for t in texts]
    known = e.known
    new = {w for ws in words for w in ws if w not in known}
    if new:
        if len(known) + len(new) > REMEMBERED:
            e.known = known = {}
            new = {w for ws in words for w in ws}
        e.learn([*new])
    flat: list[int] = []
    offsets = [0]
    for ws in words:
        for w in ws:
            flat += known[w]
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, ids``: one row for each row of ``documents``, the token ids of its text without special tokens.

    A null or empty text has the empty list of ids, never null. Strings that look like special tokens are text.
    Whole texts are encoded, of whatever length. Other columns are ignored; an empty table gives no rows.
    """
    ship(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_ids(folder, name), "doc_id long, ids array<int>")


def texts(token_ids: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, text``: the texts that rows ``doc_id, ids`` encode; no ids give the empty text, null ids null."""
    ship(token_ids.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder(folder, name).decode(part.column(1)), pa.string())], names=["doc_id", "text"])

    return token_ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def _counts(folder: str, name: str, column: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            at, counts = 0, []
            while at < b.num_rows:
                part = b.slice(at, 256)
                at += part.num_rows
                counts += np.diff(encode_batch(e, part.column(column).to_pylist()).offsets.to_numpy()).tolist()
            keep = [i for i in range(b.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(counts, pa.int64())], names=[*(b.schema.names[i] for i in keep), "tokens"])

    return count


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.json") -> DataFrame:
    """The columns of ``documents`` with ``text`` replaced by its number of ``tokens``, 0 for null and empty texts."""
    ship(documents.sparkSession)
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in documents.columns if c != "text"), "tokens long"])
    return documents.mapInArrow(_counts(folder, name, documents.columns.index("text")), schema)
