"""Problem 9: visually identical text with different characters.

A transducer over grapheme clusters, compiled once from a precomputed mapping, rewrites widths, accents, spaces and
look-alikes in one pass, always taking the longest match. Which letters look alike is read from Unicode's data on
confusable characters, which the session's ICU library brings, less what a reader can tell apart. The mapping is checked
for conflicts when it is built: what it puts out is never rewritten again, so the form is unique and applying it twice
changes nothing. Texts of plain ASCII are their own form and never leave the JVM.
"""

from __future__ import annotations

import hashlib
import unicodedata as U
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.session import ship, tables, write_table

#: Scripts of which some letters have the shape of another script's. The letters of a script aren't merged with each other.
SCRIPTS = ("Greek", "Cyrillic", "Armenian", "Cherokee", "Coptic", "Lisu", "Tifinagh", "Deseret")
# Letters that Unicode calls confusable and a reader can tell from their prototype.
TOLD_APART = "ϒ Л \u03b1 γ \u03b9 κ \u03c1 ϱ \u03c3 τ \u03c5 ᴦ г ҽ ѡ ⲅ ꮁ ա գ զ ռ ք".split()
# Further letters of the same shape: Latin ones of another name, and those whose prototype is another letter of the same look.
SAME_LETTER = {"ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ӏ": "l", "ә": "ə"}
# Signs that differ in code only.
SAME_SIGN = {
    "µ": "μ", "\u2010": "-", "\u2011": "-", "\u2044": "/", "\u2215": "/",  # micro sign; hyphen, non-breaking hyphen; fraction slash, division slash
    "\r\n": "\n", "\r": "\n", "\x85": "\n", "\u2028": "\n", "\u2029": "\n",
}
# Blanks of any width.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# What shows nothing (first and last of each range).
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
#: Decompositions of these kinds are other forms of the same letter or blank. The others (raised, circled, fractions, fonts) can be told apart.
SAME_KIND = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


#: What may follow a picture: the mark that asks for colour, and the tones of skin.
TONES = "\ufe0f" + "".join(map(chr, range(0x1F3FB, 0x1F400)))
#: Meetings of documents of one form that a task takes; a form with more is salted.
MEETINGS = 1_000_000
#: Where a text isn't plain ASCII that is its own form.
FOREIGN = r"[^\x00-\x7F]|\r"


@lru_cache(1)
def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of SCRIPTS to the prototype that Unicode's data gives their look, as far as no reader can tell them apart."""
    letters = [c for n in range(0x370, 0x110000) if not 0xAC00 <= n < 0xE000 and U.category(c := chr(n)) in ("Lu", "Ll", "Lo") and regex.match(rf"[{''.join(rf'\p{{Script={x}}}' for x in SCRIPTS)}]", c)]
    letters = [c for c in letters if not U.decomposition(c) and c not in TOLD_APART]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out = {}
    for c, x in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")):
        if U.category(c) != "Ll" and x == "l":
            x = "I"  # the data has one prototype for capital I and small l
        if x != c and len(x) == 1 and U.category(x) == ("Ll" if U.category(c) == "Ll" else "Lu") and (x.isascii() or x.isupper()):
            if x not in "ij" or regex.match(r"\p{Soft_Dotted}", c):  # a missing dot can be seen
                out[c] = x
    return out


@lru_cache(1)
def mapping(spark: SparkSession) -> dict[str, str]:
    """Single characters to their one form; built by rule from the character database, Unicode's confusables and the fixed values above."""
    out: dict[str, str] = {}
    for n in range(0x80, 0x110000):
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7B0:
            continue
        c = chr(n)
        kind, *codes = U.decomposition(c).split() or [""]
        joined = kind == "<compat>" and (U.category(c) == "Nl" or U.category(c)[0] == "L" and sum(U.category(x)[0] == "L" for x in U.normalize("NFKD", c)) > 1)
        if kind in SAME_KIND or joined:  # other widths and places of a letter; digraphs, ligatures and numerals made of letters
            out[c] = "".join(chr(int(x, 16)) for x in codes)
    out |= confusables(spark) | SAME_LETTER | SAME_SIGN | {c: " " for c in BLANKS}
    for a, b in INVISIBLE:
        for n in range(a, b + 1):
            out[chr(n)] = ""
    # Conflict check: follow the mapping until nothing changes; a cycle would be two forms for one look.
    for c in out:
        seen, now = {c}, out[c]
        while (then := "".join(out.get(x, x) for x in now)) != now:
            if then in seen:
                raise ValueError(f"the mapping of {c!r} has no end")
            seen.add(then)
            now = then
        out[c] = now
    return out


class Transducer:
    """States of a trie over all that the mapping rewrites, walked by each grapheme cluster; the longest match is put out."""

    def __init__(self, rewrites: dict[str, str]):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        for source, target in rewrites.items():
            state = 0
            for c in source:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.out.append(None)
                state = self.next[state][c]
            self.out[state] = target
        mark, silent = r"\p{M}\uff9e\uff9f", r"\u00ad\u200b-\u200f\u2060\ufeff"
        # A cluster, also where silent characters part a letter from its marks.
        self.clusters = regex.compile(rf"\X(?:[{silent}]+[{mark}]+)*", regex.VERSION1).sub
        # Where a cluster can be rewritten: plain ASCII is its own form but for a letter that carries a mark and for carriage returns.
        self.stretch = regex.compile(r"[!-~]?[^\x00-\x7f]+|\r\n?").sub
        shaping = "".join(rf"\p{{Script={x}}}" for x in ("Arabic", "Syriac", "Devanagari", "Bengali", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala"))
        self.shaped = regex.compile(rf"[{shaping}]\p{{M}}*[\u200c\u200d]").fullmatch
        self.picture = regex.compile(r"\p{Extended_Pictographic}").match
        self.known: dict[str, str] = {}

    def _stretch(self, m) -> str:
        x = m[0]
        got = self.known.get(x)
        if got is None:
            got = self.clusters(self._cluster, x)
            if len(x) <= 32 and len(self.known) < 200_000:
                self.known[x] = got
        return got

    def _cluster(self, m) -> str:
        c = m[0]
        if len(c) > 1:
            if "\u200d" in c and self.picture(c) and self.picture(c.rstrip(TONES)[-1]):  # a joined emoji stays whole
                return c.replace("\ufe0f", "")
            if self.shaped(c) and m.end() < len(m.string) and m.string[m.end()].isalpha():  # a joiner that shapes letters stays
                return U.normalize("NFC", c)
            return U.normalize("NFC", self.walk(U.normalize("NFD", c)))
        if (got := self.walk(c)) != c or c.isascii():
            return got
        return U.normalize("NFC", self.walk(U.normalize("NFD", c)))

    def walk(self, text: str) -> str:
        put, at = [], 0
        while at < len(text):
            state, end, best, upto = 0, at, text[at], at + 1
            while end < len(text) and (then := self.next[state].get(text[end])) is not None:
                state, end = then, end + 1
                if self.out[state] is not None:
                    best, upto = self.out[state], end
            put.append(best)
            at = upto
        return "".join(put)

    def __call__(self, text: str) -> str:
        """The one form of a text."""
        return text if text.isascii() and "\r" not in text else self.stretch(self._stretch, text)


_compiled: tuple[dict[str, str], Transducer] | None = None


def transducer(rewrites: dict[str, str]) -> Transducer:
    """Compiled once per worker process."""
    global _compiled
    if _compiled is None or _compiled[0] != rewrites:
        _compiled = rewrites, Transducer(rewrites)
    return _compiled[1]


def one_form(spark: SparkSession) -> Callable[[str | None], str | None]:
    """Texts to their one form; null stays null."""
    own = transducer(mapping(spark))
    return lambda text: None if text is None else own(text)


def _foreign(text: Column) -> Column:
    return text.rlike(FOREIGN)


def _digest(x: str) -> bytes:
    return hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _keys(rewrites: dict[str, str]):
    """Over ``doc_id, text, plain``: digests of a text's form and of the text, those of plain ASCII as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = transducer(rewrites)
        for b in batches:
            ids, forms, texts = [], [], []
            for i, t, plain in zip(*(b.column(x).to_pylist() for x in range(3))):
                if plain is not None:
                    ids.append(i), forms.append(plain), texts.append(plain)
                elif t and (f := form(t)).strip():
                    ids.append(i), forms.append(_digest(f)), texts.append(_digest(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "form", "text"])

    return run


def unified(documents: DataFrame) -> DataFrame:
    """``doc_id, form``: every text in its one form; null texts stay null, empty ones empty."""
    spark = documents.sparkSession
    ship(spark)
    rewrites = mapping(spark)

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        own = transducer(rewrites)
        return texts.map(lambda t: None if t is None else own(t))

    text = F.col("text")
    return documents.select("doc_id", F.coalesce(form(F.when(_foreign(text), text)), text).alias("form"))


def _digests(documents: DataFrame) -> DataFrame:
    """``doc_id, form, text``: 128-bit digests of the forms and texts that show something, where a form has several texts."""
    spark = documents.sparkSession
    ship(spark)
    text = F.col("text")
    plain = F.when(~_foreign(text) & text.rlike(r"[^\s\x1c-\x1f]"), F.unhex(F.md5(text)))
    rows = documents.select("doc_id", F.when(_foreign(text), text).alias("text"), plain.alias("plain"))
    keys = write_table(rows.mapInArrow(_keys(mapping(spark)), "doc_id long, form binary, text binary"), "forms").df
    several = keys.groupBy("form").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count("*").alias("n")).where("a <> b").select("form", "n")
    return keys.join(several, "form")


def look_alikes(documents: DataFrame) -> DataFrame:
    """``doc_a, doc_b`` (the smaller first): documents that look the same but aren't equal character by character.

    Texts that show nothing (null, empty, blanks, invisible characters) are in no pair; equal texts make no pair with
    each other. A form of very many documents is joined in parts, by salts of its documents. :func:`look_classes` has the
    same result in one row per document.
    """
    with tables() as kept:
        met = write_table(_digests(documents).distinct(), "met")
        kept.append(met)
    salts = F.ceil(F.col("n") * F.col("n") / MEETINGS)
    a = met.df.select("form", F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a"), F.pmod(F.xxhash64("doc_id"), salts).alias("salt"))
    b = met.df.select("form", F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return a.join(b, ["form", "salt"]).where("doc_a < doc_b and text_a <> text_b").select("doc_a", "doc_b")


def look_classes(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, same_text``: of every document that looks like another of a different text, the least document of
    that look and the least one of exactly its text: whatever the sizes of the groups, one row per document."""
    with tables() as kept:
        met = write_table(_digests(documents), "met")
        kept.append(met)
    looks, texts = (met.df.groupBy(*by).agg(F.min("doc_id").alias(name)) for by, name in ((["form"], "class_id"), (["form", "text"], "same_text")))
    return met.df.join(looks, "form").join(texts, ["form", "text"]).select("doc_id", "class_id", "same_text")
