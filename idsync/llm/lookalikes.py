"""Texts that look the same and differ in characters, brought to one form.

1. Compatibility normalisation, deletion of ignorable characters, one kind of blank and hyphen.
2. Each letter that has look-alikes in other scripts opens a lattice of alternatives; the
   best path (Viterbi) under character bigram scores of single-script tokens, with a price
   for a change of script inside a token, becomes the written form.

The bigrams are counted by Spark over all texts; only pairs with a look-alike letter matter,
which bounds the table by (letters of the lattice) x (letters of three scripts).

Two tokens with the same classes of look-alikes have the same lattice and so the same form;
a form determines the classes. Equal forms hence mean equal looks, whatever the scores are.

Defined results: null stays null; a text without any visible character becomes empty; letter
case and accents are kept; runs of blanks are not shortened.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsync.runtime import cut, ship

# Latin letters with the Cyrillic and Greek letters that look like them.
LOOKALIKES = (
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", "Ϲ"), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"), ("J", "Ј", "Ϳ"), ("K", "К", "Κ"),
    ("M", "М", "Μ"), ("N", "", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"), ("S", "Ѕ", ""), ("T", "Т", "Τ"), ("X", "Х", "Χ"), ("Y", "Ү", "Υ"), ("Z", "", "Ζ"),
    ("a", "а", ""), ("c", "с", "ϲ"), ("d", "ԁ", ""), ("e", "е", ""), ("h", "һ", ""), ("i", "і", ""), ("j", "ј", "ϳ"), ("l", "ӏ", ""), ("o", "о", "ο"),
    ("p", "р", ""), ("q", "ԛ", ""), ("s", "ѕ", ""), ("v", "ѵ", "ν"), ("w", "ԝ", ""), ("x", "х", ""), ("y", "у", ""),
)
CLASSES = {letter: tuple(x for x in row if x) for row in LOOKALIKES for letter in row if letter}
SWITCH = -12.0
_IGNORED = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def compatible(text: str) -> str:
    """Compatibility form without ignorable characters; one blank, one hyphen; composed."""
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    kept = []
    for c in unicodedata.normalize("NFKC", _IGNORED.sub("", text)):
        kind = unicodedata.category(c)
        if kind[0] == "Z" or c in "\t\n\r\x0b\x0c\x85":
            kept.append(" ")
        elif kind == "Pd" or c == "−":
            kept.append("-")
        elif kind not in ("Cf", "Cc"):
            kept.append(c)
    return unicodedata.normalize("NFC", "".join(kept)).strip(" ")


@lru_cache(maxsize=20_000)
def script(letter: str) -> str:
    name = unicodedata.name(letter, "?")
    return name.split(" ", 1)[0]


class Lattice:
    """Viterbi over look-alikes with smoothed bigram scores."""

    def __init__(self, bigrams: dict[str, int]):
        self.bigrams = bigrams
        self.first: dict[str, int] = {}
        for pair, n in bigrams.items():
            self.first[pair[0]] = self.first.get(pair[0], 0) + n
        self.words: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        score = math.log((self.bigrams.get(a + b, 0) + 0.1) / (self.first.get(a, 0) + 10))
        return score + (SWITCH if a != "^" and script(a) != script(b) else 0.0)

    def word(self, word: str) -> str:
        """The best path through one word in decomposed form."""
        letters = [c for c in word if not unicodedata.combining(c)]
        if not any(c in CLASSES for c in letters):
            return word
        paths = {"^": (0.0, "")}
        for c in letters:
            paths = {
                b: max((s + self.step(a, b), p + b) for a, (s, p) in paths.items()) for b in CLASSES.get(c, (c,))
            }
        chosen = iter(max(paths.values())[1])
        return "".join(c if unicodedata.combining(c) else next(chosen) for c in word)

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        open_ = unicodedata.normalize("NFD", text)

        def best(m: re.Match) -> str:
            w = m.group()
            if (found := self.words.get(w)) is None:
                if len(self.words) > 50_000:
                    self.words.clear()
                found = self.words[w] = self.word(w)
            return found

        return unicodedata.normalize("NFC", _WORD.sub(best, open_))


def _map_text(fn) -> object:
    @F.pandas_udf(T.StringType())
    def mapped(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            seen = {x: fn(x) for x in s.dropna().unique()}
            yield s.map(seen).where(s.notna(), None)

    return mapped


compatible_text = _map_text(compatible)


def bigram_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """Counts of letter pairs with a look-alike letter in single-script words ("^" begins a word)."""
    words = texts.select(F.explode(F.split(F.regexp_replace(F.col(column), r"\p{M}", ""), r"[^\p{L}]+")).alias("w"))
    words = words.filter(F.col("w").rlike(r"^(\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+)$"))
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.concat(F.lit("^"), "w"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("pair"))
    kept = pairs.filter(F.substring("pair", 1, 1).isin(*CLASSES) | F.substring("pair", 2, 1).isin(*CLASSES))
    return {r.pair: r.n for r in kept.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


class Canonical:
    """The operator: fitted on texts, it gives the one form of any text column."""

    def __init__(self, spark: SparkSession, bigrams: dict[str, int]):
        self.spark, self.bigrams = spark, bigrams

    @classmethod
    def fit(cls, spark: SparkSession, frames: list[tuple[DataFrame, str]]) -> Canonical:
        """Counts over all rows of all frames."""
        ship(spark)
        texts = None
        for df, column in frames:
            one = df.select(compatible_text(F.col(column)).alias("t"))
            texts = one if texts is None else texts.unionByName(one)
        return cls(spark, bigram_counts(texts.filter("t is not null"), "t"))

    def form(self, column: Column | str) -> Column:
        bigrams = self.bigrams

        def fn(text: str) -> str:
            return _lattice(bigrams)(compatible(text))

        return _map_text(fn)(F.col(column) if isinstance(column, str) else column)


_LAST: list = [None, None]


def _lattice(bigrams: dict[str, int]) -> Lattice:
    """The lattice of this model in this worker, with the words it has seen."""
    if _LAST[0] is not bigrams:
        _LAST[:] = bigrams, Lattice(bigrams)
    return _LAST[1]


def same_looks(records: DataFrame, key: str, blocks: list[str], text: str, canonical: Canonical) -> DataFrame:
    """(id_1, id_2): records of one block whose texts differ as stored and look the same.

    Distinct texts are paired first; copies of one text are expanded only for the result.
    """
    base = cut(records.select(F.col(key).alias("id"), *blocks, F.col(text).alias("t"), canonical.form(text).alias("form")).dropna())
    texts = base.select(*blocks, "form", "t").distinct()
    groups = texts.groupBy(*blocks, "form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    mixed = base.join(groups, [*blocks, "form"], "left_semi")
    names = mixed.select(*blocks, "form", "t").distinct()
    pairs = names.withColumnRenamed("t", "a").join(names.withColumnRenamed("t", "b"), [*blocks, "form"]).filter("a < b").select(*blocks, "a", "b")
    left = mixed.select(*blocks, F.col("t").alias("a"), F.col("id").alias("i"))
    right = mixed.select(*blocks, F.col("t").alias("b"), F.col("id").alias("j"))
    return pairs.join(left, [*blocks, "a"]).join(right, [*blocks, "b"]).select(F.least("i", "j").alias("id_1"), F.greatest("i", "j").alias("id_2"))
