"""Repetition inside documents, found by n-gram perplexity.

A modified Kneser-Ney model of order 4 over 64-bit word hashes. The lower orders are counted by
Spark over all texts; the highest order is counted per document, so a text that repeats itself
predicts itself and its perplexity falls far below what is usual in its language, however
large the corpus. Per language, documents under ``low`` or over ``high`` times the median are
rejected. As language labels may be wrong, the lower limit of a language is never below that
of the corpus as a whole.

The n-grams of a document are reduced to distinct ones with their counts, and those of their
contexts, before anything moves. The lower orders are counted on distinct n-grams, combined
before the shuffle, so copies of a text add nothing to them, and are kept as a table of
sorted word hashes (a Parquet table per run, sorted inside its files). Documents meet it in one equi-join, where a hot n-gram is only hot on the
side of the documents and adaptive execution splits it.

The share of repeated content is then measured exactly on the rejected documents: letters
that lie in a second or later copy of a passage of 20 letters or more.

Words are runs of letters, lower-cased; letters of scripts without blanks, and runs of over 20
letters, count singly. Defined results: null texts and texts without letters have no perplexity
and are not rejected; a null language is a language of its own; repeated rows count as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsync.llm.bpe import slices
from idsync.runtime import cut, scratch, ship

ORDER = 4
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]|\p{L}[\p{L}\p{M}]*")
_SINGLE = regex.compile(r"\p{L}")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if all(len(w) <= 20 for w in found):
        return found
    return [x for w in found for x in (_SINGLE.findall(w) if len(w) > 20 else (w,))]


_NO_LETTER = re.compile(r"[\W\d_]+")


def _letters(text: str | None) -> str:
    plain = _NO_LETTER.sub("", text.lower()) if text else ""
    return plain if not plain or plain.isalpha() else "".join(filter(str.isalpha, plain))


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of the given ones."""
    x = values.astype("uint64") + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` values, from those of runs half as long."""
    base = 0xD6E8FEB86659FD93
    done, length, grown, step = None, 0, _mixed(values), 1
    while True:
        if size & step:
            n = len(values) - length - step + 1
            done = grown[:n].copy() if done is None else done[:n] * np.uint64(pow(base, step, 1 << 64)) + grown[length : length + n]
            length += step
        if length == size:
            return _mixed(done)
        grown = grown[: len(grown) - step] * np.uint64(pow(base, step, 1 << 64)) + grown[step:]
        step *= 2


def repeated_share(text: str | None, passage: int = 20) -> float:
    """The share of a text's letters that lie in a second or later copy of a passage of ``passage`` letters or more."""
    letters = _letters(text)
    n = len(letters)
    if n <= passage:
        return 0.0
    hashes = _windows(np.frombuffer(letters.encode("utf-32-le"), "uint32"), passage)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[group] < np.arange(len(hashes)))
    change = np.zeros(n + 1, "int64")
    np.add.at(change, again, 1)
    np.add.at(change, again + passage, -1)
    return float((np.cumsum(change[:n]) > 0).sum()) / n


def _counted(row: list[int]) -> tuple[np.ndarray, ...]:
    """Distinct 4-grams of one document (their hash and last three words) with their counts, those of their contexts, and how many n-grams of count 1, 2 and more follow the context."""
    padded = np.array([0] * (ORDER - 1) + row, "int64")
    whole, context = _windows(padded.view("uint64"), ORDER), _windows(padded.view("uint64")[:-1], ORDER - 1)
    grams, first, n = np.unique(whole, return_index=True, return_counts=True)
    _, context = np.unique(context[first], return_inverse=True)
    per = lambda weight: np.bincount(context, weight)[context].astype("int32")
    return grams.view("int64"), padded[first + 1], padded[first + 2], padded[first + 3], n.astype("int32"), per(n), per(n == 1), per(n == 2), per(n >= 3)


def document_grams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, g, t2, t3, t4, n, b4, k40, k41, k42): the distinct 4-grams of each document as a hash and their last words as 64-bit hashes, with counts; 0 stands before the text."""
    ship(docs.sparkSession)
    names = ["doc", "g", "t2", "t3", "t4", "n", "b4", "k40", "k41", "k42"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        codes: dict[str, int] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                ids, parts = [], []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    row = []
                    for w in words(t):
                        if (c := codes.get(w)) is None:
                            if len(codes) > 100_000:
                                codes.clear()
                            c = codes[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) or 1
                        row.append(c)
                    if row:
                        parts.append(_counted(row))
                        ids.append(np.full(len(parts[-1][0]), doc, "int64"))
                if ids:
                    columns = [np.concatenate(p) for p in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(ids), *columns)], names=names)

    schema = "doc long, g long, t2 long, t3 long, t4 long, " + ", ".join(f"{c} int" for c in names[5:])
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).dropna().mapInArrow(run, schema)


def _discounts(counts: dict[int, int]) -> list[float]:
    """The modified discounts for counts of 1, 2 and 3 or more."""
    n = [counts.get(i, 0) for i in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    return [min(0.99 * j, max(0.01, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 * j for j in (1, 2, 3)]


def _count_of_counts(df: DataFrame, count: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(F.least(F.col(count), F.lit(5)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _probability(count: Column, total: Column, kinds: list[Column], d: list[float], lower: Column) -> Column:
    """Interpolated modified Kneser-Ney: the discounted share plus the freed mass times the lower order."""
    off = F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])
    freed = kinds[0] * d[0] + kinds[1] * d[1] + kinds[2] * d[2]
    return F.greatest(count - off, F.lit(0.0)) / total + freed / total * lower


def _kinds(count: str) -> list[Column]:
    hit = lambda c: F.when(c, 1).otherwise(0)
    return [hit(F.col(count) == 1), hit(F.col(count) == 2), hit(F.col(count) >= 3)]


def bigram_probabilities(triples: DataFrame) -> DataFrame:
    """(t3, t4, p2) by continuation counts; ``triples`` has each trigram t2, t3, t4 once."""
    two = cut(triples.groupBy("t3", "t4").agg(F.count(F.lit(1)).alias("c2")))
    one = cut(two.groupBy("t4").agg(F.count(F.lit(1)).alias("c1")))
    d1, d2 = _discounts(_count_of_counts(one, "c1")), _discounts(_count_of_counts(two, "c2"))
    size = one.agg(F.count(F.lit(1)).alias("v"), F.sum("c1").alias("s"), *(F.sum(k).alias(f"k{i}") for i, k in enumerate(_kinds("c1")))).first()
    if not size.v:
        return two.select("t3", "t4", F.lit(0.0).alias("p2"))
    p1 = one.select("t4", _probability(F.col("c1"), F.lit(float(size.s)), [F.lit(size[f"k{i}"]) for i in range(3)], d1, F.lit(1.0 / size.v)).alias("p1"))
    context = two.groupBy("t3").agg(F.sum("c2").alias("b2"), *(F.sum(k).alias(f"k{i}") for i, k in enumerate(_kinds("c2"))))
    all_ = two.join(context, "t3").join(p1, "t4")
    return all_.select("t3", "t4", _probability(F.col("c2"), F.col("b2"), [F.col(f"k{i}") for i in range(3)], d2, F.col("p1")).alias("p2"))


def trigram_probabilities(triples: DataFrame) -> DataFrame:
    """(t2, t3, t4, p3) by continuation counts ``c3``."""
    d3 = _discounts(_count_of_counts(triples, "c3"))
    context = triples.groupBy("t2", "t3").agg(F.sum("c3").alias("b3"), *(F.sum(k).alias(f"k{i}") for i, k in enumerate(_kinds("c3"))))
    all_ = triples.join(context, ["t2", "t3"]).join(bigram_probabilities(triples), ["t3", "t4"])
    return all_.select("t2", "t3", "t4", _probability(F.col("c3"), F.col("b3"), [F.col(f"k{i}") for i in range(3)], d3, F.col("p2")).alias("p3"))


def perplexities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, perplexity) of every document with a word, under the model with its own highest order."""
    spark = docs.sparkSession
    where = scratch(spark, "grams")
    document_grams(docs, key, text).write.parquet(f"{where}/documents")
    grams = spark.read.parquet(f"{where}/documents")
    types = grams.select("g", "t2", "t3", "t4").distinct()
    types.groupBy("t2", "t3", "t4").agg(F.count(F.lit(1)).alias("c3")).sortWithinPartitions("t2", "t3", "t4").write.parquet(f"{where}/triples")
    d4 = _discounts(_count_of_counts(grams, "n"))
    p4 = _probability(F.col("n"), F.col("b4"), [F.col(f"k4{i}") for i in range(3)], d4, F.col("p3"))
    triple = F.xxhash64("t2", "t3", "t4").alias("triple")
    lower = trigram_probabilities(spark.read.parquet(f"{where}/triples")).select(triple, "p3")
    scored = grams.select("doc", triple, "n", "b4", "k40", "k41", "k42").join(lower, "triple")
    scored = scored.select("doc", "n", F.log(p4).alias("lp")).groupBy("doc").agg(F.sum(F.col("n") * F.col("lp")).alias("s"), F.sum("n").alias("words"))
    return scored.select("doc", F.exp(-F.col("s") / F.col("words")).alias("perplexity"))


def banded(docs: DataFrame, key: str, text: str, language: str, low: float = 0.75, high: float = 4.0) -> DataFrame:
    """(key, language, perplexity, band) with band ``low``, ``high`` or ``inside`` its language's band."""
    scored = perplexities(docs, key, text)
    known = cut(docs.select(F.col(key).cast("long").alias("doc"), F.col(language).alias("language")).join(scored, "doc"))
    middle = known.groupBy("language").agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("m"))
    overall = known.agg(F.percentile_approx("perplexity", 0.5, 10_000)).first()[0] or 0.0
    joined = known.join(middle, known.language.eqNullSafe(middle.language)).drop(middle.language)
    band = F.when(F.col("perplexity") < low * F.greatest(F.col("m"), F.lit(overall)), "low").when(F.col("perplexity") > high * F.col("m"), "high").otherwise("inside")
    return joined.select(F.col("doc").alias(key), F.col("language").alias(language), "perplexity", band.alias("band"))


@F.pandas_udf(T.DoubleType())
def share_of_copies(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(repeated_share)


# Called non-deterministic so that the optimiser leaves it behind the join with the rejected documents.
share_of_copies = share_of_copies.asNondeterministic()


def repetitive(docs: DataFrame, key: str, text: str, language: str, least: float = 1 / 3) -> DataFrame:
    """(key, share) of the documents that the bands reject and whose repeated share is at least ``least``."""
    rejected = banded(docs, key, text, language).filter("band <> 'inside'").select(key)
    open_ = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text")).join(rejected, key, "left_semi")
    return open_.select(key, share_of_copies("_text").alias("share")).filter(F.col("share") >= least)
