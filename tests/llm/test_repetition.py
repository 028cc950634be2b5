import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idsync.llm.repetition import banded, perplexities, repeated_share, repetitive, words


def brute_share(text):
    s = "".join(c for c in text.lower() if c.isalpha())
    marked = set()
    for i in range(len(s) - 19):
        if s.find(s[i : i + 20]) < i:
            marked |= set(range(i, i + 20))
    return len(marked) / len(s) if s else 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["abcdefghij", "klmnopqrst", "uvwxyz", " 12 ", "Éa"]), max_size=14).map("".join))
def test_share_against_brute_force(text):
    assert repeated_share(text) == pytest.approx(brute_share(text))


def test_words():
    assert words("Ab-c 12 日本 한글") == ["ab", "c", "日", "本", "한", "글"] and words(None) == [] and words("x" * 21) == ["x"] * 21


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows = [(i, sentence(rnd, 60), "en" if i % 2 else None) for i in range(80)]
    for i in range(80, 88):
        passage = sentence(rnd, 8)
        rows.append((i, sentence(rnd, 10) + " " + " ".join([passage] * 6), "en"))
    return [*rows, (90, None, "en"), (91, "", "en"), (92, "12 34", "en"), (93, "one", "en"), (94, "ha" * 400, "en"), (0, rows[0][1], None)]


def test_found(spark, corpus):
    df = spark.createDataFrame([(*r, 1.0) for r in corpus], "doc_id long, text string, lang string, perplexity double")
    wanted = sorted(i for i, t, _ in corpus if brute_share(t or "") >= 1 / 3)
    assert sorted(r.doc_id for r in repetitive(df, "doc_id", "text", "lang").collect()) == wanted == [*range(80, 88), 94]
    bands = {r.doc_id: r.band for r in banded(df, "doc_id", "text", "lang").collect()}
    assert 90 not in bands and 92 not in bands and all(bands[i] == "low" for i in range(80, 88))
    assert repetitive(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_model_against_direct_counts(spark):
    """Perplexities of a tiny corpus against Kneser-Ney written out over tuples, the highest order per document."""
    import math
    from collections import Counter

    texts = {1: "a b a b c a b a b", 2: "b a b c a", 3: "c", 4: "a b a b a b a b a b"}
    n = 4
    streams = {d: ["<s>"] * (n - 1) + t.split() for d, t in texts.items()}
    own = {d: Counter(tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s))) for d, s in streams.items()}
    counts = {n: {g: 1 for c in own.values() for g in c}}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(values):
        m = Counter(min(x, 5) for x in values)
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + m[2] else 0.5
        return [min(0.99 * j, max(0.01, j - (j + 1) * y * m[j + 1] / m[j])) if m[j] else 0.5 * j for j in (1, 2, 3)]

    def level(table, d, gram, lower):
        same = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        freed = sum(d[min(c, 3) - 1] for c in same)
        return max(table[gram] - d[min(table[gram], 3) - 1], 0) / sum(same) + freed / sum(same) * lower

    d = {k: discounts(counts[k].values()) for k in range(1, n)}
    top = discounts([c for table in own.values() for c in table.values()])

    def p(doc, gram):
        value = 1 / len(counts[1])
        for k in range(1, n):
            value = level(counts[k], d[k], gram[-k:], value)
        return level(own[doc], top, gram, value)

    wanted = {doc: math.exp(-sum(math.log(p(doc, tuple(s[i - n + 1 : i + 1]))) for i in range(n - 1, len(s))) / (len(s) - n + 1)) for doc, s in streams.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc: r.perplexity for r in perplexities(df, "doc_id", "text").collect()} == pytest.approx(wanted)
