"""Variant spellings of names of people and teams, linked inside blocks.

Candidates come from a prefix-filtered set-similarity join: every spelling is the set of
q-grams of its tokens, from the rarest on; two sets that share the fraction ``overlap`` of
the smaller one must share a gram of the smaller one's prefix, so only prefixes are joined
with full sets, keyed by block and gram, and the pairs found are held to the overlap. A
nickname is a second set of its unit in the same join; the best overlap of name and nickname counts. Short names
with an initial or a slip may share no gram at all, so the attributes named in ``exact`` are second
keys: units of one block with an equal value are candidates whatever their grams. Verification is a
soft weighted token similarity: tokens are paired one to one by equality, initial, short form, spelling
habits or edit distance, and weigh by the log of their rarity among all spellings.

A source's records of one id are one unit of evidence; supporting attributes (birth date,
shirt number, country) add to or take from a pair's score. Two ids of one source
in a block are taken for different things. Per unit and other source only mutual best
pairs count, and links through a third source are followed once.

Nothing is capped: a frequent gram only costs join rows inside its block, where prefixes
seldom reach it.

Defined results: null or empty names, null blocks, sources or source ids link nothing; repeated rows are units of one id;
pairs that look alike (equal canonical forms) are left out; missing attributes are neutral, and a deviating team,
gender or age group only weighs against a pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idsync.runtime import cut, ship

# Common short forms of given names, by full name.
SHORT_FORMS = {
    "alexander": ("alex", "sasha", "sandy", "xander"), "aleksandr": ("sasha", "alex"), "alexandra": ("sasha", "alex", "sandra"),
    "anastasia": ("nastya", "ana", "stasia"), "andrew": ("andy", "drew"), "anthony": ("tony",), "antonio": ("toni", "tono", "antonito"),
    "benjamin": ("ben", "benji"), "catherine": ("cathy", "kate", "katie"), "charles": ("charlie", "chuck"), "charlotte": ("charlie", "lotte"),
    "christopher": ("chris", "topher"), "daniel": ("dan", "danny", "dani"), "david": ("dave", "davy"), "dmitri": ("dima", "mitya"), "dolores": ("lola",),
    "eduardo": ("edu", "lalo"), "edward": ("ed", "eddie", "ted"), "elizabeth": ("liz", "beth", "lizzie", "betty", "eliza"), "enrique": ("quique", "kike"),
    "francisco": ("paco", "pancho", "fran", "kiko", "curro"), "giovanni": ("gianni", "nino", "vanni"), "giuseppe": ("beppe", "peppe"), "guillermo": ("memo", "guille"),
    "henry": ("harry", "hank"), "ignacio": ("nacho",), "isabel": ("isa", "bel"), "ivan": ("vanya",), "jacob": ("jake",), "james": ("jim", "jimmy", "jamie"),
    "jesus": ("chucho", "chus"), "john": ("johnny", "jack"), "jonathan": ("jon", "jonny"), "jose": ("pepe", "chepe"), "joseph": ("joe", "joey"), "katherine": ("kate", "kathy", "katie"),
    "luis": ("lucho",), "manuel": ("manolo", "manu"), "margaret": ("maggie", "peggy", "meg"), "maria": ("mari", "masha", "mia"), "matthew": ("matt",), "mercedes": ("merche",),
    "michael": ("mike", "mick", "micky"), "mikhail": ("misha",), "natalia": ("natasha",), "nicholas": ("nick", "nico"), "nikolai": ("kolya",), "patricia": ("pat", "patty", "trish"),
    "pedro": ("perico",), "rafael": ("rafa",), "rebecca": ("becky", "bex"), "richard": ("rick", "dick", "rich", "ricky"), "robert": ("bob", "rob", "bobby", "robbie", "bert"),
    "roberto": ("beto",), "rosario": ("charo",), "samuel": ("sam",), "sebastian": ("seb", "bastian", "basti"), "sergei": ("seryozha",), "stephen": ("steve",), "theodore": ("ted", "theo", "teddy"),
    "thomas": ("tom", "tommy"), "vicente": ("chente",), "victoria": ("vicky", "tori"), "vladimir": ("vova", "volodya", "vlad"), "william": ("bill", "will", "billy", "liam"), "yekaterina": ("katya",),
}
# Additions to a name that don't tell people or clubs apart.
NOISE = {"jr", "sr", "ii", "iii", "iv", "gk", "c", "junior"}
CLUB_NOISE = {"fc", "sc", "cf", "rc", "ac", "sk", "wfc", "lfc", "club", "women", "womens", "ladies", "w", "u", "under", "sub", "s"}
# Spelling habits that sound alike, applied in order.
SOUNDS = (
    ("ph", "f"), ("sch", "sh"), ("tch", "ch"), ("ck", "k"), ("th", "t"), ("ks", "x"), ("yeo", "yu"), ("eo", "u"), ("ou", "u"), ("oo", "u"), ("ae", "e"), ("ai", "e"), ("ie", "i"),
    ("ee", "i"), ("y", "i"), ("w", "v"), ("c", "k"), ("q", "k"), ("z", "s"), ("j", "i"), ("g", "k"), ("d", "t"), ("b", "p"),
)
_SPLIT = re.compile(r"[^\w]+|_+|(?<=[a-zа-яё])(?=[А-ЯЁ])", re.UNICODE)
# Latin letters without a decomposition.
PLAIN = str.maketrans({"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "ı": "i", "ħ": "h", "þ": "th", "ð": "d"})


def tokens_of(form: str | None, club: bool = False) -> list[str]:
    """Lower-case tokens of a canonical form without accents and noise words."""
    if not form:
        return []
    text = re.sub(r"\([^)]*\)", " ", form) if not club else form
    text = text.translate(PLAIN).replace("'", "").replace("’", "")
    parts = [p for p in _SPLIT.split(text) if p]
    flat = ["".join(c for c in unicodedata.normalize("NFD", p.lower()) if not unicodedata.combining(c)) for p in parts]
    noise = CLUB_NOISE if club else NOISE
    kept = [t for t in flat if t not in noise and not (club and re.fullmatch(r"u?\d+", t))] if len(flat) > 1 else flat
    return kept or flat


@lru_cache(maxsize=60_000)
def sound(token: str) -> str:
    for a, b in SOUNDS:
        token = token.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", token)


@lru_cache(maxsize=60_000)
def _letters(text: str) -> int:
    """The set of letters as bits (letters that share a bit count as one)."""
    out = 0
    for c in text:
        out |= 1 << ord(c) % 61
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 beyond ``most``. Equal ends are skipped, and only cells near the diagonal are filled."""
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:  # an edit changes two letters of the set at most
        return most + 1
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while start < end_a and start < end_b and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        return len(a) + len(b)
    far = most + 1
    two, last = [], [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        row[0] = min(i, far)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, two[j - 2] + 1)
            row[j] = d if d < far else far
        if min(row) > most:
            return far
        two, last = last, row
    return last[-1]


@lru_cache(maxsize=60_000)
def token_similarity(a: str, b: str, club: bool) -> float:
    """How well one token stands for the other, 0 to 1."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.8 if b[0] == a and a.isalpha() else 0.0
    if a in SHORT_FORMS.get(b, ()) or b in SHORT_FORMS.get(a, ()):
        return 0.9
    if sound(a) == sound(b) and len(a) > 2:
        return 0.95
    most = 1 if len(b) < 5 else 2
    d = edits(a, b, most)
    if d <= most:
        return 1 - d / len(b) * (0.8 if a[0] == b[0] else 1.0)
    if club:
        if b.startswith(a) and len(a) >= 1:
            return 0.8
        if len(a) >= 2 and a[0] == b[0] and a[-1] == b[-1] and len(a) <= 3:
            return 0.7
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return 0.8 if common >= 5 and common >= 0.6 * len(b) else 0.0
    common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if common >= 3 and (common == len(a) or common >= len(a) - 1 and len(a) <= 6):
        return 0.8
    if common >= 2 and len(a) <= 4 and common >= len(a) - 2:
        return 0.65
    if len(a) >= 3 and b.endswith(a):
        return 0.75
    return 0.0


def name_similarity(a: list[str], b: list[str], wa: list[float], wb: list[float], club: bool) -> tuple[float, float]:
    """(similarity, conflict): matched weight over the lighter side, and weight left over on both sides."""
    if not a or not b:
        return 0.0, 0.0
    ja, jb = "".join(a), "".join(b)
    if ja == jb or ja == "".join(reversed(b)) or sorted(a) == sorted(b):
        return 1.0, 0.0
    options = sorted(((token_similarity(x, y, club), min(wa[i], wb[j]), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a, used_b, got, base = set(), set(), 0.0, 0.0
    for s, w, i, j in options:
        if s >= 0.6 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            heavy = w if len(a[i]) > 1 and len(b[j]) > 1 else 0.4 * max(wa[i], wb[j])
            got += s * heavy
            base += heavy
    left = sum(w for i, w in enumerate(wa) if i not in used_a)
    right = sum(w for j, w in enumerate(wb) if j not in used_b)
    conflict = min(left, right)
    similarity = got / (base + conflict) if base else 0.0
    if len(ja) >= 5 and abs(len(ja) - len(jb)) <= 2:
        for other in (jb, "".join(reversed(b))):
            d = edits(ja, other, 2)
            if d <= 2:
                similarity, conflict = max(similarity, 1 - d / len(ja)), 0.0
    return similarity, conflict / (conflict + base) if conflict + base else 1.0


@dataclass(frozen=True)
class Weights:
    """How similarity and evidence add up; evidence is (equal, different) per attribute."""

    conflict: float
    evidence: tuple[tuple[float, float], ...]
    accept: float
    least: float
    club: bool = False


PEOPLE = Weights(conflict=0.6, evidence=((0.45, -0.2), (0.25, -0.15), (0.0, -0.4)), accept=0.62, least=0.3)  # birth date, shirt, team
CLUBS = Weights(conflict=0.8, evidence=((0.25, -0.5), (0.05, -0.2), (0.0, -1.0), (0.0, -1.0)), accept=0.62, least=0.3, club=True)  # country, confederation, gender, age group


def _grams(tokens: Column, q: int) -> Column:
    """The hashes of all q-grams of the padded tokens, in one fixed order."""
    padded = F.transform(tokens, lambda t: F.concat(F.lit("^"), t, F.lit("$")))
    cuts = F.transform(padded, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - q + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(t, i, F.lit(q)))))
    return F.array_sort(F.array_distinct(F.flatten(cuts)))


BUCKETS = 1 << 16


def rarest_first(units: DataFrame, grams: str = "grams") -> Column:
    """``grams`` from the rarest on. Frequencies are counted over all units in a fixed number of hash buckets, so they fit the plan at any size."""
    bucket = lambda g: F.pmod(g, F.lit(BUCKETS)).cast("int")
    counts = np.zeros(BUCKETS, "int64")
    for r in units.select(F.explode(grams).alias("g")).groupBy(bucket(F.col("g")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.b] = r.n
    level = F.lit(np.minimum(8 * np.log2(1 + counts), 255).astype("uint8").tobytes())  # one byte per bucket
    order = F.transform(grams, lambda g: F.struct(F.substring(level, bucket(g) + 1, F.lit(1)).alias("n"), g.alias("g")))
    return F.transform(F.array_sort(order), lambda x: x.g)


def _least_shared(size: Column, overlap: float) -> Column:
    return F.ceil(size * overlap - 1e-9)


MATCHES = 3


def candidates(units: DataFrame, blocks: list[str], overlap: float) -> DataFrame:
    """(i, j): units of one block, of different sources, that may share ``overlap`` of the smaller gram set.

    ``units`` has uid, source, set (a number), grams and the block columns, a row for each set of a unit. Any order of grams
    that is the same in all sets makes a prefix of the smaller set meet the larger set; from the rarest on,
    few rows meet, also in a block of very many. The prefix is ``MATCHES`` grams longer than what an overlap of ``need`` leaves
    unmatched, so as many of its grams must meet. A gram is joined inside its block only; block and
    gram travel as one hash, and pairs of two blocks that a collision might make are left to :func:`score_pairs`.
    """
    size = F.size("grams")
    need = F.greatest(_least_shared(size, overlap).cast("int"), F.lit(1))
    few = F.least(need, F.lit(MATCHES))
    base = units.filter(size > 0).select(F.xxhash64(*blocks).alias("block"), "uid", F.xxhash64("source").alias("source"), "set", size.alias("size"), few.alias("few"), (size - need + few).alias("long"), "grams")
    rows = lambda grams: base.select("block", "uid", "source", "set", "size", "few", F.explode(grams).alias("gram")).withColumn("key", F.xxhash64("block", "gram"))
    side = lambda n, df: df.select("key", *(F.col(c).alias(f"{c}{n}") for c in ("uid", "set", "source", "size", "few")))
    smaller = (F.col("size1") < F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("uid1") < F.col("uid2")))
    met = side("1", rows(F.slice("grams", F.lit(1), F.col("long")))).hint("merge").join(side("2", rows(F.col("grams"))).drop("few2"), "key").filter(smaller & (F.col("source1") != F.col("source2")))
    pairs = met.groupBy("uid1", "set1", "uid2", "set2").agg(F.count(F.lit(1)).alias("n"), F.min("few1").alias("few")).filter("n >= few")
    return pairs.select(F.least("uid1", "uid2").alias("i"), F.greatest("uid1", "uid2").alias("j")).distinct()


def equal_marks(units: DataFrame, blocks: list[str], marks: list[str]) -> DataFrame:
    """(i, j): units of one block, of different sources, with an equal value in one of ``marks``; null equals nothing."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(m).alias("v")) for k, m in enumerate(marks)))).alias("x")
    rows = units.select(*blocks, "uid", "source", values).select(*blocks, "uid", "source", "x.k", "x.v").filter("v is not null")
    side = lambda n, df: df.select(*blocks, "k", "v", F.col("uid").alias(n), F.col("source").alias(f"source_{n}"))
    pairs = side("i", rows).join(side("j", rows), [*blocks, "k", "v"]).filter("i < j and source_i <> source_j")
    return pairs.select("i", "j").distinct()


def _tokens(club: bool):
    @F.pandas_udf("array<string>")
    def tokens(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            seen = {x: tokens_of(x, club) for x in s.dropna().unique()}
            yield s.map(lambda x: seen.get(x, []))

    return tokens


def _scores(weights: Weights):
    schema = "i long, j long, score double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for a, b, wa, wb, na, nb, *marks in zip(p.t1, p.t2, p.w1, p.w2, p.n1, p.n2, *(p[f"e{k}"] for k in range(len(weights.evidence)))):
                s, conflict = name_similarity(list(a), list(b), wa.tolist(), wb.tolist(), weights.club)
                if conflict and (len(na) or len(nb)):
                    for x, y in ((na, b), (a, nb), (na, nb)):
                        # one token of a nickname alone doesn't tie names that are unlike where no attribute agrees
                        if len(x) and len(y) and (min(len(x), len(y)) > 1 or s >= weights.least or 1 in marks):
                            s2, c2 = name_similarity(list(x), list(y), [1.0] * len(x), [1.0] * len(y), weights.club)
                            if s2 - c2 > s - conflict:
                                s, conflict = 0.95 * s2, c2
                extra = sum(e[0] if m == 1 else e[1] if m == 0 else 0.0 for e, m in zip(weights.evidence, marks))
                rows.append(s - weights.conflict * conflict + extra if s >= weights.least else -1.0)
            yield pd.DataFrame({"i": p.i, "j": p.j, "score": rows}).query("score > 0")

    return run, schema


def score_pairs(pairs: DataFrame, units: DataFrame, blocks: list[str], weights: Weights, overlap: float, exact: list[str]) -> DataFrame:
    """(i, j, score) of pairs that do share ``overlap`` of the smaller gram set, of names or nicknames, or a value of ``exact``: the soft weighted token similarity and the evidence of the attributes."""
    total = units.count()
    often = units.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    spread = units.select("uid", F.posexplode("tokens").alias("at", "token")).join(often, "token")
    weight = F.log(F.lit(1.0 + total) / F.col("often")) + 0.3
    weighed = spread.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", weight.cast("float").alias("w")))).alias("x"))
    marks = [f"m{k}" for k in range(len(weights.evidence))]
    full = cut(units.select("uid", F.xxhash64(*blocks).alias("b"), "tokens", "nick", "grams", "nick_grams", *marks).join(weighed, "uid").select("uid", "b", F.col("tokens").alias("t"), F.col("x.w").alias("w"), F.col("nick").alias("n"), F.col("grams").alias("g"), F.col("nick_grams").alias("h"), *marks))
    side = lambda k, name: full.select(F.col("uid").alias(name), *(F.col(c).alias(f"{c}{k}") for c in ("b", "t", "w", "n", "g", "h")), *(F.col(m).alias(f"{m}_{k}") for m in marks))
    joined = side(1, "i").hint("merge").join(pairs, "i").hint("merge").join(side(2, "j"), "j").filter("b1 = b2")
    alike = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) >= _least_shared(F.least(F.size(a), F.size(b)), overlap))
    near = reduce(lambda x, y: x | y, [alike(a, b) for a in ("g1", "h1") for b in ("g2", "h2")])
    joined = joined.filter(reduce(lambda a, m: F.coalesce(F.col(f"{m}_1") == F.col(f"{m}_2"), F.lit(False)) | a, exact, near))
    evidence = [F.when(F.col(f"{m}_1") == F.col(f"{m}_2"), 1).when(F.col(f"{m}_1").isNotNull() & F.col(f"{m}_2").isNotNull(), 0).otherwise(-1).alias(f"e{k}") for k, m in enumerate(marks)]
    run, schema = _scores(weights)
    return joined.select("i", "j", "t1", "w1", "n1", "t2", "w2", "n2", *evidence).mapInPandas(run, schema)


def link_variants(
    records: DataFrame, *, key: str, blocks: list[str], source: str, source_id: str, form: str, nickname: str | None, evidence: list[str], weights: Weights, exact: tuple[str, ...] = (),
    q: int = 3, overlap: float = 0.5,
) -> DataFrame:
    """(id_1, id_2): records of one block that name the same thing in forms that look different.

    ``form`` holds canonical forms; ``evidence`` names attribute columns in the order of ``weights.evidence`` (later weights may be left out);
    ``exact`` those of them that find candidates by themselves.
    """
    ship(records.sparkSession)
    weights = replace(weights, evidence=weights.evidence[: len(evidence)])
    tokens = _tokens(weights.club)
    nick = tokens(F.col(nickname)) if nickname else F.array().cast("array<string>")
    base = cut(
        records.filter(F.col(form) != "").select(
            F.col(key).alias("id"), *blocks, F.col(source).alias("source"), F.col(source_id).alias("sid"), F.col(form).alias("form"),
            tokens(F.col(form)).alias("tokens"), nick.alias("nick"), *(F.col(c).cast("string").alias(f"m{k}") for k, c in enumerate(evidence)),
        )
    )
    node = [*blocks, "source", "sid"]
    marks = [f"m{k}" for k in range(len(evidence))]
    units = base.groupBy(*node, "form", "tokens", "nick").agg(F.min("id").alias("uid"), *(F.min(m).alias(m) for m in marks))
    own = F.min("uid").over(Window.partitionBy(*node))
    units = cut(units.withColumns({"nid": own, "grams": _grams(F.col("tokens"), q), "nick_grams": _grams(F.col("nick"), q)}))
    sets = units.select(*blocks, "uid", "source", F.posexplode(F.when(F.col("grams") == F.col("nick_grams"), F.array("grams")).otherwise(F.array("grams", "nick_grams"))).alias("set", "grams")).filter(F.size("grams") > 0)
    sets = cut(sets.withColumn("grams", rarest_first(sets)))  # ordered once; the table of frequencies stays out of all later plans
    found = candidates(sets, blocks, overlap)
    keys = [m for m, c in zip(marks, evidence) if c in exact]
    if keys:
        found = found.unionByName(equal_marks(units, blocks, keys)).distinct()
    ids = units.select("uid", "nid", "source")
    scored = score_pairs(found, units, blocks, weights, overlap, keys).filter(F.col("score") >= weights.accept)
    named = scored.join(ids.select(F.col("uid").alias("i"), F.col("nid").alias("a"), F.col("source").alias("sa")), "i")
    named = named.join(ids.select(F.col("uid").alias("j"), F.col("nid").alias("b"), F.col("source").alias("sb")), "j")
    nodes = named.groupBy("a", "sa", "b", "sb").agg(F.max("score").alias("score"))
    both = cut(nodes.unionByName(nodes.select(F.col("b").alias("a"), F.col("sb").alias("sa"), F.col("a").alias("b"), F.col("sa").alias("sb"), "score")))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("a", "sb").orderBy(F.desc("score"), "b"))).filter("r = 1")
    mutual = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    mutual = cut(mutual.select("a", "sa", "b", "sb"))
    over = mutual.select("a", "sa", F.col("b").alias("via")).join(mutual.select(F.col("a").alias("via"), "b", "sb"), "via").filter("sa <> sb").select("a", "sa", "b", "sb")
    taken = mutual.select("a", "sb").distinct()
    indirect = over.join(taken, ["a", "sb"], "left_anti")
    linked = mutual.unionByName(indirect.select("a", "sa", "b", "sb")).filter("a < b").select("a", "b").distinct()
    same = units.groupBy("nid").agg(F.count_distinct("form").alias("forms")).filter("forms > 1").select(F.col("nid").alias("a"), F.col("nid").alias("b"))
    rows = base.join(units.select(*node, "form", "nid").distinct(), [*node, "form"]).select("id", "form", "nid")
    left, right = (rows.select(F.col("id").alias(x), F.col("form").alias(f"f{x}"), F.col("nid").alias(n)) for x, n in (("x", "a"), ("y", "b")))
    pairs = linked.unionByName(same).join(left, "a").join(right, "b").filter("fx <> fy and x <> y")
    return pairs.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2")).distinct()
