"""Matching two tables of the same people without a common key, by a cascade of exact joins.

Every record gets keys: name tokens (canonical form, no accents), sound keys of tokens, the birth
date, its year, the shirt number and a team key. A rule is a set of keys, and rules are tried
from the strictest to the weakest. A rule joins the records exactly on its keys; a pair must then
hold against the attributes that the keys don't cover (an exact check: soft similarity of the name
tokens plus agreement of the others, at least the rule's ``least``). A right record with exactly one
left partner under a rule is resolved by it, whatever weaker rules would say, and is anti-joined
from all later ones; with several partners it stays open. Rules of like strength form a
pass and share one equi-join on (rule, key): as only right records are used up, taking each one's
strictest rule with a single partner is the same as one join after the other. The slips of the pen that
can lie between two dates are spelt out only for right records that the exact rules left open.

All joins move rows to their keys; none is left to estimates of size after an explode.

A rule's confidence is the precision of what it resolves among labelled records, smoothed with
one success and one failure. They run through the same joins, in a world of their own, where no
record leaves, so that weak rules are measured too.

Defined results: null attributes build no key; a left record may get several right ones
(one report each), a right record at most one left one; repeated left rows make a record ambiguous,
repeated right ones are matched like others; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsync.llm.variants import CLUB_NOISE, name_similarity, sound, tokens_of
from idsync.runtime import cut, ship

LISTS = {"sounds", "slips", "town"}


@dataclass(frozen=True)
class Rule:
    """Key columns of one rule; ``right`` differs where the right side spells variants out."""

    name: str
    keys: tuple[str, ...]
    right: tuple[str, ...] | None = None
    least: float = 0.55


PASSES = (
    (
        Rule("name birth", ("full", "born")),
        Rule("name team shirt", ("full", "team", "shirt")),
        Rule("token birth team", ("sounds", "born", "team")),
        Rule("token birth shirt", ("sounds", "born", "shirt")),
    ),
    (
        Rule("name slipped birth", ("full", "born"), ("full", "slips")),
        Rule("name team", ("full", "team")),
        Rule("token slipped birth team", ("sounds", "born", "team"), ("sounds", "slips", "team")),
        Rule("token slipped birth shirt", ("sounds", "born", "shirt"), ("sounds", "slips", "shirt")),
        Rule("token team shirt", ("sounds", "team", "shirt")),
        Rule("token year team", ("sounds", "year", "team")),
        Rule("name year shirt", ("full", "year", "shirt")),
    ),
    (
        Rule("token birth", ("sounds", "born"), least=0.7),
        Rule("birth team shirt", ("born", "team", "shirt"), least=0.6),
        Rule("token year shirt", ("sounds", "year", "shirt"), least=0.7),
        Rule("token slipped birth", ("sounds", "born"), ("sounds", "slips"), least=0.75),
        Rule("token town shirt", ("sounds", "town", "shirt"), least=0.7),
        Rule("token birth town", ("sounds", "born", "town"), least=0.7),
        Rule("birth shirt", ("born", "shirt"), least=1.3),  # no name key: the names must carry what the keys don't
        Rule("birth team", ("born", "team"), least=1.3),
    ),
    (
        Rule("token team", ("sounds", "team"), least=0.75),
        Rule("name year", ("full", "year"), least=0.8),
        Rule("name", ("full",), least=0.9),
    ),
)


def birth_date(text: Column) -> Column:
    """A full date of year-first or day-first notation; two digits of a year mean 1911 to 2010."""
    t = F.trim(text)
    parts = lambda p, i: F.regexp_extract(t, p, i).cast("int")
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[.](\d{1,2})[.](\d{4}|\d{2})$"
    short = F.regexp_extract(t, dmy, 3)
    year = F.when(F.length(short) == 2, F.when(short.cast("int") <= 10, short.cast("int") + 2000).otherwise(short.cast("int") + 1900)).otherwise(short.cast("int"))
    made = lambda y, m, d: F.when(m.between(1, 12) & d.between(1, 31), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(t.rlike(iso), made(parts(iso, 1), parts(iso, 2), parts(iso, 3))).when(t.rlike(dmy), made(year, parts(dmy, 2), parts(dmy, 1)))


def _slips(born: Column) -> Column:
    """The date itself and what one slip makes of it: a day, a year, a decade off, day and month swapped."""
    swapped = F.when(F.dayofmonth(born) <= 12, F.make_date(F.year(born), F.dayofmonth(born), F.month(born)))
    months = [F.add_months(born, k) for k in (-120, -12, 12, 120, -1, 1)]
    return F.array_distinct(F.array_compact(F.array(born, F.date_add(born, 1), F.date_add(born, -1), swapped, *months)))


@F.pandas_udf(T.StructType([T.StructField("full", T.StringType()), T.StructField("sounds", T.ArrayType(T.StringType())), T.StructField("tokens", T.ArrayType(T.StringType()))]))
def _name_keys(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in values:
        seen = {}
        for x in s.dropna().unique():
            t = tokens_of(x)
            plain = all(map(str.isascii, t))  # in Kana and Hangul, blanks inside a name come and go
            whole = set() if plain else {sound("".join(t)), sound("".join(reversed(t)))}
            seen[x] = (" ".join(sorted(t)) or None, sorted({sound(w) for w in t if len(w) > 1} | whole), t)
        yield pd.DataFrame([seen.get(x, (None, [], [])) for x in s], columns=["full", "sounds", "tokens"])


@F.pandas_udf(T.StructType([T.StructField("team", T.StringType()), T.StructField("town", T.ArrayType(T.StringType()))]))
def _team_keys(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in values:
        seen = {}
        for x in s.dropna().unique():
            t = [w for w in tokens_of(x, True) if w not in CLUB_NOISE]
            seen[x] = (" ".join(sorted(t)) or None, sorted({sound(w) for w in t if len(w) > 3}))
        yield pd.DataFrame([seen.get(x, (None, [])) for x in s], columns=["team", "town"])


def keyed(df: DataFrame, key: str, name: Column, birth: Column, shirt: Column, team: Column) -> DataFrame:
    """id and the key columns of each record; ``team`` may hold any text of the team."""
    ship(df.sparkSession)
    base = df.select(F.col(key).alias("id"), _name_keys(name).alias("n"), birth_date(birth).alias("born"), F.regexp_extract(F.trim(birth), r"^(\d{4})$", 1).alias("y"), F.trim(shirt).alias("shirt"), _team_keys(team).alias("c"))
    year = F.coalesce(F.year("born"), F.when(F.col("y") != "", F.col("y").cast("int")))
    return base.select("id", "n.full", "n.sounds", "n.tokens", "born", year.alias("year"), F.when(F.col("shirt") != "", F.col("shirt")).alias("shirt"), "c.team", "c.town")


def _spelled(columns: tuple[str, ...], number: int) -> Column:
    """All keys of one rule for a row, hashed with the rule's number; empty where an attribute is unknown."""

    def build(rest: tuple[str, ...], done: list[Column]) -> Column:
        if not rest:
            return F.xxhash64(F.lit(number), *done)
        if rest[0] in LISTS:
            made = F.transform(rest[0], lambda x: build(rest[1:], [*done, x]))
            return F.flatten(made) if LISTS & set(rest[1:]) else made
        return build(rest[1:], [*done, F.col(rest[0])])

    known = [F.col("born" if c == "slips" else c).isNotNull() for c in columns]
    keys = build(columns, []) if LISTS & set(columns) else F.array(build(columns, []))
    return F.when(reduce(lambda a, b: a & b, known), F.transform(keys, lambda k: F.struct(F.lit(number).alias("rule"), k.alias("key")))).otherwise(F.array().cast("array<struct<rule:int,key:bigint>>"))


def _key_rows(df: DataFrame, rules: tuple[Rule, ...], right: bool, name: str) -> DataFrame:
    keys = [_spelled((r.right if right and r.right else r.keys), i) for i, r in enumerate(rules)]
    if right and any(r.right for r in rules):
        df = df.withColumn("slips", _slips(F.col("born")))
    return df.select("world", F.col("id").alias(name), F.explode(F.concat(*keys)).alias("k")).select("world", name, "k.rule", "k.key")


def joined(left: DataFrame, right: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(world, l, r, rules) with a bit for each rule whose keys join the pair; one equi-join for all rules of a pass."""
    pairs = _key_rows(left, rules, False, "l").hint("merge").join(_key_rows(right, rules, True, "r"), ["world", "rule", "key"])
    return pairs.groupBy("world", "r", "l").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("rule"))).alias("rules"))


def _agreement(a: Column, b: Column, near: Column | None, yes: float, close: float, no: float) -> Column:
    known = a.isNotNull() & b.isNotNull()
    out = F.when(known & (a == b), yes)
    if near is not None:
        out = out.when(known & near, close)
    return out.when(known, no).otherwise(0.0)


def _judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for a, b, extra in zip(p.ta, p.tb, p.extra):
            s, conflict = name_similarity(list(a), list(b), [1.0] * len(a), [1.0] * len(b), False)
            rows.append(s - 0.6 * conflict + extra if s >= 0.3 else -1.0)
        yield pd.DataFrame({"world": p.world, "l": p.l, "r": p.r, "rules": p.rules, "score": rows})


def judged(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``pairs`` with a score: the names' soft similarity plus the agreement of the other attributes; pairs that can't reach ``least`` are gone."""
    side = lambda df, k, name: df.select("world", F.col("id").alias(name), *(F.col(c).alias(f"{c}{k}") for c in ("tokens", "born", "year", "shirt", "team", "town")))
    both = side(left, "1", "l").hint("merge").join(pairs, ["world", "l"])
    both = both.hint("merge").join(side(right, "2", "r"), ["world", "r"])
    birth = F.when(
        F.col("born1").isNotNull() & F.col("born2").isNotNull(),
        F.when(F.col("born1") == F.col("born2"), 0.5).when(F.array_contains(_slips(F.col("born1")), F.col("born2")), 0.25).otherwise(-0.4),
    ).otherwise(_agreement(F.col("year1"), F.col("year2"), None, 0.2, 0.0, -0.4))
    shirt = _agreement(F.col("shirt1"), F.col("shirt2"), None, 0.25, 0.0, -0.15)
    team = _agreement(F.col("team1"), F.col("team2"), F.arrays_overlap("town1", "town2"), 0.3, 0.15, -0.2)
    kept = both.select("world", "l", "r", "rules", F.col("tokens1").alias("ta"), F.col("tokens2").alias("tb"), (birth + shirt + team).cast("double").alias("extra"))
    return kept.filter(F.col("extra") >= least - 1).mapInPandas(_judge, "world int, l long, r long, rules int, score double")


def resolved(scored: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(world, l, r, rule) under every rule that leaves a right record a single partner, with ``at``, the rule's place; combined before the shuffle."""
    hit = [F.when((F.col("rules").bitwiseAND(1 << i) != 0) & (F.col("score") >= r.least), F.col("l")) for i, r in enumerate(rules)]
    ends = scored.groupBy("world", "r").agg(*(f(h).alias(f"{n}{i}") for i, h in enumerate(hit) for f, n in ((F.min, "a"), (F.max, "z"))))
    single = [F.when(F.col(f"a{i}") == F.col(f"z{i}"), F.struct(F.lit(i).alias("at"), F.col(f"a{i}").alias("l"), F.lit(r.name).alias("rule"))) for i, r in enumerate(rules)]
    return ends.select("world", "r", F.inline(F.array_compact(F.array(*single)))).select("world", "l", "r", "rule", "at")


def cascade(left: DataFrame, right: DataFrame, passes: tuple[tuple[Rule, ...], ...] = PASSES) -> tuple[DataFrame, DataFrame]:
    """((l, r, rule) of world 0, the same of world 1).

    In world 0 each right record is resolved once, by its strictest rule that can; world 1, the labels, shows every rule all records.
    """
    left, right = cut(left), cut(right)
    open_, done, seen = right, None, None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for rules in passes:
        scored = judged(joined(left, open_, rules), left, right, min(r.least for r in rules))
        found = cut(resolved(scored, rules))
        first = found.filter("world = 0").groupBy("r").agg(F.min(F.struct("at", "l", "rule")).alias("s")).select("s.l", "r", "s.rule")
        done, seen = add(done, first), add(seen, found.filter("world = 1").select("l", "r", "rule"))
        open_ = open_.hint("merge").join(found.filter("world = 0").select("world", F.col("r").alias("id")), ["world", "id"], "left_anti")
    return done, seen


def rule_precision(found: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Smoothed precision per rule: of the pairs (l, r, rule) that it resolves among ``labels`` (id, person), the share of one person. Only counts per rule reach the driver."""
    who = lambda i, name: labels.select(F.col("id").alias(i), F.col("person").alias(name))
    pairs = found.join(who("l", "a"), "l").join(who("r", "b"), "r")
    return {r["rule"]: (r.good + 1) / (r.n + 2) for r in pairs.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("good")).collect()}


def match_cascade(left: DataFrame, right: DataFrame, labelled: DataFrame | None = None, passes: tuple[tuple[Rule, ...], ...] = PASSES) -> DataFrame:
    """(l, r, rule, confidence): each right record with at most one left record.

    ``left`` and ``right`` come from :func:`keyed`, as does ``labelled``, which adds the ``person`` of each record and ``first``,
    true for one record of each person (these are the left side of their world). A rule without labelled pairs has a confidence of a half.
    """
    world = lambda df, n: df.withColumn("world", F.lit(n))
    one, two = world(left, 0), world(right, 0)
    if labelled is not None:
        labelled = cut(labelled)
        one = one.unionByName(world(labelled.filter("first").select(*left.columns), 1))
        two = two.unionByName(world(labelled.filter("not first").select(*right.columns), 1))
    found, seen = cascade(one, two, passes)
    precision = rule_precision(seen, labelled.select("id", "person")) if labelled is not None else {}
    known = reduce(lambda c, x: c.when(F.col("rule") == x[0], x[1]), precision.items(), F.when(F.lit(False), 0.5)).otherwise(0.5)
    return found.select("l", "r", "rule", known.cast("double").alias("confidence"))


def label_sample(records: DataFrame, person: str, record: str, most: int = 10_000) -> DataFrame:
    """All records of so many persons, chosen by a hash, that about ``most`` records remain (all of them if there are no more), with ``first``: one record of each person.

    The bound is for the labels of the rules' precision only.
    """
    known = records.filter(F.col(person).isNotNull())
    share = -(-known.count() // most)
    kept = known.filter(F.pmod(F.xxhash64(person), F.lit(max(share, 1))) == 0)
    least = kept.groupBy(person).agg(F.min(record).alias("_least"))
    return kept.join(least, person).withColumn("first", F.col(record) == F.col("_least")).drop("_least")
