"""Mixed timestamp notations to one unambiguous instant or date.

Every value becomes a mask of character classes (``2024-03-01T10:05Z`` ->
``9999-99-99A99:99A``). A distinct mask is compiled once into a parser that knows at
which offsets the fields lie; the values of one mask then form a matrix of code points
and are converted all at once. Local times go through a zone transition table: two
sorted arrays per zone, searched with one ``searchsorted``. A table reaches from before the
first time zones to the year 2500; as the calendar repeats every 400 years, so does a
zone's last rule, and later times are looked up that many years earlier.

Defined results
* null, empty, unknown notation, impossible date (month 13, 30 February, 0000-00-00): null.
* values of any length are read; those of one length form the matrices, so a long one costs only itself.
* date whose time of day is impossible (25:99): the date alone counts.
* offset or Z in the value: taken as written; a zone name in brackets beside an offset adds nothing.
* time without zone: on the clock of the zone column, UTC where that is null or no known zone.
* a local time that occurs twice is the first; a skipped one moves on by the gap.
* two digits of a year are never guessed for instants; such a value is null.
* all-digit dates with the year last: the order of day and month is that of the source
  (see :func:`day_month_order`); a source without evidence reads day first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsync.runtime import ship

DAY_MS = 86_400_000
CYCLE_MS = 146_097 * DAY_MS  # 400 years, a whole number of weeks
# English month names; three letters are enough to tell them apart.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_DATES = (
    ("ymd", r"(?P<y>9999)(?P<s>[-/.])(?P<m>9{1,2})(?P=s)(?P<d>9{1,2})"),
    ("ymd", r"(?P<y>9999)(?P<m>99)(?P<d>99)"),
    ("two", r"(?P<p>9{1,2})(?P<s>[-/.])(?P<q>9{1,2})(?P=s)(?P<y>9999)"),
    ("name", r"(?:A+,? )?(?P<d>9{1,2})[- ](?P<mon>AAA+)[- ,]{1,2}(?P<y>9999)"),
    ("name", r"(?:A+,? )?(?P<mon>AAA+)\.? (?P<d>9{1,2}),? (?P<y>9999)"),
)
_CLOCK = r"(?P<H>9{1,2})[:.](?P<M>99)(?:[:.](?P<S>99)(?:[.,](?P<f>9{1,9}))?)?(?P<ap> ?AA(?!A))?"
_PLAIN_CLOCK = r"(?P<H>99)(?P<M>99)(?P<S>99)?"
_NAME = r"\[[A/_+\-9]+\]"
_ZONE = rf"(?: ?(?P<sign>[-+])(?P<oh>99):?(?P<om>99)(?P<name> *{_NAME})?|(?P<z>A)(?P<name2> *{_NAME})?| (?P<utc>AAA)(?P<name3> *{_NAME})?| *(?P<only>{_NAME}))?"
LONG = 256


def order_votes(value, source):
    """Columns that count, for one source, the all-digit dates which admit one order only."""
    parts = F.regexp_extract_all(F.trim(value), F.lit(r"^(\d{1,2})[-/.]\d{1,2}[-/.]\d{4}"), F.lit(1))
    second = F.regexp_extract_all(F.trim(value), F.lit(r"^\d{1,2}[-/.](\d{1,2})[-/.]\d{4}"), F.lit(1))
    p, q = parts[0].cast("int"), second[0].cast("int")
    return (
        F.sum(F.when(p.between(13, 31) & q.between(1, 12), 1).otherwise(0)).alias("dmy"),
        F.sum(F.when(q.between(13, 31) & p.between(1, 12), 1).otherwise(0)).alias("mdy"),
    )


def day_month_order(frames: list[tuple[DataFrame, str]], source: str) -> DataFrame:
    """(source, month_first): the order of all-digit dates per source, by majority over all rows."""
    both = None
    for df, column in frames:
        one = df.select(F.col(source).alias("__order_source"), F.col(column).alias("__order_value"))
        both = one if both is None else both.unionByName(one)
    kept = both.filter(F.col("__order_value").rlike(r"^\s*\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"))
    votes = kept.groupBy("__order_source").agg(*order_votes(F.col("__order_value"), F.col("__order_source")))
    return votes.select("__order_source", (F.col("mdy") > F.col("dmy")).alias("__order_month_first"))


@lru_cache(maxsize=4096)
def compile_date(mask: str):
    """The parser of a mask of a date with or without a time: (kind, spans) or None."""
    if mask in ("9" * 10, "9" * 13):
        return ("epoch", {"e": (0, len(mask))})
    for kind, pattern in _DATES:
        if m := re.fullmatch(pattern + rf"(?:(?:[ ]|A)(?:{_CLOCK}|(?P<H2>99)(?P<M2>99)(?P<S2>99)?){_ZONE})?", mask):
            return (kind, _spans(m))
    return None


@lru_cache(maxsize=4096)
def compile_clock(mask: str):
    """The parser of a mask of a time of day, or None."""
    m = re.fullmatch(_CLOCK + _ZONE, mask) or re.fullmatch(_PLAIN_CLOCK + _ZONE, mask)
    return ("clock", _spans(m)) if m else None


def _spans(m: re.Match) -> dict[str, tuple[int, int]]:
    return {k.rstrip("23"): m.span(k) for k, v in m.groupdict().items() if v is not None and k != "s"}


def mask_of(values: np.ndarray) -> np.ndarray:
    """Masks of an array of str: digits become 9, letters A."""
    width = max(1, values.dtype.itemsize // 4)
    points = values.astype(f"U{width}").view(np.uint32).reshape(len(values), width).copy()
    digit = (points >= 48) & (points <= 57)
    letter = ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122))
    points[digit] = 57
    points[letter] = 65
    return points.view(f"U{width}").reshape(len(values))


@lru_cache(maxsize=1)
def tz_version() -> str:
    """What tells the zone data of this machine apart: a digest of the system's files, which come first, else the version of the package."""
    files = sorted((n, p) for n in available_timezones() for p in [next((Path(t) / n for t in TZPATH if (Path(t) / n).is_file()), None)] if p)
    if not files:
        import tzdata

        return tzdata.IANA_VERSION
    digest = hashlib.sha256()
    for name, path in files:
        digest.update(name.encode() + b"\0" + path.read_bytes())
    return digest.hexdigest()[:16]


def _seconds(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())


FAR_MS, LAST_MS = _seconds(2100) * 1000, _seconds(2500) * 1000


@lru_cache(maxsize=1024)
def zone_table(version: str, name: str, far: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
    """(local starts in ms, offsets in ms) of a zone up to 2500 (2100 unless ``far``), or None for an unknown zone.

    Regime i holds from ``starts[i - 1]`` on. A start is the transition plus the larger of
    both offsets: an hour that occurs twice so stays in the earlier regime, and a skipped
    one is read with the earlier offset, which moves it on by the gap.
    """
    if version != tz_version():
        raise RuntimeError(f"zone data {tz_version()} on this worker, {version} on the driver")
    if name not in available_timezones():
        return None
    zone, day = ZoneInfo(name), 86_400
    offset = lambda second: zone.utcoffset(datetime.fromtimestamp(second, zone)).total_seconds()
    at = _seconds(1800)
    now, starts, offsets = offset(at), [], [offset(at)]
    for until, step in ((1910, 15 * day), (2040, 3 * day), (2501 if far else 2101, 10 * day)):  # the rules of our time change at most a few times a year
        last = _seconds(until)
        while at < last:
            then = offset(at + step)
            if then != now:
                low, high = at, at + step
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if offset(middle) == now else (low, middle)
                starts.append((high + max(now, then)) * 1000)
                offsets.append(then)
                now = then
            at += step
    return np.array(starts, "int64"), np.array([x * 1000 for x in offsets], "int64")


def to_utc(local: np.ndarray, zones: np.ndarray, version: str) -> np.ndarray:
    """Local milliseconds to UTC milliseconds; null or unknown zones count as UTC."""
    out = local.copy()
    local = np.where(local >= LAST_MS, local - (1 + (local - LAST_MS) // CYCLE_MS) * CYCLE_MS, local)
    far = bool((local >= FAR_MS).any())
    for name in {z for z in zones if z}:
        if (table := zone_table(version, name, far)) is not None:
            here = zones == name
            out[here] -= table[1][np.searchsorted(table[0], local[here], side="right")]
    return out


class Parsed:
    """Columns of a batch: date (days, or invalid), time of day, offset, and whole instants."""

    def __init__(self, n: int):
        self.day = np.zeros(n, "int64")
        self.has_day = np.zeros(n, bool)
        self.clock = np.zeros(n, "int64")
        self.has_clock = np.zeros(n, bool)
        self.offset = np.zeros(n, "int64")
        self.has_offset = np.zeros(n, bool)
        self.zone = np.full(n, None, object)


def _number(points: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    a, b = span
    return (points[:, a:b].astype("int64") - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype="int64"))


def _days(y, m, d) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    good = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = np.where(good, (y - 1970) * 12 + m - 1, 0).astype("datetime64[M]")
    first = month.astype("datetime64[D]").astype("int64")
    good &= d <= (month + 1).astype("datetime64[D]").astype("int64") - first
    return first + d - 1, good


def parse(values: list[str | None], month_first: np.ndarray | None, clock_only: bool) -> Parsed:
    """Parse a batch, one distinct mask at a time."""
    out = Parsed(len(values))
    text = [(v or "").strip() for v in values]
    lengths = np.fromiter(map(len, text), "int64", len(text))
    for n in np.unique(lengths[lengths > 0]).tolist():
        where = np.flatnonzero(lengths == n)
        array = np.array([text[i] for i in where], f"U{n}")
        distinct, group = np.unique(mask_of(array), return_inverse=True)
        rank = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[rank], np.arange(len(distinct) + 1))
        for k, mask in enumerate(distinct):
            compiler = compile_clock if clock_only else compile_date
            compiled = (compiler if n <= LONG else compiler.__wrapped__)(str(mask))
            if compiled is None:
                continue
            local = rank[edges[k] : edges[k + 1]]
            points = array[local].view(np.uint32).reshape(len(local), n)
            _convert(compiled, points, where[local], month_first, out)
    return out


def _convert(compiled, points, rows, month_first, out: Parsed) -> None:
    kind, s = compiled
    if kind == "epoch":
        ms = _number(points, s["e"]) * (1000 if s["e"][1] == 10 else 1)
        out.day[rows], out.clock[rows] = ms // DAY_MS, ms % DAY_MS
        out.has_day[rows] = out.has_clock[rows] = out.has_offset[rows] = True
        return
    if kind != "clock":
        y = _number(points, s["y"])
        if kind == "two":
            p, q = _number(points, s["p"]), _number(points, s["q"])
            first = month_first[rows] if month_first is not None else np.zeros(len(rows), bool)
            m, d = np.where(first, p, q), np.where(first, q, p)
        elif kind == "name":
            a, b = s["mon"]
            names = np.ascontiguousarray(points[:, a:b]).view(f"U{b - a}").reshape(len(rows))
            distinct, group = np.unique(names, return_inverse=True)
            m, d = np.array([_month(str(x)) for x in distinct], "int64")[group], _number(points, s["d"])
        else:
            m, d = _number(points, s["m"]), _number(points, s["d"])
        out.day[rows], out.has_day[rows] = _days(y, m, d)
    if "H" not in s:
        return
    hour, minute = _number(points, s["H"]), _number(points, s["M"])
    second = _number(points, s["S"]) if "S" in s else 0 * hour
    milli = 0 * hour
    if "f" in s:
        a, b = s["f"]
        milli = _number(points, (a, min(b, a + 3))) * 10 ** max(0, 3 - (b - a))
    good = (hour < 24) & (minute < 60) & (second < 60)
    if "ap" in s:
        a, b = s["ap"]
        marks = np.ascontiguousarray(points[:, b - 2 : b]).view("U2").reshape(len(rows))
        lower = np.char.lower(marks)
        good &= (hour >= 1) & (hour <= 12) & ((lower == "am") | (lower == "pm"))
        hour = hour % 12 + 12 * (lower == "pm")
    if "utc" in s:
        a, b = s["utc"]
        marks = np.char.upper(np.ascontiguousarray(points[:, a:b]).view("U3").reshape(len(rows)))
        good &= (marks == "UTC") | (marks == "GMT")
    if "z" in s:
        good &= np.isin(points[:, s["z"][0]], (90, 122))
    out.clock[rows] = ((hour * 60 + minute) * 60 + second) * 1000 + milli
    out.has_clock[rows] = good
    if "sign" in s:
        sign = np.where(points[:, s["sign"][0]] == 45, -1, 1)
        out.offset[rows] = sign * (_number(points, s["oh"]) * 60 + _number(points, s["om"])) * 60_000
    out.has_offset[rows] = good & bool({"sign", "utc", "z"} & set(s))
    if "only" in s:
        a, b = s["only"]
        out.zone[rows] = np.ascontiguousarray(points[:, a + 1 : b - 1]).view(f"U{b - a - 2}").reshape(len(rows))


@lru_cache(maxsize=1024)
def _month(name: str) -> int:
    key = name.lower()
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    return next((i + 1 for i, x in enumerate(full) if key == x or key == x[:3] or key == "sept" and i == 8), 0)


def _iso(day: np.ndarray, ms: np.ndarray | None, good: np.ndarray) -> list[str | None]:
    if ms is None:
        shown = np.datetime_as_string(np.where(good, day, 0).astype("datetime64[D]"))
        return [str(v) if g else None for v, g in zip(shown, good)]
    shown = np.datetime_as_string(np.where(good, ms, 0).astype("datetime64[ms]"))
    return [f"{v}Z" if g else None for v, g in zip(shown, good)]


def iso_instants(dates, clocks, zones, month_first, version: str) -> list[str | None]:
    """ISO text of a batch: UTC with milliseconds where the time of day is known, else the date."""
    d = parse(dates, month_first, False)
    if clocks is None:
        return _iso(d.day, None, d.has_day)
    c = parse(clocks, None, True)
    own = d.has_clock
    clock, known = np.where(own, d.clock, c.clock), own | c.has_clock
    offset, fixed = np.where(own, d.offset, c.offset), np.where(own, d.has_offset, c.has_offset)
    named = np.where(own, d.zone, c.zone)
    zone = np.array([a or b for a, b in zip(named, zones)], object)
    local = d.day * DAY_MS + clock
    ms = np.where(fixed, local - offset, to_utc(local, np.where(fixed, None, zone), version))
    instant, plain = _iso(d.day, ms, d.has_day & known), _iso(d.day, None, d.has_day & ~known)
    return [a or b for a, b in zip(instant, plain)]


def normalise_timestamps(
    df: DataFrame,
    date: str,
    *,
    orders: DataFrame | None = None,
    source: str | None = None,
    clock: str | None = None,
    zone: str | None = None,
    out: str = "iso_value",
) -> DataFrame:
    """``df`` with a string column ``out``; null where the row has no usable date.

    ``orders`` comes from :func:`day_month_order` and is joined on ``source`` (null-safe).
    Without ``clock`` the calendar day as written is the result, whatever time follows.
    """
    ship(df.sparkSession)
    version, kept = tz_version(), [c for c in df.columns if c != out]
    base = df.select(*kept)
    if orders is not None:
        base = base.join(orders, base[source].eqNullSafe(orders["__order_source"]), "left").drop("__order_source")
    else:
        base = base.withColumn("__order_month_first", F.lit(False))
    names = [date, clock, zone]
    schema = base.drop("__order_month_first").withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist() if c else None
            first = np.array([bool(x) for x in column("__order_month_first")], bool)
            if n:
                iso = iso_instants(column(names[0]), column(names[1]), column(names[2]) or [None] * n, first, version)
            else:
                iso = []
            arrays = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(iso, pa.string())], names=[*kept, out])

    return base.mapInArrow(run, schema)
