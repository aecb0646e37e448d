"""Column -> Column helpers. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that decompose to one ASCII letter, and that letter."""
    pairs = []
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        plain = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if letter == letter.lower() and len(plain) == 1 and plain.isalpha():
            pairs.append((letter, plain.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MICROS_PER_DAY = 86400e6
MICROS_PER_HOUR = 3600e6
EARTH_RADIUS_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- text keys -----------------------------------------------------------


def zero_pad(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer text is kept (a bare ``lpad`` would cut it)."""
    c = col(c)
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def strip_float_tail(c: Column | str) -> Column:
    return F.regexp_replace(col(c).cast("string"), r"\.0$", "")


def place_key(c: Column | str, digits: int = 6) -> Column:
    """Place code as text: float tail dropped, digits only, first ``digits`` kept."""
    return F.substring(F.regexp_replace(strip_float_tail(c), r"\D", ""), 1, digits)


def place_key_7(c: Column | str) -> Column:
    """Seven-digit place code, zero padded."""
    return zero_pad(strip_float_tail(c), 7)


def six_digit_code(c: Column | str) -> Column:
    """Integer code: seven digits lose the check digit, six digits pass through."""
    c = col(c).cast("long")
    return F.when(c >= 1_000_000, F.floor(c / 10).cast("long")).otherwise(c)


def facility_code(c: Column | str) -> Column:
    """Facility id: text before the first dot, padded to seven; blank for null or 'nan'."""
    text = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    blank = (text == "") | (F.lower(text) == "nan")
    return F.when(blank, F.lit("")).otherwise(zero_pad(F.split(text, r"\.")[0], 7))


def facility_digits(c: Column | str) -> Column:
    """Facility id for routing: digits only, padded to seven; blank when there are none."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.0", ""), r"\D", "")
    return F.when(digits == "", digits).otherwise(zero_pad(digits, 7))


def plain_text(c: Column | str) -> Column:
    """Lower-cased text without accents; characters with no plain form vanish."""
    text = F.translate(F.lower(col(c).cast("string")), ACCENTED, PLAIN)
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def slug(c: Column | str) -> Column:
    text = F.regexp_replace(plain_text(F.trim(col(c).cast("string"))), "[^a-z0-9]+", "_")
    return F.coalesce(F.regexp_replace(text, "^_+|_+$", ""), F.lit(""))


def digits_or_null(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(col(c).cast("string"), r"\D", ""), F.lit(""))


def upper_trim(c: Column | str) -> Column:
    return F.upper(F.trim(col(c).cast("string")))


def identity_chain(*candidates: Column | str, fallback: Column, prefix: str = "pharmacy-") -> Column:
    """First known id, else a generated one.

    The generated id is a stable hash of ``fallback``: a row index would change
    between runs of a distributed job.
    """
    made = F.concat(F.lit(prefix), F.substring(F.md5(fallback), 1, 16))
    return F.coalesce(*[col(c) for c in candidates], made)


def composite_key(*parts: Column | str) -> Column:
    """Parts joined by '_'; runs of unsafe characters in the last part become '_'."""
    *head, tail = [col(p).cast("string") for p in parts]
    return F.concat_ws("_", *head, F.regexp_replace(tail, "[^A-Za-z0-9]+", "_"))


def is_named(c: Column | str) -> Column:
    """Not null and not the text 'nan'."""
    c = col(c)
    return c.isNotNull() & (F.upper(c.cast("string")) != "NAN")


def same_text(c: Column | str, value: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(col(c).cast("string")) == value.lower()


# ---- numbers -------------------------------------------------------------


def number(c: Column | str) -> Column:
    """Text to double. Only plain decimal notation counts; anything else is null."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def decimal_number(c: Column | str) -> Column:
    """Decimal comma or dot, inner blanks ignored."""
    text = F.replace(col(c).cast("string"), F.lit(" "), F.lit(""))
    return number(F.replace(text, F.lit(","), F.lit(".")))


def localized_number(c: Column | str, missing: Sequence[str] = ("", "-", "..", "...", "X")) -> Column:
    """'1.234,5' style numbers with sentinel texts for missing and an optional percent sign."""
    raw = F.trim(col(c).cast("string"))
    text = F.replace(raw, F.lit("%"), F.lit(""))
    both = text.contains(",") & text.contains(".")
    dotless = F.when(both, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    value = number(F.replace(dotless, F.lit(","), F.lit(".")))
    return F.when(~raw.isin(*missing), value)


def lenient_number(c: Column | str) -> Column:
    """Blank, null or unreadable text counts as zero."""
    text = F.replace(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))), F.lit(","), F.lit("."))
    return F.coalesce(number(text), F.lit(0.0))


def finite(c: Column | str) -> Column:
    """Infinities and NaN become null."""
    c = col(c)
    odd = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~odd, c)


def ratio(x: Column | str, d: Column | str, scale: float = 1.0) -> Column:
    """x / d * scale; a zero or null denominator gives null."""
    x, d = col(x).cast("double"), col(d).cast("double")
    return F.try_divide(x, F.nullif(d, F.lit(0.0))) * F.lit(float(scale))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null (``greatest`` alone would return the bound)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def right_closed_bins(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edge[i], edge[i+1]] that holds the value; null outside all bins."""
    c = col(c)
    out = None
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        inside = (c > low) & (c <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def row_std(columns: Iterable[Column | str]) -> Column:
    """Sample standard deviation across columns of one row, nulls ignored."""
    values = F.filter(F.array(*[col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


# ---- flags and labels ----------------------------------------------------


def or_false(condition: Column) -> Column:
    """Comparison with null counts as false."""
    return F.coalesce(condition, F.lit(False))


def known_only(c: Column | str, condition: Column) -> Column:
    """The condition where ``c`` is known, null elsewhere."""
    return F.when(col(c).isNotNull(), condition)


def in_box(lat: Column | str, lon: Column | str, lon_max: float = -34.0) -> Column:
    """Inside the national coordinate box; unknown coordinates are not inside."""
    return or_false(col(lat).between(-34.0, 6.0) & col(lon).between(-74.0, float(lon_max)))


def last_match(default: str | Column, rules: Sequence[tuple[Column, str | Column]]) -> Column:
    """Status by ordered rules where a later match overwrites an earlier one."""
    out = default if isinstance(default, Column) else F.lit(default)
    for condition, value in rules:
        out = F.when(condition, value).otherwise(out)
    return out


def two_flag_label(first: Column, second: Column, labels: Sequence[str]) -> Column:
    """Label for (both, only first, only second, neither)."""
    both, only_first, only_second, neither = labels
    return (
        F.when(first & second, both).when(first, only_first).when(second, only_second).otherwise(neither)
    )


def largest_measure(measures: dict[str, Column | str], when_none: str) -> Column:
    """Name of the largest known measure; the first listed one wins a tie."""
    items = [
        F.struct(col(c).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
        for i, (name, c) in enumerate(measures.items())
    ]
    known = F.filter(F.array(*items), lambda s: s["v"].isNotNull())
    return F.coalesce(F.array_max(known)["name"], F.lit(when_none))


def lookup(c: Column | str, table: dict) -> Column:
    """Value of a small constant code table; null for an unknown code."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col(c)) if pairs else F.lit(None)


# ---- time ----------------------------------------------------------------


def _micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return (_micros(later) - _micros(earlier)) / F.lit(MICROS_PER_DAY)


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return (_micros(later) - _micros(earlier)) / F.lit(MICROS_PER_HOUR)


def julian_day(c: Column | str) -> Column:
    """Julian day number with fraction."""
    return _micros(c) / F.lit(MICROS_PER_DAY) + F.lit(2440587.5)


def parse_period(c: Column | str) -> Column:
    """'MM/YYYY' or 'MM-YYYY' to the first day of the month; unreadable text is null."""
    text = F.replace(F.trim(col(c).cast("string")), F.lit("-"), F.lit("/"))
    return F.when(text.rlike(r"^(0?[1-9]|1[0-2])/\d{4}$"), F.to_date(F.concat(F.lit("1/"), text), "d/M/yyyy"))


def month_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


# ---- lists ---------------------------------------------------------------


def id_list(c: Column | str) -> Column:
    """'12, x, 7' -> [12, 7]; null or blank text gives an empty list."""
    parts = F.transform(F.split(F.coalesce(col(c).cast("string"), F.lit("")), ","), lambda t: F.trim(t))
    whole = F.filter(parts, lambda t: t.rlike(r"^-?\d+$"))
    return F.transform(whole, lambda t: t.cast("long"))


def name_list(c: Column | str) -> Column:
    """Comma separated names, trimmed."""
    return F.transform(F.split(col(c), ","), lambda t: F.trim(t))


# ---- distance ------------------------------------------------------------


def half_chord_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared half chord of two points on the unit sphere (degrees in), clamped to [0, 1]."""
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    dlat, dlon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = dlat * dlat + F.cos(lat1) * F.cos(lat2) * dlon * dlon
    return F.when(a.isNotNull(), F.least(F.lit(1.0), a))


def great_circle_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    return F.asin(F.sqrt(half_chord_sq(lat1, lon1, lat2, lon2))) * F.lit(2.0 * radius)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
