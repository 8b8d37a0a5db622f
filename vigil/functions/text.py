"""Column functions over report text, names and labels; all native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, and the same letters without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Month names without marks.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
}
# Known spellings of one zone.
ZONE_ALIASES = {"GETHY": "GETY"}
# Short month labels.
SHORT_MONTHS = {
    "fr": ["janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc"],
    "en": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
}
#: The space between groups of thousands.
NARROW_SPACE = " "


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value in the plan and computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


# Fixed value: a place between a word character and none.
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with its \b between ASCII words, as in RE2 and in Java from 19 on; older Java knows more letters."""
    return re.sub(r"\\(.)", lambda m: EDGE if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def norm_int(c: Column) -> Column:
    """The digits as a number; null for none, NA and ND."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(~F.upper(F.trim(c)).isin("NA", "ND") & (digits != ""), digits.try_cast("bigint"))


def norm_pct(c: Column) -> Column:
    """The first d,d or d.d, else the first d%, else null."""
    both = F.regexp_extract(c, r"(\d+)[.,](\d+)", 0)
    whole = F.regexp_extract(c, r"(\d+)\s*%", 1)
    return F.coalesce(F.when(both != "", F.translate(both, ",", ".").try_cast("double")), F.when(whole != "", whole.try_cast("double")))


def strip_accents(c: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def _mapped(c: Column, values: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[c]


def month_number(c: Column) -> Column:
    """1 to 12 for a month's name with or without marks; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair)), strip_accents(F.trim(c)))


def zone_key_upper(c: Column, aliases: Mapping[str, str] = ZONE_ALIASES) -> Column:
    """Upper case, no trailing asterisks, runs of hyphens and spaces as one space, known aliases resolved."""
    key = F.upper(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), r"\*+$", "")), r"[-\s]+", " "))
    for alias, name in aliases.items():
        key = F.when(key == alias, F.lit(name)).otherwise(key)
    return key


def zone_key_tight(c: Column, tight: bool = True) -> Column:
    """Letters and digits without marks; other characters are dropped, or become single spaces if not `tight`."""
    loose = F.trim(F.regexp_replace(strip_accents(c), r"[^a-z0-9]+", " "))
    return F.replace(loose, F.lit(" "), F.lit("")) if tight else loose


def zone_key_lower(c: Column) -> Column:
    """Lower case, runs of hyphens and white space as one space."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", " ")


def report_id(name: Column) -> Column:
    """Three digits and an optional bis, ter or quater, as 093-bis; null without digits. Ids are ordered as text."""
    pattern = r"(\d{3})[-_]?(bis|ter|quater)?"
    number, suffix = F.regexp_extract(F.lower(name), pattern, 1), F.regexp_extract(F.lower(name), pattern, 2)
    return F.when(number != "", F.concat(number, F.when(suffix != "", F.concat(F.lit("-"), suffix)).otherwise("")))


def rate_class(c: Column) -> Column:
    """low below 30 or null, mid below 50, else high."""
    return F.when(c.isNull() | (c < 30), "low").when(c < 50, "mid").otherwise("high")


def intensity_level(c: Column, thresholds: Sequence[int] = (10, 50, 200)) -> Column:
    """0 without cases, else 1 and one more for each threshold reached."""
    reached = sum((F.when(c >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return F.when(F.coalesce(c, F.lit(0)) <= 0, 0).otherwise(reached + 1)


def fmt_int(c: Column, lang: str = "en") -> Column:
    """Thousands set apart by a comma, in French by a narrow space; a dash for null."""
    text = F.format_number(c, 0)
    return F.coalesce(F.replace(text, F.lit(","), F.lit(NARROW_SPACE)) if lang == "fr" else text, F.lit("—"))


def fmt_decimal(c: Column, lang: str = "en") -> Column:
    """One decimal, in French with a comma; a dash for null."""
    text = F.format_string("%.1f", F.round(c, 1))
    return F.when(c.isNull(), "—").otherwise(F.replace(text, F.lit("."), F.lit(",")) if lang == "fr" else text)


def date_label(c: Column, lang: str = "en", style: str = "short") -> Column:
    """short: day and month; long: with the year; week: dd/MM–dd/MM of the seven days from it."""
    if style == "week":
        return F.concat(F.date_format(c, "dd/MM"), F.lit("–"), F.date_format(F.date_add(c, 6), "dd/MM"))
    months = F.array(*(F.lit(m) for m in SHORT_MONTHS[lang]))
    short = F.concat(F.dayofmonth(c).cast("string"), F.lit(" "), F.element_at(months, F.month(c)))
    return F.concat(short, F.lit(" "), F.year(c).cast("string")) if style == "long" else short


def ordinal(c: Column, lang: str = "en") -> Column:
    """1st, 2nd, 3rd, 4th and 11th to 13th; 1re and 2ᵉ in French."""
    text = c.cast("string")
    if lang != "en":
        return F.when(c == 1, "1re").otherwise(F.concat(text, F.lit("ᵉ")))
    teen = (c % 100).between(11, 13)
    ending = F.when(teen, "th").when(c % 10 == 1, "st").when(c % 10 == 2, "nd").when(c % 10 == 3, "rd").otherwise("th")
    return F.concat(text, ending)


def interpolate(template: Column, values: Mapping[str, Column]) -> Column:
    """{key} becomes the value; {key?suffix} the suffix, unless the value's digits are just 1. Unknown keys stay."""
    out = template
    for key, value in values.items():
        one = F.regexp_replace(value.cast("string"), r"[^0-9]", "") == "1"
        kept = F.regexp_replace(out, r"\{%s\?([^{}]*)\}" % key, "$1")
        out = F.when(one, F.regexp_replace(out, r"\{%s\?[^{}]*\}" % key, "")).otherwise(kept)
    for key, value in values.items():
        out = F.replace(out, F.lit("{%s}" % key), value.cast("string"))
    return out


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """box: south, west, north, east, all included."""
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """A date, null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


# What names of no zone hold, and names that are none; openings of lines that are no zone rows.
PLACEHOLDERS = ("AUTRES ZONE", "NON PRÉCISÉE", "NON PRECISEE", "NON IDENTIFIÉE", "NON IDENTIFIEE")
NO_ZONES = ("Karissibi", "Kilo Mission")
OTHER_LINES = ("A VENTILER", "TOTAL", "AUTRES ZONES")


def is_placeholder(c: Column) -> Column:
    """Names that stand for cases of no named zone."""
    return reduce(or_, (F.upper(c).contains(x) for x in PLACEHOLDERS)) | c.isin(*NO_ZONES)


def is_non_zone(c: Column) -> Column:
    """Lines that open with a total or another heading of no zone."""
    return reduce(or_, (F.upper(F.trim(c)).startswith(x) for x in OTHER_LINES))
