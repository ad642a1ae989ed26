"""Parsing of written dates and times, as JVM-side expressions (no Python per row).

Each recognised family of spellings is rewritten by one ``regexp_replace`` into the same nine fields
``year|month|day|hour|minute|second|fraction|am-pm|zone``, which are split and assembled once.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes east of UTC of the zone abbreviations that are understood.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "IST": 330,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
#: Microseconds of the units of an age, by the first letters that tell them apart.
AGE_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 7 * 86_400, "mo": 30 * 86_400, "y": 365 * 86_400}

_SPACE = r"[\s\u00A0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
_ZONE = r"(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Z]+(?:/[A-Z_+\-0-9]+)+)?"
_MONTH = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*"
_DAYNAME = r"(?:(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*,? )?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: pattern, replacement, and whether the first two fields follow the source's date order
_FAMILIES = [
    (rf"(?i)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]{_CLOCK})? ?([AP]M(?![A-Z]))? ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}}):?(\d{{2}}):?(\d{{2}})?(?:\.(\d{{1,9}}))?)? ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"(?i)^{_DAYNAME}(\d{{1,2}})[ -]{_MONTH}\.?,?[ -](\d{{4}}|\d{{2}})(?:,? {_CLOCK})? ?([AP]M(?![A-Z]))? ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^{_DAYNAME}{_MONTH}\.? (\d{{1,2}})(?:ST|ND|RD|TH)?,? (\d{{4}})(?:,? (?:AT )?{_CLOCK})? ?([AP]M(?![A-Z]))? ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"(?i)^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:,? {_CLOCK})? ?([AP]M(?![A-Z]))? ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
_AGE = r"(?i)^(?:posted )?(\d{1,6}) ?(?:(s|m|h|d|w|y)|(s)ec(?:ond)?s?|(m)in(?:ute)?s?|(h)(?:ou)?rs?|(d)ays?|(w)(?:ee)?ks?|(mo)(?:nth)?s?|(y)(?:ea)?rs?)(?: ago)?$"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_space(value: Column) -> Column:
    """Runs of white space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, _SPACE, " "))


def looks_like_age(value: Column) -> Column:
    return clean_space(value).rlike(_AGE) | clean_space(value).rlike(r"(?i)^(?:posted )?(?:today|yesterday|just now)$")


def age_us(clean: Column) -> Column:
    """Microseconds of an age such as ``14h``, ``3 weeks ago`` or ``Posted 5 Days Ago``; null for anything else."""
    return bind(clean, _age_us)


def _age_us(clean: Column) -> Column:
    unit = F.lower(F.concat_ws("", *(F.regexp_extract(clean, _AGE, k) for k in range(2, 10))))
    seconds = reduce(lambda c, kv: c.when(unit == kv[0], F.lit(kv[1])), AGE_UNITS.items(), F.when(F.lit(False), F.lit(0))).cast("long")
    count = F.regexp_extract(clean, _AGE, 1).try_cast("long")
    words = F.when(clean.rlike(r"(?i)^(?:posted )?yesterday$"), F.lit(86_400 * 1_000_000).cast("long")).when(clean.rlike(r"(?i)^(?:posted )?(?:today|just now)$"), F.lit(0).cast("long"))
    return F.when(clean.rlike(_AGE), count * seconds * 1_000_000).otherwise(words)


def instant_us(clean: Column, zone: Column, order: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of an absolute time, or null.

    ``zone`` is the IANA zone and ``order`` the order (MDY, DMY, YMD) of text that names none. A day alone is its start. A local
    time that occurs twice is the first, one that was skipped is read with the offset before the change (the rules of java.time,
    which ``to_utc_timestamp`` follows). Numeric dates that are impossible in the source's order are read in the other one.
    """
    def rewritten(text: Column) -> Column:
        fields = F.lit(None).cast("string")
        for k, (pattern, to) in reversed(list(enumerate(_FAMILIES))):
            fields = F.when(text.rlike(pattern), F.concat(F.regexp_replace(text, pattern, to), F.lit(f"|{k}"))).otherwise(fields)
        return F.split(fields, r"\|", -1)

    epoch = lambda t: F.when(t.rlike(r"^\d{10}$"), t.try_cast("long") * 1_000_000).when(t.rlike(r"^\d{13}$"), t.try_cast("long") * 1_000).when(t.rlike(r"^\d{16}$"), t.try_cast("long"))
    return bind(clean, lambda t: F.when(t.rlike("^[0-9]{9,}$"), epoch(t)).otherwise(bind(rewritten(t), lambda parts: _assemble(parts, zone, order))))


def _assemble(parts: Column, zone: Column, order: Column) -> Column:
    """The instant of the split fields."""
    item = lambda k: F.try_element_at(parts, F.lit(k + 1))
    whole = lambda k: item(k).try_cast("int")
    numeric = item(9) == "4"
    first, second, third = whole(1), whole(2), whole(0)
    by_name = (F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.upper(item(1))) + 2) / 3
    month_first = F.when(order == "DMY", second > 12).otherwise(first <= 12)
    two_digit_ymd = numeric & (order == "YMD") & (F.length(item(0)) == 2)
    century = lambda y: F.when(y < 100, y + F.when(y < 70, 2000).otherwise(1900)).otherwise(y)
    year = century(F.when(two_digit_ymd, first).otherwise(third))
    month = F.when(two_digit_ymd, second).when(numeric, F.when(month_first, first).otherwise(second)).when(item(1).rlike("^[0-9]+$"), first).otherwise(by_name.cast("int"))
    day = F.when(two_digit_ymd, third).when(numeric, F.when(month_first, second).otherwise(first)).otherwise(second)
    half, hour = F.upper(item(7)), F.coalesce(whole(3), F.lit(0))
    hour = F.when(half == "", hour).when(~hour.between(1, 12), None).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    second_ = F.concat(F.when(item(5) == "", "0").otherwise(item(5)), F.lit("."), F.rpad(F.substring(item(6), 1, 6), 6, "0")).try_cast("decimal(16,6)")
    local = F.try_make_timestamp(year, month, day, hour, F.coalesce(whole(4), F.lit(0)), second_, F.lit("UTC"))
    written, offset = item(8), r"(?i)^(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?$"
    minutes = reduce(lambda c, kv: c.when(F.upper(written) == kv[0], F.lit(kv[1])), ZONE_MINUTES.items(), F.when(written.rlike(offset), F.when(F.regexp_extract(written, offset, 1) == "-", -1).otherwise(1) * (F.regexp_extract(written, offset, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(written, offset, 3).try_cast("int"), F.lit(0)))))
    known = sorted(zoneinfo.available_timezones())
    named = F.when(written == "", zone).otherwise(written)
    named = F.when(named.isin(known), named)
    return bind(local, lambda at: bind(minutes, lambda m: F.when(m.isNotNull(), F.unix_micros(at) - m.cast("long") * 60_000_000).otherwise(F.unix_micros(F.to_utc_timestamp(at, named)))))
