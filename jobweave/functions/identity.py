"""Keys by which postings are recognised, as column expressions."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.text import normalize_text, trim_space

#: States and their codes, words for the country, spellings of several places.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl",
    "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
COUNTRY_WORDS = ["united states", "united states of america", "usa", "us", "u s", "u s a", "america"]
SEVERAL_PLACES = r"(?i)\+\s*\d|\b\d+\s+locations?\b|\bmultiple\b|\bvarious\b"
#: Words of titles that differ between lists, and those that carry no identity.
TITLE_NOISE = r"^(intern|interns|internship|internships|co|op|coop|summer|fall|winter|spring|20\d\d|the|and|or|a|an|of|for|at|in|to|program|programme)$"
FILLER = r"^(intern|interns|internship|internships|co|op|coop|summer|fall|winter|spring|20\d\d|program|programme|the|and|or|a|an|of|for|at|in|to|new|grad|graduate|student|campus|university|undergrad|undergraduate|masters|phd)$"
EARLY = r"(?i)intern|co-?op|summer analyst|summer associate|campus|graduate program"
LEGAL_SUFFIX = r"(?i)\b(incorporated|inc|llc|ltd|corporation|corp|company|co)\.?$"


def company_key(company: Column) -> Column:
    """A company name in plain form without one legal suffix, before any alias is looked up."""
    return normalize_text(F.regexp_replace(company, LEGAL_SUFFIX, ""))


def location_parts(location: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    parts = F.filter(F.transform(F.split(location, "[;,]"), lambda p: normalize_text(p)), lambda p: (p != "") & ~p.isin(COUNTRY_WORDS))
    return F.transform(parts, lambda p: F.coalesce(F.element_at(codes, p), p))


def canonical_location(location: Column) -> Column:
    """Parts of a place in plain form, states as codes, the country dropped unless nothing else is written."""
    parts = location_parts(location)
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(normalize_text(location))


def location_bucket(location: Column, normalized: Column) -> Column:
    """``*`` for text that names several places, else the canonical place."""
    parts = location_parts(location)
    return F.when(location.rlike(SEVERAL_PLACES) | (F.size(parts) >= 3), "*").when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(normalized)


def title_signature(normalized_title: Column) -> Column:
    """The distinct words of a title that carry meaning, cut to five characters, sorted and joined; '' if there are none."""
    words = F.filter(F.split(normalized_title, "[^a-z0-9+#]+"), lambda w: (w != "") & ~w.rlike(TITLE_NOISE))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 5)))), ".")


def requisition_signature(company: Column, title: Column, cycle: Column) -> Column:
    """company|cycle|signature, or null for a title that says nothing (such rows are never grouped)."""
    s = title_signature(title)
    return F.when(s != "", F.concat_ws("|", company, F.coalesce(cycle, F.lit("")), s))


def material_fingerprint(title: Column, location: Column, cycle: Column) -> Column:
    plain = normalize_text(title)
    return F.sha2(F.concat_ws("|", F.coalesce(F.nullif(title_signature(plain), F.lit("")), plain), canonical_location(location), cycle), 256)


def canonical_key(source: Column, ident: Column, url: Column, company: Column, title: Column, location: Column, cycle: Column) -> Column:
    """Hash of the first that there is: the source's id, the address, the descriptive parts."""
    ident = trim_space(F.coalesce(ident, F.lit("")))
    basis = F.when(ident != "", F.concat(F.lit("id:"), normalize_text(source), F.lit(":"), ident)).when(url.startswith("http"), F.concat(F.lit("url:"), url))
    parts = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (company, title, location, cycle)])
    return F.sha2(F.coalesce(basis, F.concat(F.lit("tuple:"), parts)), 256)


def identity_words(normalized_title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized_title, " "), lambda w: (F.length(w) > 2) & ~w.rlike(FILLER)))


def _overlap(x: Column, y: Column) -> tuple[Column, Column, Column]:
    return F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))


def titles_describe_one_role(a: Column, b: Column) -> Column:
    """Equal, or alike in at least 4/5 of the shorter and 3/5 of the longer title's meaningful words."""
    return (a == b) | words_describe_one_role(identity_words(a), identity_words(b))


def words_describe_one_role(x: Column, y: Column) -> Column:
    """The test on the words themselves, for callers that compare many pairs."""
    shared, low, high = _overlap(x, y)
    return F.coalesce((low > 0) & (shared >= 0.8 * low) & (shared >= 0.6 * high), F.lit(False))


def same_employer(a: Column, b: Column) -> Column:
    """Equal in plain form, or one contains the other and both have more than two characters."""
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) > 2) & (F.length(b) > 2) & (F.contains(a, b) | F.contains(b, a))))


def describes_same_role(a: Column, b: Column) -> Column:
    """Both early-career or neither, and alike in 7/10 of the shorter title's meaningful words."""
    return (a.rlike(EARLY) == b.rlike(EARLY)) & words_describe_same_role(identity_words(normalize_text(a)), identity_words(normalize_text(b)))


def words_describe_same_role(x: Column, y: Column) -> Column:
    shared, low, _ = _overlap(x, y)
    return (low > 0) & (shared >= 0.7 * low)


def digest_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(ids), "|"), 256)


def batch_key(ids: Column, at: Column) -> Column:
    """The hour and the hash of the ids, whatever their order."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH"), F.lit(":"), F.substring(digest_hash(ids), 1, 24))


def sign_id(ident: Column, secret: str) -> Column:
    """Keyed hash of an id (HMAC-SHA256, 32 hex digits); Python, as the JVM functions have no keyed hash."""

    @F.pandas_udf("string")
    def sign(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret.encode(), v.encode(), hashlib.sha256).hexdigest()[:32])

    return sign(ident)
