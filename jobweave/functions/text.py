"""Text functions, as column expressions."""

from __future__ import annotations

import json
import re
import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word edges; ``\b`` of the JVM also sees accented letters.
EDGE_LEFT, EDGE_RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: White space including the kinds that the JVM's ``\s`` leaves out.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str]:
    """(JSON object: each character whose compatibility form, in lower case, holds what ``normalize_text`` keeps, with that form; pattern of letters that compose with the mark after them).

    Both follow from the character database by rule: what becomes a blank with and without the forms needs no entry.
    """
    kept = re.compile("[a-z0-9+#.&;]")
    forms = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x1F000)]):
        form = unicodedata.normalize("NFKC", c)
        if form != c and kept.search(form.lower()):
            forms[c] = form
    pairs = []
    for base in string.ascii_letters:
        marks = "".join(m for m in map(chr, range(0x300, 0x370)) if unicodedata.normalize("NFC", base + m)[0] != base)
        if marks:
            pairs.append(f"{base}[{marks}]")
    return json.dumps(forms, ensure_ascii=False), "|".join(pairs)


def compatible(value: Column) -> Column:
    """Compatibility forms (NFKC) resolved as far as they lead to characters that ``normalize_text`` keeps, in the JVM. ASCII text, which is nearly all, costs one look."""
    forms, pairs = _compatible()
    table = F.from_json(F.lit(forms), "map<string,string>")
    composed = F.regexp_replace(value, pairs, "\u00e9")  # what composes is kept by no later step
    each = F.transform(F.split(composed, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_element_at(table, c), c)).otherwise(c))
    return F.when(value.rlike(r"[^\x00-\x7F]"), F.array_join(each, "")).otherwise(value)


def trim_space(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(value: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, rf"{SPACE}+", " "))


def normalize_text(value: Column) -> Column:
    """Compatibility forms resolved, lower case, ``&amp;`` decoded, everything but letters, digits and ``+ # .`` one blank, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.replace(F.lower(compatible(value)), F.lit("&amp;"), F.lit("&")), "[^a-z0-9+#.]+", " "))


def _replace_all(value: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, to in pairs:
        value = F.regexp_replace(value, pattern, to)
    return value


def extract_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags dropped, the usual entities decoded, white space squeezed."""
    bare = _replace_all(html, [(r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " "), ("<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&#x27;|&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")])
    return squeeze(bare)


#: Entities that a summary decodes, ``&amp;`` last.
_ENTITIES = [("(?i)&(?:nbsp|#160|#x00a0);", " "), ("(?i)&(?:lt|#60|#x3c);", "<"), ("(?i)&(?:gt|#62|#x3e);", ">"), ("(?i)&(?:quot|#34|#x22);", '"'), ("(?i)&(?:apos|#39|#x27);", "'"), ("(?i)&(?:amp|#38|#x26);", "&")]
#: Fixed value: what stands where a source gave no text.
NO_SUMMARY = "The source did not provide a verifiable description summary."


def short_summary(description: Column, length: int = 280) -> Column:
    """The first characters of a description: entities decoded twice (boards encode them twice), tags dropped. A set sentence if nothing is left."""
    once = _replace_all(F.coalesce(description, F.lit("")), _ENTITIES)
    text = squeeze(F.regexp_replace(_replace_all(once, _ENTITIES), "<[^>]*>", " "))
    return F.when(text == "", F.lit(NO_SUMMARY)).otherwise(F.substring(text, 1, length))


def escape_html(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def clean_cell(cell: Column) -> Column:
    """The words of a table cell: links as their labels, tags, emphasis and odd blanks dropped."""
    return squeeze(_replace_all(cell, [(r"\[([^\]]+)\]\(https?://[^)]+\)", "$1"), ("<[^>]*>", " "), ("&nbsp;|&#x200B;", " "), (r"\*\*", "")]))


#: Words at the end of a name that a board's address may leave out.
SLUG_SUFFIX = r"\b(inc|corp|corporation|technologies|technology|labs|group|holdings|company|co)\b"


def slug_candidates(name: Column) -> Column:
    """Up to three distinct addresses that a board of this name may have, the full name before the one without its suffix."""
    base = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""))
    short = F.trim(F.regexp_replace(base, SLUG_SUFFIX, ""))
    joined = lambda c: [F.regexp_replace(c, r"\s+", ""), F.regexp_replace(c, r"\s+", "-")]
    more = F.when((short != "") & (short != base), F.array(*joined(short))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.filter(F.array_distinct(F.concat(F.array(*joined(base)), more)), lambda s: F.length(s) > 2), 1, 3)
