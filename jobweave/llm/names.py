"""Reading organisation names typed by people: core words and what the organisation does."""

from __future__ import annotations

import re
from functools import lru_cache

from jobweave.llm.strings import edits, fold, jaro_winkler, skeleton

#: Words that say what an organisation does.
TRADES = (
    "aerospace airlines analytics bank bancorp biosciences biotech capital chemicals consulting design diagnostics dynamics education electric electronics energy engineering "
    "entertainment estates finance financial foods foundation games group health healthcare holdings hospital hotels industries instruments insurance interactive international "
    "investments labs laboratories logistics machines management manufacturing marine materials media medical metals mining mobility motors networks oil optics packaging partners payments "
    "pharma pharmaceuticals power press products properties publishing railways research resources retail robotics satellites securities security semiconductor semiconductors services shipping "
    "software solar solutions steel storage studios supply systems technologies technology telecom textiles therapeutics tobacco toys trading transport travel trust utilities ventures water works"
).split()
#: Trades whose usual abbreviation is not formed from their letters in order.
NICKNAMES = {"sw": "software", "tech": "technologies", "intl": "international", "semi": "semiconductor", "semis": "semiconductor", "bio": "biosciences", "biosci": "biosciences", "svcs": "services", "mgmt": "management", "technology": "technologies", "semiconductors": "semiconductor"}
#: Words about the legal form, the country or the page, which name nobody.
NOISE = {"inc", "llc", "ltd", "corp", "corporation", "company", "co", "llp", "plc", "gmbh", "incorporated", "limited", "ag", "sa", "lp", "pllc", "the", "careers", "career", "jobs", "us", "usa", "and", "of", "north", "america", "recruiting", "hiring"}

_BY_SKELETON: dict[str, list[str]] = {}
for _t in TRADES:
    _BY_SKELETON.setdefault(_t[0] + re.sub("[aeiou]", "", _t[1:]), []).append(_t)


def _inside(short: str, word: str) -> bool:
    at = iter(word)
    return all(c in at for c in short)


@lru_cache(maxsize=200_000)
def trade(token: str, dotted: bool = False) -> str | None:
    """The trade that a token spells, abbreviates or misspells, if exactly one fits."""
    if token in NICKNAMES:
        return NICKNAMES[token]
    if token in TRADES:
        return token
    if len(token) < 2:
        return None
    if token in _BY_SKELETON and len(_BY_SKELETON[token]) == 1:
        return NICKNAMES.get(_BY_SKELETON[token][0], _BY_SKELETON[token][0])
    if len(token) >= 5:
        near = [t for t in TRADES if abs(len(t) - len(token)) <= 1 and (len(t) > 4 or t[0] == token[0]) and edits(token, t, 1) <= 1]
        if len(near) == 1:
            return NICKNAMES.get(near[0], near[0])
    if len(token) == 4:
        near = [t for t in TRADES if t[0] == token[0] and len(t) == 4 and edits(token, t, 1) <= 1]
        if len(near) == 1:
            return near[0]
    vowels = sum(c in "aeiou" for c in token[1:])
    if len(token) <= 8 and (dotted or vowels == 0 or len(token) >= 3):
        start = [t for t in TRADES if t.startswith(token)]
        if start and len(token) >= 3:
            return NICKNAMES.get(min(start, key=len), min(start, key=len))
        if vowels <= max(1, len(token) // 4) or dotted:
            inner = [t for t in TRADES if t[0] == token[0] and t[-1] == token[-1] and _inside(token, t)]
            if not inner and vowels == 0:
                inner = [t for t in TRADES if t[0] == token[0] and _inside(token, t)]
            if len(inner) > 1:
                close = [t for t in inner if _inside(token, t[0] + re.sub("[aeiou]", "", t[1:]))]
                inner = close if len(close) == 1 else inner
            if len(inner) == 1:
                return NICKNAMES.get(inner[0], inner[0])
    return None


@lru_cache(maxsize=200_000)
def read_name(text: str | None) -> tuple[tuple[str, ...], str]:
    """(core words, sorted; trade or '') of a typed name; ((), '') if it holds no word.

    Legal forms, articles, countries and ``d/b/a`` additions are dropped, joined words are split at their capitals or before a trade, two owners are a
    name without a trade. A possessive marks a shortened core by a trailing ``*``.
    """
    if not text or not text.strip():
        return (), ""
    text = text.replace("&amp;", "&").replace("&#39;", "'").replace("’", "'")
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", text)
    plus = " + " in text
    t = fold(text)
    t = re.split(r"\bd\s*/?\s*b\s*/?\s*a\b|\bformerly\b|\bf/k/a\b", t)[0] or t
    t = re.sub(r"\bl\.?\s?l\.?\s?[cp]\b\.?", " ", t)
    short = bool(re.search(r"\w'\s*s?\s*$", t)) or bool(re.search(r"^\w+ s$", t.strip()))
    t = re.sub(r"'\s*s?\s*$|(?<=\w) s$", "", t.strip())
    host = re.fullmatch(r"(?:www\.|https?://)?([\w-]+)\.[a-z]{2,12}/?", t.strip())
    if host:
        t = host[1]
    words = [(w.strip("."), w.endswith(".")) for w in re.findall(r"[a-z0-9]+\.?", t)]
    words = [w for w in words if w[0]]
    kept = [w for w in words if w[0] not in NOISE] or words
    found, cores = "", []
    for w, dot in reversed(kept) if len(kept) > 1 else kept:
        kind = trade(w, dot) if len(kept) > 1 and not found else None
        if kind and (w in TRADES or w in NICKNAMES or len(cores) + 1 < len(kept) or cores):
            found = kind
        else:
            cores.append(w)
    if not cores:
        cores, found = [w for w, _ in kept], ""
    if len(cores) == 1 and not found and len(cores[0]) > 7:
        for t in sorted(TRADES, key=len, reverse=True):
            if cores[0].endswith(t) and len(cores[0]) - len(t) >= 4:
                cores, found = [cores[0][: -len(t)]], NICKNAMES.get(t, t)
                break
    if len(cores) > 1 and found == "partners" and (plus or len(cores) == 2):
        found = ""
    return tuple(sorted(c + "*" if short and len(cores) == 1 else c for c in cores)), found


def same_word(a: str, b: str) -> bool:
    """Whether two core words may be one: a typo apart, or one cut short by its last syllable."""
    x, y = a.rstrip("*"), b.rstrip("*")
    if x == y:
        return True
    low, high = sorted((x, y), key=len)
    if len(low) < 4:
        return False
    if high.startswith(low) and len(high) - len(low) <= 3:
        return True
    return jaro_winkler(x, y) >= 0.85 and edits(x, y, 1) <= 1


def same_name(a: tuple[tuple[str, ...], str], b: tuple[tuple[str, ...], str]) -> bool:
    """Whether two read names with as many core words and the same trade are spellings of one."""
    (x, s), (y, t) = a, b
    if s != t or len(x) != len(y):
        return False
    if len(x) == 1:
        return same_word(x[0], y[0])
    return all(same_word(p, q) for p, q in zip(x, y)) or (len(x) == 2 and same_word(x[0], y[1]) and same_word(x[1], y[0]))


def codes(word: str) -> set[str]:
    """Phonetic code of a word, and the code with each one sign left out, so that a lost or changed consonant still meets. Codes end after six signs, so that a word and one cut short meet: blocks get coarser by it, and none loses a pair."""
    c = skeleton(word.rstrip("*"))[:6]
    out = {c} | {c[:k] + c[k + 1 :] for k in range(len(c))}
    return {x for x in out if len(x) > (len(c) > 3)} or {c}
