"""Reading posting titles: what the role and team are, the recruiting cycle, and a place written into the title."""

from __future__ import annotations

import re

from jobweave.llm.places import Places
from jobweave.llm.strings import edits, fold

#: Words of titles that are written in several ways, by what they are read as.
FORMS = {
    "engineer": "engineering eng engr engineers developer developers", "scientist": "science sciences sci scientists", "analyst": "analytics analysts analysis", "manager": "mgr mgmt management managers",
    "trader": "trading traders", "researcher": "research rsch researchers resch", "quantitative": "quant quants", "corporate": "corp", "finance": "fin financial", "investment": "inv invest investments",
    "solutions": "solution soln solns", "software": "sw s/w", "hardware": "hw h/w", "software engineer": "swe sde", "site reliability engineer": "sre", "machine learning engineer": "mle",
    "machine learning": "ml", "product manager": "pm", "investment banking": "ib ibd", "private equity": "pe", "wealth manager": "wm", "data scientist": "ds", "experience": "exp", "optimization": "opt optimisation",
    "automation": "autom auto", "services": "svcs svc service", "foundations": "fndns foundation fndn", "systems": "sys system", "platform": "plat platforms", "reliability": "rel", "robotics": "robotic",
    "security": "sec", "embedded": "emb", "mobile": "mob", "frontend": "front-end front", "backend": "back-end back", "devops": "dev-ops", "operations": "ops", "product": "prod", "infrastructure": "infra",
}
#: Further words of roles, as they are.
ROLE_WORDS = "backend banking data devops embedded equity frontend fullstack learning machine private site treasury wealth design designer marketing sales legal accounting audit tax risk".split()
#: Words of a title that tell nothing about role or team.
NOISE = (
    "intern interns internship internships student students coop co-op trainee placement program programme hiring now new paid urgent job jobs position role opportunity class of fo the a an and for in at "
    "year term semester quarter summer fall autumn spring winter later compatible season open apply us usa end graduate undergrad undergraduate"
).split()
SEASONS = {"summer": "Summer", "fall": "Fall", "autumn": "Fall", "spring": "Spring", "winter": "Winter"}
_SHORT_SEASON = {"su": "Summer", "sum": "Summer", "fa": "Fall", "f": "Fall", "sp": "Spring", "spr": "Spring", "us": "Summer", "wi": "Winter", "w": "Winter", "win": "Winter"}
#: Finance roles whose title may or may not end in "analyst".
_DESKS = {"treasury", "wealth", "equity", "banking", "corporate"}
LATER = "Later compatible"

_CYCLE_SHORT = re.compile(r"\b(su|us|sum|fa|sp|spr|wi|win|f|w)['’]?\s?(?:20)?(2[3-9]|3[0-5])\b")
_YEAR = re.compile(r"(?<![\w.])(?:class of\s+)?['’‘]?(?:20)?(2[3-9]|3[0-5])(?![\w.%])")
_DIGITS = re.compile(r"[0-9]{2}")
_SEASONLIKE = re.compile(r"[a-z]{4,7}")
_SEGMENT = re.compile(r"\s+[-–—|/·•]+\s+|:\s|[(),;\[\]|*]|\s[-–—]|[-–—]\s|$")
_WORD = re.compile(r"s/w|h/w|co-op|front[- ]end|back[- ]end|dev[- ]ops|[a-z0-9]+(?:['’][a-z]+)?\.?")
#: A token of at least this share of all titles counts as correctly written; at most 1/share times the tokens of a title can.
STANDARD_SHARE = 0.001


def standard_tokens(counts: dict[str, int], titles: int) -> dict[str, int]:
    """The tokens frequent enough to be spellings in their own right, without slips of tokens four times as frequent."""
    often = {t: n for t, n in counts.items() if n >= max(3, STANDARD_SHARE * titles) and len(t) > 2 and t.isalpha()}
    return {t: n for t, n in often.items() if not any(m >= 4 * n and u[:1] <= "z" and edits(t, u, 1) <= 1 and len(t) > 3 for u, m in often.items() if u != t)}


def title_tokens(text: str) -> list[str]:
    return [w.rstrip(".") for w in _WORD.findall(fold(text))]


class Titles:
    """Reader of titles. ``standard``: tokens of the corpus taken as correct, with their counts; ``places``: the list for places within titles."""

    def __init__(self, standard: dict[str, int] | None = None, places: Places | None = None):
        self.places = places
        self.to: dict[str, tuple[str, ...]] = {}
        for target, words in FORMS.items():
            for w in [*words.split(), *([target] if " " not in target else [])]:
                self.to[w] = tuple(target.split())
        for w in ROLE_WORDS:
            self.to.setdefault(w, (w,))
        for w in NOISE:
            self.to[w] = ()
        self.rank = dict.fromkeys(self.to, 1 << 40)
        cities = places.city_words if places else set()
        for w, n in (standard or {}).items():
            if w not in self.to and w not in cities and w not in ("remote", "hybrid", "onsite"):
                self.to[w] = (w,)
                self.rank[w] = n
        self.near: dict[str, set[str]] = {}
        for w in self.to:
            if len(w) > 3 and w.isalpha():
                for v in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
                    self.near.setdefault(v, set()).add(w)
        self.seasons: dict[str, tuple[str, bool]] = {}
        self.long = [w for w in self.to if len(w) > 5 and w.isalpha()]
        self.tokens: dict[str, tuple[tuple[str, ...], bool]] = {}
        self.segments: dict[str, tuple[tuple[str, ...], tuple[int, ...]]] = {}

    def _token(self, raw: str) -> tuple[tuple[str, ...], bool]:
        """(what the token is read as, whether it is known)."""
        w = raw.rstrip(".").replace(" ", "-") if raw not in self.to else raw
        if w in self.to:
            return self.to[w], True
        joined = w.replace("-", "")
        if joined in self.to:
            return self.to[joined], True
        if len(w) < 2 or w.isdigit():
            return (), True
        if raw.endswith(".") and len(w) > 2:
            start = [t for t in self.to if t.startswith(w) and len(self.to[t]) == 1]
            if start:
                return self.to[max(start, key=lambda t: (self.rank[t], t))], True
        if len(w) > 2:
            close = {t for v in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))} for t in self.near.get(v, ()) if edits(w, t, 1) <= 1}
            if close:
                return self.to[max(close, key=lambda t: (self.rank[t], t))], True
            if len(w) > 5:  # two slips in one word
                far = {t for t in self.long if abs(len(t) - len(w)) <= 2 and edits(w, t, 2) <= 2}
                if far:
                    return self.to[max(far, key=lambda t: (t[0] == w[0], self.rank[t], t))], False
            if len(w) == 3:
                for v in (w[1] + w[0] + w[2], w[0] + w[2] + w[1]):
                    if v in self.to:
                        return self.to[v], True
        for k in range(3, len(w) - 2):  # two words run together, perhaps with a slip for the blank
            for right in (w[k:], w[k + 1 :]):
                if w[:k] in self.to and right in self.to and len(right) > 2:
                    return self.to[w[:k]] + self.to[right], True
        return (w,), False

    def _segment(self, text: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
        got = []
        known = True
        for w in _WORD.findall(text):
            if w not in self.tokens:
                if len(self.tokens) > 300_000:
                    self.tokens.clear()
                self.tokens[w] = self._token(w)
            t, ok = self.tokens[w]
            got += t
            known = known and ok
        if not known and self.places:
            one, many = self.places.read(text)
            if many:
                return (), many
        if self.places and not got and "remote" in text:
            return (), self.places.read(text)[1]
        return tuple(got), ()

    def _season(self, w: str) -> tuple[str, bool]:
        """(the season that a word spells, or misspells, or ''; whether it is spelt right)."""
        if w in SEASONS:
            return SEASONS[w], True
        if w in self.to or (self.places and w in self.places.city_words):
            return "", False
        if w in ("flal", "fll", "afll", "falll"):
            return "Fall", False
        near = [v for s, v in SEASONS.items() if len(s) > 4 and len(w) > 4 and edits(w, s, 1) <= 1]
        return (near[0] if near else ""), False

    def read(self, title: str | None) -> tuple[str, str, tuple[int, ...]]:
        """(signature: the sorted words of role and team, cycle or '', entries of a place named in the title)."""
        if not title or not title.strip():
            return "", "", ()
        text = " ".join(fold(title).replace("&amp;", "&").split())
        years, seasons = [], []
        if _DIGITS.search(text):
            for s, y in _CYCLE_SHORT.findall(text):
                seasons.append(_SHORT_SEASON[s])
                years.append(2000 + int(y))
            if years:
                text = _CYCLE_SHORT.sub(" ", text)
            found = _YEAR.findall(text)
            if found:
                years += [2000 + int(y) for y in found]
                text = _YEAR.sub(" ", text)
        for w in _SEASONLIKE.findall(text):
            if w not in self.seasons:
                if len(self.seasons) > 300_000:
                    self.seasons.clear()
                self.seasons[w] = self._season(w)
            s, exact = self.seasons[w]
            if s and (exact or years):
                seasons.append(s)
        cycle = f"{seasons[0]} {years[0]}" if seasons and years else LATER if years and years[0] >= 2028 or "later compatible" in text else ""
        words: set[str] = set()
        places: tuple[int, ...] = ()
        for seg in _SEGMENT.split(text):
            seg = seg.strip()
            if not seg:
                continue
            if seg not in self.segments:
                if len(self.segments) > 200_000:
                    self.segments.clear()
                self.segments[seg] = self._segment(seg)
            got, where = self.segments[seg]
            words.update(got)
            places = places or where
        if words & _DESKS:
            words.discard("analyst")
        return " ".join(sorted(words)), cycle, places
