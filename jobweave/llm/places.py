"""Reading free-typed locations against a reference list of places."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from jobweave.functions.identity import STATES
from jobweave.llm.strings import NgramIndex, edits, fold

#: Abbreviations of words in place names.
WORDS = {
    "mt": "mount", "mtn": "mountain", "mtns": "mountains", "ft": "fort", "frt": "fort", "pt": "port", "st": "saint", "ste": "saint", "lk": "lake", "n": "north", "no": "north",
    "s": "south", "so": "south", "e": "east", "w": "west", "spg": "springs", "spgs": "springs", "sprgs": "springs", "hts": "heights", "hgts": "heights", "hbr": "harbor",
    "harbour": "harbor", "fls": "falls", "jct": "junction", "jctn": "junction", "jn": "junction", "crk": "creek", "ck": "creek", "vlg": "village", "bch": "beach",
}
#: Words around a place that name none.
DECOR = {"hybrid", "onsite", "office", "offices", "hq", "headquarters", "area", "greater", "downtown", "metro", "metropolitan", "region", "campus", "based", "near", "city", "only", "within", "in-person", "usa", "us", "america", "site"}
#: Accepted from this cosine on, if no other name comes within the margin.
THRESHOLD, MARGIN = 0.20, 0.04

_COUNTRY = re.compile(r"\bunited states(?: of america)?\b|\bu\.\s?s\.(?:\s?a\.)?|\bu\.s\.?a?\b")
_REMOTE = re.compile(r"\b(?:fully |100% )?remote(?:ly)?\b|\bwork(?:ing)? from home\b|\bwfh\b|\banywhere(?: in(?: the)?)?\b|\btelecommut\w*\b|\bhome[- ]based\b")
_MANY = re.compile(r"\+\s*\d+\s*(?:more|others?)|\b\d+\s+(?:more\s+)?locations?\b|\bmultiple\b")
_SITE = re.compile(r"\bon[- ]?site\b|\bin[- ]office\b")
_TOKEN = re.compile(r"[a-z0-9.'#+]+|[^a-z0-9.'#+\s]")


@dataclass
class Places:
    """The reference list, or a part of it, and its index. ``rows``: (location_id, city, state_code, state_name, short_name); a row without a city is the remote one.

    ``whole`` has what a part must know of the whole list (``Whole``), so that it reads a text as the whole list does as far as its own entries go.
    """

    rows: list[tuple]
    whole: "Whole | None" = None
    forms: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.by_form: dict[str, list[int]] = {}
        self.state_of: dict[str, str] = {}
        self.remote = [r[0] for r in self.rows if not r[1]]
        self.info = {}
        words = set()
        for ident, city, code, name, short in self.rows:
            if not city:
                continue
            self.info[ident] = (fold(city), (code or "").lower())
            if code:
                self.state_of[code.lower()] = code.lower()
            if name and code:
                self.state_of[fold(name)] = code.lower()
            for form in {self.plain(fold(city)), *([self.plain(fold(short))] if short else [])}:
                self.by_form.setdefault(form, []).append(ident)
            words |= set(fold(city).split())
        self.forms = sorted(self.by_form)
        self.joined = [f.replace(" ", "") for f in self.forms]
        self.exact = {j: k for k, j in enumerate(self.joined)}
        self.longest = max(map(len, self.joined), default=0)
        self.index = NgramIndex(self.joined, *((self.whole.df, self.whole.total) if self.whole else ()))
        self.city_words = words | (self.whole.city_words if self.whole else set())
        self.state_of |= self.whole.states if self.whole else {}
        self.remote = self.remote or (self.whole.remote if self.whole else [])
        self.met: set[int] = set()
        # all states, also those without an entry, so that they are not taken for parts of a name
        self.state_of = {k: v for k, v in ({n: c for n, c in STATES.items()} | {c: c for c in STATES.values()} | self.state_of).items()}
        self.long_states = [s for s in self.state_of if len(s) > 4]
        self.two = {s for s in self.state_of if " " in s}
        self.cache: dict[str, tuple] = {}

    @staticmethod
    def plain(text: str) -> str:
        return " ".join(WORDS.get(t, t) for t in re.findall(r"[a-z0-9']+", text))

    def match(self, words: list[str]) -> tuple[list[int], bool]:
        """The entries of the name that the words spell, and whether several names fit equally."""
        cut = words[-1].endswith(".") and len(words[-1]) > 4
        words = [w.strip(".'") for w in words]
        name = "".join(WORDS.get(w, w) for w in words)
        if len(name) < 3 or len(name) > self.longest + 2:
            return [], False
        ids, tie = self._match(name, cut)
        self.met.update(ids)
        return ids, tie

    def _match(self, name: str, cut: bool) -> tuple[list[int], bool]:
        if name in self.exact:
            return self.by_form[self.forms[self.exact[name]]], False
        if cut:
            hits = [k for k, j in enumerate(self.joined) if j.startswith(name)]
            ids = sorted({i for k in hits for i in self.by_form[self.forms[k]]})
            return ids, len({self.info[i][0] for i in ids}) > 1
        allowed = 1 if len(name) < 7 else 2
        near = [(edits(name, self.joined[k], allowed), -s, k) for k, s in self.index.search(name) if s >= THRESHOLD and abs(len(self.joined[k]) - len(name)) <= allowed]
        near = sorted(x for x in near if x[0] <= allowed and len(self.joined[x[2]]) > 4)
        if not near:
            return [], False
        best = near[0]
        rivals = [x for x in near if x[0] == best[0] and x[1] - best[1] < MARGIN]
        ids = sorted({i for x in rivals for i in self.by_form[self.forms[x[2]]]})
        return ids, len({self.info[i][0] for i in ids}) > 1

    def state(self, words: list[str]) -> str | None:
        name = " ".join(w.strip(".") for w in words)
        if name in self.state_of:
            return self.state_of[name]
        if len(name) > 4:
            near = {self.state_of[s] for s in self.long_states if edits(name, s, 1 if len(name) < 8 else 2) <= (1 if len(name) < 8 else 2)}
            if len(near) == 1:
                return near.pop()
        return None

    def read(self, text: str | None) -> tuple[int, tuple[int, ...]]:
        """(the one entry that the text names or -1, all entries that it may mean). Nothing known: (-1, ())."""
        if text is None or not text.strip():
            return -1, ()
        if text not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[text] = self._read(fold(text))
        return self.cache[text]

    def _read(self, t: str) -> tuple[int, tuple[int, ...]]:
        many = bool(_MANY.search(t))
        t = _MANY.sub(" ; ", t)
        t = _SITE.sub(" onsite ", _COUNTRY.sub(" us ", t))
        remote = bool(_REMOTE.search(t))
        t = _REMOTE.sub(" , ", t)
        runs: list[list[str]] = [[]]
        strong = 0
        states: list[str] = []
        tokens = _TOKEN.findall(t)
        skip = 0
        for k, w in enumerate(tokens):
            if skip:
                skip -= 1
                continue
            bare = w.strip(".")
            if not bare:
                continue
            if not bare[0].isalnum():
                runs.append([])
                strong += w in ";/|·•&"
                continue
            if bare.isdigit():
                runs.append([])
                continue
            after = tokens[k + 1].strip(".") if k + 1 < len(tokens) else ""
            name_next = after.isalpha() and after not in self.state_of and after not in DECOR
            if bare == "or" and runs[-1] and name_next:  # a conjunction, not Oregon
                runs.append([])
                continue
            if bare in WORDS and not runs[-1] and name_next:  # Mt. Garnet, not Montana
                runs[-1].append(w)
                continue
            pair = f"{bare} {tokens[k + 1].strip('.')}" if k + 1 < len(tokens) else ""
            if pair in self.two:
                states.append(self.state_of[pair])
                runs.append([])
                skip = 1
            elif bare in self.state_of and (len(bare) == 2 or bare not in self.city_words):
                states.append(self.state_of[bare])
                runs.append([])
            elif bare in DECOR:
                runs.append([])
            elif bare in ("and", "or"):
                runs.append([])
            elif not remote and not runs[-1] and edits(bare, "remote", 1) <= 1:
                remote = True
            else:
                runs[-1].append(w)
        found: list[tuple[list[int], bool]] = []
        leftover = 0
        for run in [r for r in runs if r]:
            # neither a name and a state nor two names are as long as this
            if sum(len(w.strip(".'")) for w in run) > 2 * self.longest + 40:
                leftover += 1
                continue
            ids, tie = self.match(run)
            if not ids:
                state = self.state(run)
                if state:
                    states.append(state)
                    continue
                for cut in range(1, len(run)):
                    for part, rest in ((run[:-cut], run[-cut:]), (run[cut:], run[:cut])):
                        if not ids and len("".join(part)) > 3:
                            hit, t2 = self.match(part)
                            s = self.state(rest)
                            if hit and (s or (cut == 1 and len(rest[0]) <= 3)):
                                ids, tie = hit, t2
                                states += [s] if s else []
            if not ids and len(run) >= 3:  # two places written one after the other
                for cut in range(1, len(run)):
                    a, b = self.match(run[:cut]), self.match(run[cut:])
                    if a[0] and b[0]:
                        found += [a, b]
                        break
                else:
                    leftover += 1
            elif ids:
                found.append((ids, tie))
            elif len("".join(run)) > 2:
                leftover += 1
        names = {tuple(sorted({self.info[i][0] for i in ids})) for ids, _ in found}
        if not found:
            if remote and not leftover and self.remote and not many:
                return self.remote[0], tuple(self.remote)
            return -1, ()
        if len(names) > 1:
            # a state written for every name narrows each; "A or B, ST" leaves the first one open
            keep = sorted({i for ids, _ in found for i in ids if len(states) < len(names) or self.info[i][1] in states})
            return -1, tuple(keep)
        ids, _ = found[0]
        fit = [i for i in ids if self.info[i][1] in states] if states else list(ids)
        one = fit[0] if len(fit) == 1 and not many and not (leftover and not states) else -1
        return one, tuple(fit)


@dataclass
class Whole:
    """What every part of a long list must know of it: n-gram counts, the number of names, states, words of cities that are names of states too, the remote entry. All of it is bounded by alphabets and states."""

    df: dict[str, int]
    total: int
    states: dict[str, str]
    city_words: set[str]
    remote: list[int]
