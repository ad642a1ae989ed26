"""String measures and the character n-gram inverted index. Pure Python, run on distinct values only."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache


def fold(text: str) -> str:
    """Lower case, compatibility forms resolved, accents removed."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent transpositions (optimal string alignment), or ``most + 1`` when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        older, row = row, new
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with Winkler's bonus for up to four common leading characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def grams(text: str) -> Counter:
    """Character 2- and 3-grams of the text between boundary marks."""
    marked = f"^{text}$"
    return Counter(marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1))


class NgramIndex:
    """Inverted index of character n-grams over a list of names, searched by idf-weighted cosine.

    ``df`` and ``total``: in how many names of how many each n-gram is, where ``names`` are a part of a longer list.
    """

    def __init__(self, names: list[str], df: dict[str, int] | None = None, total: int | None = None):
        self.names = names
        counts = [grams(n) for n in names]
        df = df or Counter(g for c in counts for g in c)
        total = total or len(names)
        self.top = math.log(1 + total)
        self.idf = {g: math.log(1 + total / n) for g, n in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(counts):
            norm = math.sqrt(sum((v * self.idf[g]) ** 2 for g, v in c.items())) or 1.0
            for g, v in c.items():
                self.postings[g].append((k, v * self.idf[g] / norm))

    def search(self, text: str, most: int | None = None) -> list[tuple[int, float]]:
        """(position, cosine) of every name with a common n-gram, or of the ``most`` best, best first; ties by position."""
        scores: dict[int, float] = defaultdict(float)
        norm = 0.0
        for g, v in grams(text).items():
            w = v * self.idf.get(g, self.top)
            norm += w * w
            for k, x in self.postings.get(g, ()):
                scores[k] += w * x
        norm = math.sqrt(norm) or 1.0
        return [(k, s / norm) for k, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most]]


@lru_cache(maxsize=100_000)
def skeleton(token: str) -> str:
    """Phonetic code of a token: its consonants in order, each class by one sign, doubles and vowels dropped; a leading vowel is ``a``."""
    same = {"c": "k", "q": "k", "z": "s", "x": "s", "d": "t", "y": "", "h": "", "w": "v", "p": "b", "g": "j"}
    out = []
    for k, c in enumerate(token):
        code = "" if c in "aeiou" else same.get(c, c)
        if k == 0 and not code:
            code = "a" if c in "aeiouy" else c
        if code and (not out or out[-1] != code):
            out.append(code)
    return "".join(out)
