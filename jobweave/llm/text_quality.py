"""Per-document text quality statistics (problem 10).

A document is split into chunks of bounded length; each gives associative partial counts, with the state of its first and last partial line and the
character before it, so that neither words nor lines that cross a boundary are miscounted. Partial counts of long documents are merged in a tree, then
ratios and rule outcomes are derived.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import bounded, spread
from jobweave.session import write_shared

#: Characters of a chunk, and how far a boundary may move to the next white space; a longer run without any is cut hard.
CHUNK, SLACK = 60_000, 1_000
#: Characters kept of either end of a line that is open at a boundary.
KEPT = 2_000
#: Partial counts merged at once in a node of the tree.
FANOUT = 16
#: Words and tokens whose properties a task remembers.
REMEMBERED = 300_000
#: A list of common words longer than this is refused.
MAX_COMMON = 20_000

COUNTS = [
    "chars", "letters", "digits", "symbols", "words", "word_chars", "upper_words", "common", "tokens", "odd_tokens", "damaged", "long_tokens", "code_tokens", "ends", "commas",
    "lines", "line_ends", "bullet_lines", "cell_lines", "pair_lines", "short_lines", "list_words", "cell_words", "sentence_lines", "sentence_words", "phrases",
]
_AT = {c: k for k, c in enumerate(COUNTS)}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_PLAIN = re.compile(r"[\w\s]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_BULLET = re.compile(r"(?:[-*•–—▪·+✓»]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|<li>)\s*\S")
_BEFORE = re.compile(r"[.,;:!?](?<!\S.)[.,;:!?]*[^\W\d_]{2}")
_DAMAGE = re.compile(r"[^\W\d_][^\w\s'’.,;:!?()/&@+#*-]+[^\W\d_]|�")
_ODD = re.compile(r"[^\w\s'’.,;:!?()/&+@#*-]")
_CODE = re.compile(r"[{}=<>$]|::|\(\)|^[0-9a-fA-F]{6,}$|^[0-9a-fA-F]{2}$|^https?://|[A-Za-z0-9+/]{24,}|\d{2}:\d{2}|\d{4}-\d{2}")
_END = re.compile(r"[.!?…:;][\"'»”’)\]]*$")
_PIECE = re.compile(r"\s[·|»›•–/]+\s|\s{2,}|!{2,}|[\U0001F000-\U0001FAFF☀-➿]+")
_ENDS = re.compile("[.!?…]")
_MARK = re.compile(r"[·|»›•–/!\U0001F000-\U0001FAFF☀-➿]")
_STOP = re.compile(r"(?:\.+|(?<!!)!|\?|…)[\"'»”’)\]]*(?=\s|$)")
_CELL = re.compile(r"\t|\s*\|+\s*|;|\s{3,}")
_PAIR = re.compile(r"^[^\W\d_][\w ]{0,24}:\s+\S")


def _spaced(text: str) -> bool:
    """Whether all white space of a text is single blanks between its parts; most lines are like this and need no splitting."""
    return text.count(" ") == len(text.split()) - 1


def _cells(text: str) -> int:
    if "|" not in text and ";" not in text and _spaced(text):
        return 1
    return sum(1 for c in _CELL.split(text) if c)


def _pieces(text: str) -> int:
    if not _MARK.search(text) and _spaced(text):
        return 1
    return sum(1 for x in _PIECE.split(text) if x.strip())


def _bare(text: str) -> str:
    """The text with a blank for every tag."""
    return _TAG.sub(" ", text) if "<" in text else text


class Line(NamedTuple):
    """A line, or a part of one: its text if short, else its two ends, and what was counted in all of it.

    ``cells`` and ``pieces`` are counted where the text itself is not kept; across a boundary they are corrected by what the two ends give joined. Only where all of an
    end (2,000 characters) is separators can the correction be wrong, by one.
    """

    start: str
    end: str
    words: int
    stops: int
    cells: int
    pieces: int

    @staticmethod
    def of(raw: str, text: str | None = None, words: int | None = None) -> "Line":
        """``text`` and ``words``: the line without tags and its number of words, where they are known."""
        text = _bare(raw) if text is None else text
        words = len(_WORD.findall(text)) if words is None else words
        long = len(raw) > 2 * KEPT
        ends = (raw[:KEPT], raw[-KEPT:]) if long else (raw, "")
        return Line(*ends, words, len(_STOP.findall(text)) if _ENDS.search(text) else 0, _cells(raw) if long else 0, _pieces(text) if long else 0)

    def counted(self) -> tuple[int, int]:
        """The cells and pieces of this part, as it stands."""
        return (self.cells, self.pieces) if self.end else (_cells(self.start), _pieces(_bare(self.start)))

    def whole(self) -> tuple[int, int]:
        """The cells and pieces of a whole line, without what is blank (or a bar, for cells) at either end."""
        if not self.end:
            return _cells(self.start.strip().strip("|").strip()), _pieces(_bare(self.start.strip()).strip())
        start, end = self.start.lstrip(), self.end.rstrip()
        cells = self.cells - _cells(self.start) + _cells(start.lstrip("|").lstrip()) - _cells(self.end) + _cells(end.rstrip("|").rstrip())
        a, b = _bare(self.start), _bare(self.end)
        return cells, self.pieces - _pieces(a) + _pieces(a.lstrip()) - _pieces(b) + _pieces(b.rstrip())

    def then(self, other: "Line") -> "Line":
        """The line made of this part and the next."""
        left, right = self.end or self.start, other.start
        split_word = bool(left and right and left[-1].isalpha() and right[0].isalpha())
        cells = pieces = 0
        if not self.end and not other.end and len(self.start) + len(right) <= 2 * KEPT:
            ends = (self.start + right, "")
        else:
            ends = ((self.start if self.end else self.start + right)[:KEPT], ((left if other.end == "" else "") + (other.end or right))[-KEPT:])
            (c, p), (d, q), tagless = self.counted(), other.counted(), _bare(left + right)
            cells = c + d + _cells(left + right) - _cells(left) - _cells(right)
            pieces = p + q + _pieces(tagless) - _pieces(_bare(left)) - _pieces(_bare(right))
        return Line(*ends, self.words + other.words - split_word, self.stops + other.stops, cells, pieces)


def _add(counts: np.ndarray, line: Line) -> None:
    """Add one whole line to the counts."""
    bare = line.start.strip() if not line.end else line.start.lstrip()
    if not bare and not line.end:
        return
    text, words, stops = _bare(bare), line.words, line.stops
    counts[_AT["lines"]] += 1
    ends = bool(_END.search(_bare(line.end or text).rstrip()))
    counts[_AT["line_ends"]] += ends
    cells, pieces = line.whole()
    if cells >= 3 and (not stops or cells > 4) and words / cells < 9:
        counts[_AT["cell_lines"]] += 1
        counts[_AT["cell_words"]] += max(words, 1)
    elif pieces >= 4 and stops <= pieces / 2 and words / pieces <= 6:
        counts[_AT["short_lines"]] += 1
        counts[_AT["list_words"]] += max(words, 1)
    elif _BULLET.match(bare) and (words <= 30 or not stops):
        counts[_AT["bullet_lines"]] += 1
        counts[_AT["list_words"]] += max(words, 1)
    elif _PAIR.match(text) and words <= 12:
        counts[_AT["pair_lines"]] += 1
        counts[_AT["cell_words"]] += max(words, 1)
    elif words <= 5 and not stops:
        counts[_AT["short_lines"]] += 1
        counts[_AT["list_words"]] += max(words, 1)
    elif stops or ends:
        counts[_AT["sentence_lines"]] += 1
        counts[_AT["sentence_words"]] += words


class Partial(NamedTuple):
    """Counts of a stretch of text. ``head`` is its part up to the first line break (None without any), ``tail`` that after the last one.

    ``words`` counts the words of four letters or more by hash, ``phrases`` are the distinct hashes of five words in a row.
    """

    counts: np.ndarray
    common: dict[str, int]
    words: dict[int, int]
    phrases: np.ndarray
    head: Line | None
    tail: Line


class Counting:
    """Counts chunks, and remembers what is to be known of a word or token that has come before. ``common``: the common words of each language."""

    def __init__(self, common: dict[str, set]):
        self.common, self.words, self.tokens = common, {}, {}

    def word(self, w: str) -> tuple[int, bool, bool, tuple[str, ...]]:
        """(hash of its lower case, whether it is in capitals, whether it has four letters or more, languages in which it is common)."""
        low = w.lower()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        got = self.words[w] = int.from_bytes(blake2b(low.encode(), digest_size=8).digest(), "little") >> 1, w.isupper() and len(w) > 1, len(low) > 3, tuple(k for k, s in self.common.items() if low in s)
        return got

    def token(self, t: str) -> tuple[bool, bool]:
        """(whether it is very long, whether it looks like code)."""
        if len(self.tokens) > REMEMBERED:
            self.tokens.clear()
        got = self.tokens[t] = len(t) > 30, bool(_CODE.search(t))
        return got

    def count(self, text: str, before: str = "") -> Partial:
        """Partial counts of a chunk; ``before`` is the character before it, by which a word that began in the neighbour is not counted again."""
        counts = np.zeros(len(COUNTS), dtype=np.int64)
        raw = text.split("\n")
        bare = [_bare(x) for x in raw] if "<" in text else raw  # no tag and no word goes beyond a line
        found = [_WORD.findall(x) for x in bare]
        lines = [Line.of(x, y, len(ws)) for x, y, ws in zip(raw, bare, found)]
        clean, words = "\n".join(bare), [w for ws in found for w in ws]
        letters = sum(map(len, words))
        if words and before.isalpha() and clean[:1].isalpha():
            words = words[1:]
        tokens = clean.split()
        upper = long_tokens = code = 0
        common, many, hashes = dict.fromkeys(self.common, 0), {}, {}
        for w, n in Counter(words).items():
            h, capital, long, langs = self.words.get(w) or self.word(w)
            hashes[w] = h
            upper += n * capital
            if long:
                many[h] = many.get(h, 0) + n
            for k in langs:
                common[k] += n
        for t, n in Counter(tokens).items():
            long, looks = self.tokens.get(t) or self.token(t)
            long_tokens += n * long
            code += n * looks
        phrases = np.zeros(0, np.uint64)
        if len(words) > 4:
            h = np.array([hashes[w] for w in words], dtype=np.uint64)
            mixed = h[:-4].copy()
            for k in range(1, 5):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
            phrases = np.unique(mixed)
        totals = {
            "chars": len(text), "letters": letters, "digits": sum(map(clean.count, "0123456789")), "symbols": len(clean) - sum(map(len, _PLAIN.findall(clean))),
            "words": len(words), "word_chars": letters, "upper_words": upper, "tokens": len(tokens), "odd_tokens": len(_BEFORE.findall(clean)),
            "damaged": len(_DAMAGE.findall(clean)) if _ODD.search(clean) else 0, "long_tokens": long_tokens, "code_tokens": code, "ends": sum(x.stops for x in lines),
            "commas": clean.count(","), "phrases": max(len(words) - 4, 0),
        }
        for k, v in totals.items():
            counts[_AT[k]] = v
        for x in lines[1:-1]:
            _add(counts, x)
        return Partial(counts, common, many, phrases, lines[0] if len(lines) > 1 else None, lines[-1])


def count_chunk(text: str, common: dict[str, set], before: str = "") -> Partial:
    return Counting(common).count(text, before)


def merge(a: Partial, b: Partial) -> Partial:
    """The counts of two neighbouring stretches as of one; associative."""
    counts, common = a.counts + b.counts, {k: a.common.get(k, 0) + b.common.get(k, 0) for k in a.common.keys() | b.common.keys()}
    head, tail = a.head, b.tail
    if b.head is None:
        tail = a.tail.then(b.tail)
    elif a.head is None:
        head = a.tail.then(b.head)
    else:
        _add(counts, a.tail.then(b.head))
    words = {h: a.words.get(h, 0) + b.words.get(h, 0) for h in a.words.keys() | b.words.keys()}
    return Partial(counts, common, words, np.union1d(a.phrases, b.phrases), head, tail)


def finish(p: Partial, top: int | None = None, distinct: int | None = None) -> dict[str, float]:
    """The statistics of a whole document from its counts; ``top`` and ``distinct``, the rows of the commonest word and the distinct phrases, where they were counted elsewhere."""
    counts = p.counts.copy()
    for line in (p.head, p.tail):
        if line is not None:
            _add(counts, line)
    return ratios(counts, p.common, len(p.phrases) if distinct is None else distinct, max(p.words.values(), default=0) if top is None else top)


def ratios(counts: np.ndarray, langs: dict[str, int], distinct: int, top: int) -> dict[str, float]:
    """The statistics of a whole document."""
    c = {k: float(v) for k, v in zip(COUNTS, counts.tolist())}
    n, lines, tokens, total = max(c["words"], 1), max(c["lines"], 1), max(c["tokens"], 1), c["phrases"]
    return {
        "n_chars": c["chars"], "n_words": c["words"], "mean_word_length": c["word_chars"] / n, "symbol_ratio": c["symbols"] / max(c["chars"], 1), "digit_ratio": c["digits"] / max(c["chars"], 1),
        "letter_ratio": c["letters"] / max(c["chars"], 1), "n_lines": c["lines"], "line_end_share": c["line_ends"] / lines, "bullet_share": c["bullet_lines"] / lines, "cell_share": (c["cell_lines"] + c["pair_lines"]) / lines,
        "short_share": c["short_lines"] / lines, "list_word_share": c["list_words"] / n, "cell_word_share": c["cell_words"] / n, "sentence_word_share": c["sentence_words"] / n, "common_share": max([0, *langs.values()]) / n,
        "upper_share": c["upper_words"] / n, "odd_share": c["odd_tokens"] / tokens, "damage_share": c["damaged"] / n, "code_share": c["code_tokens"] / tokens, "long_share": c["long_tokens"] / tokens,
        "words_per_end": n / (c["ends"] + 1), "comma_share": c["commas"] / n, "distinct_share": distinct / total if total else 1.0, "distinct_phrases": float(distinct), "top_word_share": float(top) / n,
    }


def kind(r: dict[str, float]) -> str:
    """prose, list, table or junk; the rules are applied in order."""
    n = r["n_words"]
    if n < 3 or r["letter_ratio"] < 0.45 and r["code_share"] > 0.3 or r["letter_ratio"] < 0.3:
        return "junk" if r["cell_word_share"] < 0.5 else "table"
    if r["odd_share"] > 0.01 and n > 20 or r["damage_share"] > 0.15:
        return "junk"
    if n >= 30 and (r["distinct_share"] < 0.2 and r["distinct_phrases"] < 100):
        return "junk"
    if r["cell_word_share"] > 0.5:
        return "table"
    if r["code_share"] > 0.3 or r["long_share"] > 0.3:
        return "junk"
    if r["list_word_share"] > 0.5:
        return "list"
    if r["list_word_share"] + r["cell_word_share"] > 0.5:
        return "list"
    if n > 25 and r["top_word_share"] > 0.09 and r["words_per_end"] > 40:
        return "junk"
    if r["words_per_end"] > 15 and r["comma_share"] > 0.12 and r["sentence_word_share"] < 0.5:
        return "list"
    if r["words_per_end"] >= n and r["comma_share"] >= 0.25:
        return "list"
    if r["n_lines"] >= 4 and r["words_per_end"] >= min(n, 40) and n / r["n_lines"] < 12:
        return "list"
    if n >= 10 and r["common_share"] < 0.1 and r["sentence_word_share"] < 0.3:
        return "junk"
    return "prose"


STATISTICS = list(ratios(np.zeros(len(COUNTS)), {}, 0, 0))


def _cut(text: str, k: int, base: int, chunk: int = CHUNK, slack: int = SLACK) -> tuple[str, str]:
    """Chunk ``k`` of the stretch that starts at ``base``, moved to white space or the end of a tag where one is near, and the character before it."""

    def boundary(at: int) -> int:
        if at <= 0:
            return 0
        m = re.compile(r"\s|(?<=>)").search(text, at - base, at - base + slack)
        return m.start() + base if m else at

    start, end = boundary(k * chunk), boundary((k + 1) * chunk)
    return text[start - base : end - base], text[start - base - 1 : start - base] if start > base else ""


def text_statistics(docs: DataFrame, common_words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, the statistics of ``text`` and its ``kind`` (prose, list, table, junk) for every row of ``docs``; repeated rows stay repeated. Phrases are counted within chunks.

    A null text counts as an empty one, which is junk of no words. ``common_words`` (lang, word) may be empty: then no word is common. Only ``doc_id`` and
    ``text`` are read, so other columns may have any names. Every text is read whole; those longer than a chunk are cut, spread over all tasks and merged.
    """
    common: dict[str, set] = {}
    for lang, word in bounded(common_words.select("lang", "word").where("word is not null").distinct(), MAX_COMMON, "the list of common words"):
        common.setdefault(lang or "", set()).add(word.lower())
    schema = "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS) + ", kind string"

    def rows(ids: list, got: list[dict[str, float]]) -> pd.DataFrame:
        out = pd.DataFrame(got, columns=STATISTICS)
        out.insert(0, "doc_id", ids)
        out["kind"] = [kind(r) for r in got]
        return out

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counting = Counting(common)
        for b in batches:
            yield rows(b["doc_id"].tolist(), [finish(counting.count(t or "")) for t in b["text"]])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counting = Counting(common)
        for b in batches:
            got = [counting.count(*_cut(t, k, base, chunk)) for t, k, base in zip(b["piece"], b["seq"], b["base"])]
            states = [pickle.dumps(p._replace(words={}, phrases=p.phrases[:0])) for p in got]
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "seq": b["seq"], "state": states, "words": [[{"h": h, "n": n} for h, n in p.words.items()] for p in got], "phrases": [p.phrases.view(np.int64).tolist() for p in got]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = []
            for parts in b["parts"]:
                got = [pickle.loads(p["state"]) for p in sorted(parts, key=lambda p: p["seq"])]
                one = got[0]
                for p in got[1:]:
                    one = merge(one, p)
                states.append(pickle.dumps(one))
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "seq": b["up"], "state": states})

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows(b["doc_id"].tolist(), [finish(pickle.loads(s), t, d) for s, t, d in zip(b["state"], b["top"].tolist(), b["n_distinct"].tolist())])

    base = docs.select("doc_id", "text")
    size = F.length("text")
    small = base.where(size.isNull() | (size <= chunk)).mapInPandas(whole, schema)
    large = base.where(size > chunk).withColumn("row", F.monotonically_increasing_id())
    seq = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk))).alias("seq")
    start = F.greatest(F.col("seq") * chunk - 1, F.lit(0))
    pieces = large.select("doc_id", "row", "text", seq).select("doc_id", "row", "seq", start.alias("base"), F.substring("text", start.cast("int") + 1, chunk + SLACK + 2).alias("piece"))
    state = "doc_id long, row long, seq long, state binary"
    counted = write_shared(spread(pieces).mapInPandas(partial, state + ", words array<struct<h:long,n:long>>, phrases array<long>"), "chunks")
    last = counted.agg(F.max("seq")).first()[0]
    if last is None:
        return small
    # words and phrases of a long text are counted by hash over all tasks, so that none holds them all
    top = counted.select("row", F.explode("words").alias("w")).groupBy("row", "w.h").agg(F.sum("w.n").alias("n")).groupBy("row").agg(F.max("n").alias("top"))
    distinct = counted.select("row", F.explode("phrases").alias("h")).distinct().groupBy("row").agg(F.count("*").alias("n_distinct"))
    parts, chunks = counted.select("doc_id", "row", "seq", "state"), last + 1
    while chunks > 1:
        groups = parts.groupBy("doc_id", "row", F.floor(F.col("seq") / FANOUT).alias("up")).agg(F.collect_list(F.struct("seq", "state")).alias("parts"))
        parts = groups.mapInPandas(merged, state)
        chunks = -(-chunks // FANOUT)
    found = parts.join(top, "row", "left").join(distinct, "row", "left").fillna(0, ["top", "n_distinct"])
    return small.unionByName(write_shared(found.select("doc_id", "state", "top", "n_distinct").mapInPandas(done, schema), "long-texts"))
