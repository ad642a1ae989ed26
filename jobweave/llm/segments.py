"""Immutable suffix arrays over concatenated text, and a store that keeps them between calls (problem 2).

A text is a row of stretches, each ended by ``|``. The array holds the suffixes that begin with a stretch, sorted; a substring that begins where a stretch does is looked
up by binary search, and all texts that contain it are one range. Arrays never change: new ones are added, and neighbours of like size are merged.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.session import read_text, remove, write_text

#: Suffixes are sorted to this depth, which is also the longest substring that is looked up; longer ones find a superset.
DEPTH = 48
_STRETCH = re.compile(rb"[^|]+\|?")


class Segment:
    """An immutable suffix array over the texts of some records. ``values`` are columns beside the texts."""

    def __init__(self, texts: list[bytes], values: dict[str, list], positions: np.ndarray | None = None):
        self.texts, self.values = texts, values
        joined = b"".join(t + b"\n" for t in texts)
        raw = np.frombuffer(joined + b"\x01" * DEPTH, dtype=np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1].astype(np.int64)
        if positions is None:
            at = np.concatenate([begins, np.flatnonzero(raw[: max(len(joined) - 1, 0)] == ord("|")) + 1]) if texts else begins
            at = at[raw[at] != ord("\n")]
        else:
            at = positions
        view = np.lib.stride_tricks.sliding_window_view(raw, DEPTH)[at] if len(at) else np.zeros((0, DEPTH), np.uint8)
        suffixes = np.ascontiguousarray(view).view(f"S{DEPTH}").ravel()
        if positions is None:
            order = np.argsort(suffixes, kind="stable")
            at, suffixes = at[order], suffixes[order]
        self.positions, self.suffixes, self.owner = at, suffixes, np.searchsorted(begins, at, "right") - 1

    def find(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each pattern."""
        p = np.array(patterns, dtype=f"S{DEPTH}")
        high = np.array([(x + b"\xff" * DEPTH)[:DEPTH] if len(x) < DEPTH else x for x in patterns], dtype=f"S{DEPTH}")
        return np.searchsorted(self.suffixes, p, "left"), np.searchsorted(self.suffixes, high, "right")

    def packed(self) -> tuple[list[bytes], bytes, str]:
        return self.texts, self.positions.astype("<i8").tobytes(), json.dumps(self.values)

    @staticmethod
    def unpacked(texts: list[bytes], positions: bytes, values: str) -> "Segment":
        return Segment([bytes(t) for t in texts], json.loads(values), np.frombuffer(positions, dtype="<i8"))


def merged(a: Segment, b: Segment) -> Segment:
    return Segment(a.texts + b.texts, {k: a.values[k] + b.values[k] for k in a.values})


def combined(s: Segment) -> Segment:
    """The same with one record for those that differ in their stretch of ids alone, which has all of it; of segments without stretches the same."""
    if "low" not in s.values:
        return s
    at: dict[tuple, int] = {}
    texts, values = [], {k: [] for k in s.values}
    for k, key in enumerate(zip(s.texts, *(v for c, v in s.values.items() if c not in ("low", "high")))):
        n = at.setdefault(key, len(texts))
        if n == len(texts):
            texts.append(s.texts[k])
            for c in values:
                values[c].append(s.values[c][k])
        else:
            values["low"][n], values["high"][n] = min(values["low"][n], s.values["low"][k]), max(values["high"][n], s.values["high"][k])
    return Segment(texts, values)


class History:
    """The segments that are searched: those of a store and those of the batches accepted since, merged logarithmically."""

    def __init__(self, stored: list[Segment] | None = None):
        self.stored, self.segments = list(stored or []), []

    def add(self, texts: list[bytes], values: dict[str, list]) -> None:
        if not texts:
            return
        self.segments.append(Segment(texts, values))
        while len(self.segments) > 1 and len(self.segments[-2].texts) < 2 * len(self.segments[-1].texts):
            b, a = self.segments.pop(), self.segments.pop()
            self.segments.append(merged(a, b))

    def stored_matches(self, patterns: list[bytes]) -> Iterator[tuple[int, Segment, np.ndarray]]:
        """``matches`` among the stored segments alone."""
        return History(self.stored).matches(patterns)

    def matches(self, patterns: list[bytes]) -> Iterator[tuple[int, Segment, np.ndarray]]:
        """(position of the pattern, segment, records of it that contain the pattern) for every pattern that a segment contains."""
        if not patterns:
            return
        for s in [*self.stored, *self.segments]:
            low, high = s.find(patterns)
            for k in np.flatnonzero(high > low).tolist():
                yield k, s, s.owner[low[k] : high[k]]

    def covered(self, texts: list[bytes]) -> Iterator[tuple[int, Segment, int, float]]:
        """(position of the text, segment, record, share of its stretches that matches cover) of every record that lacks at most one of the text's stretches.

        Such a record has one of any two stretches, so the two that the fewest suffixes begin with name all of them; others that have one of these come too.
        """
        stretches = [sorted(set(_STRETCH.findall(t))) for t in texts]
        patterns = [x[:DEPTH] for own in stretches for x in own]
        if not patterns:
            return
        for s in [*self.stored, *self.segments]:
            low, high = s.find(patterns)
            at = 0
            for k, own in enumerate(stretches):
                ranges = sorted(zip((high - low)[at : at + len(own)].tolist(), low[at : at + len(own)].tolist()))[:2]
                at += len(own)
                for o in sorted({o for n, i in ranges for o in s.owner[i : i + n].tolist()}):
                    yield k, s, o, sum(x in s.texts[o] for x in own) / len(own)


COLUMNS = "shard int, texts array<binary>, positions binary, columns string"


def rows_of(segment: Segment, shard: int) -> pd.DataFrame:
    texts, positions, values = segment.packed()
    return pd.DataFrame({"shard": [shard], "texts": [texts], "positions": [positions], "columns": [values]})


def segments_of(pdf: pd.DataFrame) -> list[Segment]:
    return [Segment.unpacked(list(t), p, v) for t, p, v in zip(pdf["texts"], pdf["positions"], pdf["columns"])]


class SegmentStore:
    """Families of segments in a folder that driver and executors share, one segment per shard and addition, with small tables beside them.

    ``LIST`` names what is current and is replaced in one step after everything it names is written, so a call that fails leaves the store as it was. One
    writer at a time. The number of shards is fixed when the store is made; choose it for the history to come.
    """

    def __init__(self, spark: SparkSession, root: str, shards: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        known = read_text(spark, f"{self.root}/LIST")
        self.state = json.loads(known) if known else {"shards": shards or 2 * spark.sparkContext.defaultParallelism, "families": {}, "tables": {}}
        self.shards, self.old = self.state["shards"], []

    def live(self, family: str) -> list[dict]:
        return self.state["families"].setdefault(family, [])

    def read(self, family: str) -> DataFrame | None:
        """The live segments of a family, one row per shard and segment: of the history nothing else is read."""
        names = [f"{self.root}/{x['name']}" for x in self.live(family)]
        return self.spark.read.schema(COLUMNS).parquet(*names) if names else None

    def table(self, name: str) -> DataFrame | None:
        parts = self.state["tables"].get(name)
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts]) if parts else None

    def put(self, name: str, df: DataFrame, add: bool = False) -> None:
        """Replace a small table, or add a part to it."""
        part = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{part}")
        before = self.state["tables"].get(name, [])
        self.old += [] if add else before
        self.state["tables"][name] = [*before, part] if add else [part]

    def add(self, family: str, records: DataFrame, build: Callable[[pd.DataFrame], Segment]) -> None:
        """Add one segment per shard from ``records`` (with ``shard``), and merge as long as the newest addition is at least half the size of the one before it."""
        name = f"{family}-{uuid.uuid4().hex}"
        found = records.groupBy("shard").applyInPandas(lambda pdf: rows_of(build(pdf), int(pdf["shard"].iloc[0])), COLUMNS)
        found.write.parquet(f"{self.root}/{name}")
        live = self.live(family)
        live.append({"name": name, "n": self.spark.read.parquet(f"{self.root}/{name}").agg(F.sum(F.size("texts"))).first()[0] or 0})
        while len(live) > 1 and live[-2]["n"] < 2 * live[-1]["n"]:
            b, a = live.pop(), live.pop()
            both = self.spark.read.schema(COLUMNS).parquet(f"{self.root}/{a['name']}", f"{self.root}/{b['name']}")

            def one(pdf: pd.DataFrame) -> pd.DataFrame:
                parts = segments_of(pdf)
                whole = parts[0]
                for p in parts[1:]:
                    whole = merged(whole, p)
                return rows_of(combined(whole), int(pdf["shard"].iloc[0]))

            name = f"{family}-{uuid.uuid4().hex}"
            both.groupBy("shard").applyInPandas(one, COLUMNS).write.parquet(f"{self.root}/{name}")
            live.append({"name": name, "n": a["n"] + b["n"]})
            self.old += [a["name"], b["name"]]

    def commit(self) -> None:
        write_text(self.spark, f"{self.root}/LIST", json.dumps(self.state))
        for name in self.old:
            remove(self.spark, f"{self.root}/{name}")
        self.old = []
