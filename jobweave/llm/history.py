"""Deduplicating new batches against all history (problem 2).

What is accepted is kept as immutable suffix arrays (``SegmentStore``). A call takes new batches: their rows are read into descriptors, the substrings of these are looked
up in the stored arrays and in those of the earlier batches of the call, the matches are added up per record, an exact check follows, and one more array per shard is written.
No accepted row is read again: of the history a call reads arrays, the dictionary of names, the counts of words and the keys that tell a missing part.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobweave.llm.common import spread
from jobweave.llm.postings import add_entities, count_tokens, link_key, read_postings, standard_list
from jobweave.llm.segments import History, Segment, SegmentStore, segments_of
from jobweave.llm.strings import edits
from jobweave.session import discard, remove, shared_dir, write_shared

#: A row that fits several postings is taken for the one whose rows it lies this many times nearer to (in order of acceptance), else for none.
NEARER = 3
#: Incomplete rows of one role that a task takes; more are shared out, each part with all postings of the role. Also the rows of a table for which a store gets one shard.
SHARD_ROWS = 20_000
#: Share of a role's stretches that matches must cover before the words are compared: all but one, of two or more.
COVERED = 0.5


def role_text(entity: str, signature: str) -> bytes:
    """The words of a role as stretches, each after a tag of the employer; a role of one word has a second stretch, so that it meets the others of one word."""
    tag = f"{zlib.crc32(entity.encode()):08x}"
    words = sorted(set(signature.split()) - {"analyst"})
    return "".join(f"{tag} {w}|" for w in (words if len(words) > 1 else [*words, "#"])).encode("ascii", "replace")


def role_keys(signature: str) -> list[str]:
    """Pairs of the first three words in a fixed order of all words; roles that differ in one word have one of them in common."""
    words = sorted(set(signature.split()) - {"analyst"}, key=lambda w: (zlib.crc32(w.encode()), w))
    return sorted({" ".join(p) for p in itertools.combinations([*words, "#1", "#2"][:3], 2)})


def same_role(a: str, b: str, standard: set[str]) -> bool:
    """Equal signatures, or such as differ by one word that is no standard spelling and within two slips of the other's."""
    if a == b:
        return True
    x, y = set(a.split()), set(b.split())
    only_a, only_b = sorted(x - y - {"analyst"}), sorted(y - x - {"analyst"})
    if len(only_a) != 1 or len(only_b) != 1:
        return False
    p, q = only_a[0], only_b[0]
    return (p not in standard or q not in standard) and min(len(p), len(q)) > 3 and edits(p, q, 2) <= 2


def match_roles(new: pd.DataFrame, stored: list[Segment], standard: set[str]) -> pd.DataFrame:
    """One shard of roles (entity, signature, batch, id): each with the signature under which it was first accepted (``canonical``, ``canonical_id``)."""
    # roles of standard words alone differ from each other by more than a slip, so they are looked up among the others only; a call has each role once, so equal ones are in the store
    known, every, odd = History(stored), History(), History()
    out = []
    for _, part in new.sort_values(["batch", "id"], kind="stable").groupby("batch", sort=True):
        rows = list(part.itertuples())
        texts = [role_text(r.entity, r.signature) for r in rows]
        strange = [k for k, r in enumerate(rows) if not standard.issuperset(r.signature.split())]
        plain = sorted(set(range(len(rows))) - set(strange))
        values = lambda at, names, ids: {"entity": [rows[k].entity for k in at], "signature": [rows[k].signature for k in at], "canonical": [names[k] for k in at], "first": [ids[k] for k in at]}
        own = [(int(r.id), r.signature) for r in rows]
        fresh, fresh_odd = History(), History()
        for h, at in ((fresh, range(len(rows))), (fresh_odd, strange)):
            h.add([texts[k] for k in at], values(at, [r.signature for r in rows], [int(r.id) for r in rows]))
        best = list(own)
        for at, sources in ((strange, (known, every, fresh)), (plain, (known, odd, fresh_odd))):
            for source in sources:
                for n, s, o, share in source.covered([texts[k] for k in at]):
                    v, k = s.values, at[n]
                    if share >= COVERED and v["first"][o] < best[k][0] and v["entity"][o] == rows[k].entity and same_role(v["signature"][o], rows[k].signature, standard):
                        best[k] = (v["first"][o], v["canonical"][o])
        for h, at in ((every, range(len(rows))), (odd, strange)):
            h.add([texts[k] for k in at], values(at, [b[1] for b in best], [b[0] for b in best]))
        out.append(part[["entity", "signature"]].assign(canonical=[b[1] for b in best], canonical_id=[b[0] for b in best]))
    return pd.concat(out) if out else pd.DataFrame(columns=["entity", "signature", "canonical", "canonical_id"])


def posting_text(tag: str, cycle: str, place: str) -> bytes:
    """A posting of a role under both orders of its parts, so that what is known of an incomplete row is the beginning of a stretch."""
    return f"{tag} {cycle or '?'} @{place or '?'}|{tag}@{place or '?'} {cycle or '?'}|".encode("ascii", "replace")


def _pattern(tag: str, cycle: str, places: list[int]) -> list[bytes]:
    """The substrings that all postings have which agree with an incomplete row."""
    if cycle:
        return [f"{tag} {cycle} @{p}|".encode("ascii", "replace") for p in places] or [f"{tag} {cycle} @".encode("ascii", "replace")]
    return [f"{tag}@{p} ".encode() for p in places] or [f"{tag} ".encode()]


class Postings:
    """The postings of one shard while batches are accepted: a forest of records, each root with its first id, its stretch of ids, whether a part of it is unknown, and ``least``, its first id then."""

    def __init__(self, stored: list[Segment]):
        self.parent, self.first, self.low, self.high, self.kept, self.open, self.label = [], [], [], [], [], [], []
        known: dict[int, int] = {}
        for s in stored:
            s.values["who"] = [known.setdefault(i, len(known)) for i in s.values["pid"]]
        for pid in known:
            self.new(1 << 62, 1 << 62, -1, True, f"s{pid}", {pid})
        for s in stored:
            for p, first in zip(s.values["who"], s.values["first"]):
                self.first[p] = min(self.first[p], first)
        # the stretch of ids is that of whole rows, if there is one
        for unknown in (0, 1):
            for s in stored:
                for p, low, high, u, text in zip(s.values["who"], s.values["low"], s.values["high"], s.values["open"], s.texts):
                    if text and u == unknown and (not unknown or self.open[p]):
                        self.low[p], self.high[p], self.open[p] = min(self.low[p], low), max(self.high[p], high), bool(unknown)
        for s in stored:  # postings that a later one took over
            for p, into, text in zip(s.values["who"], s.values["into"], s.texts):
                if not text and into in known:
                    self.join(p, known[into])
        self.history = History(stored)

    def new(self, ident: int, low: int, high: int, unknown: bool, label: str, kept: set[int] | None = None) -> int:
        self.parent.append(len(self.parent))
        for at, v in ((self.first, ident), (self.low, low), (self.high, high), (self.open, unknown), (self.label, label), (self.kept, kept or set())):
            at.append(v)
        return len(self.parent) - 1

    def root(self, p: int) -> int:
        while self.parent[p] != p:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        return p

    def join(self, a: int, b: int) -> int:
        """One posting of two; a complete one stays complete and keeps its label."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return a
        if (self.open[a], self.first[a]) > (self.open[b], self.first[b]):
            a, b = b, a
        self.parent[b] = a
        self.first[a] = min(self.first[a], self.first[b])
        if self.open[a] == self.open[b]:
            self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.kept[a] = self.kept[a] | self.kept[b]
        return a

    def away(self, p: int, ident: int) -> int:
        return max(0, self.low[p] - ident, ident - self.high[p])

    def nearest(self, roots: set[int], ident: int) -> int | None:
        """The one root, or the one that lies NEARER times nearer than all others."""
        order = sorted((self.away(p, ident), p) for p in roots)
        if not order or (len(order) > 1 and order[1][0] + 1 < NEARER * (order[0][0] + 1)):
            return None
        return order[0][1]


def settle_postings(new: pd.DataFrame, stored: list[Segment]) -> pd.DataFrame:
    """One shard of descriptors (kind, tag, batch, cycle, places, tie, d, id, high) in order of acceptance: d, label and first id of its posting as its batch ends,
    ``final``, the label when all batches are in, ``kept``, the stored postings in it, whether a part of it is unknown, and ``least``, its first id then.

    Kinds: ``c`` a whole descriptor, ``o`` one of which cycle or place is unknown, ``k`` a whole one with the key (link or source) of a row that lacked a part.
    """
    state = Postings(stored)
    groups: dict[bytes, int] = {}
    given: list[tuple[int, int]] = []
    told: list[tuple[str, int]] = []
    tied: dict[bytes, list[int]] = {}
    new = new.sort_values(["batch", "id", "d"], kind="stable")
    for _, part in new.groupby("batch", sort=True):
        rows = list(part.itertuples())
        whole, partly, keyed = ([r for r in rows if r.kind == k] for k in "cok")
        # whole descriptors: their text in the history, else a new posting
        texts = [posting_text(r.tag, r.cycle, str(r.places[0])) for r in whole]
        patterns = [t.split(b"|")[0] + b"|" for t in texts]
        hits: dict[int, set[int]] = {}
        for k, s, owners in state.history.matches(patterns):
            hits.setdefault(k, set()).update(s.values["who"][o] for o in owners.tolist() if s.texts[o] == texts[k])
        fresh_texts, fresh_who, at_text = [], [], {}
        began: list[int] = []
        for k, r in enumerate(whole):
            mine = at_text.get(patterns[k])
            for p in hits.get(k, ()):
                mine = state.join(p, mine) if mine is not None else state.root(p)
            if mine is None:
                mine = state.new(int(r.id), int(r.id), int(r.high), False, f"c{r.id}")
                fresh_texts.append(texts[k])
                fresh_who.append(mine)
                began.append(k)
            p = state.root(mine)
            state.first[p], state.low[p], state.high[p] = min(state.first[p], int(r.id)), min(state.low[p], int(r.id)), max(state.high[p], int(r.high))
            at_text[patterns[k]] = mine
            given.append((int(r.d), int(r.id), mine))
        # a new posting takes rows that lacked a part and found none that fits, if it is the only one or much the nearest
        lacks = ("{t} {c} @?|", "{t} ? @{p}|", "{t} ? @?|", "{t} {c} ~{p}|", "{t} ? ~{p}|")
        asked = [(k, q.format(t=whole[k].tag, c=whole[k].cycle, p=whole[k].places[0]).encode("ascii", "replace")) for k in began for q in lacks]
        takers: dict[int, set[int]] = {}
        for n, s, owners in state.history.matches([q for _, q in asked]):
            for o in owners.tolist():
                p = state.root(s.values["who"][o])
                if state.open[p]:
                    takers.setdefault(p, set()).add(at_text[patterns[asked[n][0]]])
        for p, roots in sorted(takers.items()):
            taker = state.nearest({state.root(x) for x in roots}, state.high[p])
            if taker is not None:
                state.join(taker, p)
        for r in keyed:
            q = f"{r.tag}~{r.tie}|".encode("ascii", "replace")
            mine = at_text[posting_text(r.tag, r.cycle, str(r.places[0])).split(b"|")[0] + b"|"]
            for at in tied.pop(q, ()):  # the key tells more than what was known of the row
                d, ident, p = given[at]
                if state.root(p) != state.root(mine):
                    given[at] = (d, ident, mine)
                    state.first[state.root(mine)] = min(state.first[state.root(mine)], ident)
            for _, s, owners in state.history.stored_matches([q]):
                for o in owners.tolist():
                    p, own = state.root(s.values["who"][o]), s.values["own"][o]
                    if own >= 0 and p != state.root(mine):
                        state.first[state.root(mine)] = min(state.first[state.root(mine)], own)
        state.history.add(fresh_texts, {"who": fresh_who})
        # incomplete ones: every posting that has what is known of them
        asked = [(k, q) for k, r in enumerate(partly) for q in _pattern(r.tag, r.cycle, list(r.places))]
        fits: dict[int, set[int]] = {}
        for n, s, owners in state.history.matches([q for _, q in asked]):
            fits.setdefault(asked[n][0], set()).update(p for p in {state.root(s.values["who"][o]) for o in np.unique(owners).tolist()} if not state.open[p])
        same = [_own_text(r, bool(fits.get(k))) for k, r in enumerate(partly)]
        held: dict[int, set[int]] = {}
        for k, s, owners in state.history.matches([t.split(b"|")[0] + b"|" for t in same]):
            held.setdefault(k, set()).update(s.values["who"][o] for o in owners.tolist())
        ties = [f"{r.tag}~{r.tie}|".encode("ascii", "replace") for r in partly]
        for k, s, owners in state.history.matches(ties):
            held.setdefault(~k, set()).update(s.values["who"][o] for o in owners.tolist())
        late_texts, late_who = [], []
        for k, r in enumerate(partly):
            # a row of the same key first, then the posting that fits, then rows of which the same is known
            before = {state.root(given[at][2]) for at in tied.get(ties[k], ())} | {state.root(p) for p in held.get(~k, ())}
            mine = min(before, key=lambda p: (state.open[p], state.first[p], p)) if before else None
            if mine is None and k in fits:
                mine = state.nearest({state.root(p) for p in fits[k]}, int(r.id))
            if mine is None:
                known = {state.root(p) for p in held.get(k, ())} | ({state.root(groups[same[k]])} if same[k] in groups else set())
                mine = min(known, key=lambda p: (state.first[p], p)) if known else None
                if mine is None:
                    mine = state.new(int(r.id), int(r.id), int(r.high), True, f"o{same[k].decode()}")
                    late_texts.append(same[k])
                    late_who.append(mine)
                groups[same[k]] = mine
                p = state.root(mine)
                if state.open[p]:
                    state.low[p], state.high[p] = min(state.low[p], int(r.id)), max(state.high[p], int(r.high))
            state.first[state.root(mine)] = min(state.first[state.root(mine)], int(r.id))
            tied.setdefault(ties[k], []).append(len(given))
            given.append((int(r.d), int(r.id), mine))
        state.history.add(late_texts, {"who": late_who})
        told += [(state.label[p], state.first[p]) for p in (state.root(p) for _, _, p in given[len(told) :])]
    roots = [state.root(p) for _, _, p in given]
    return pd.DataFrame({
        "d": pd.array([d for d, _, _ in given], dtype="Int64"), "label": [x for x, _ in told], "first": pd.array([x for _, x in told], dtype="Int64"), "final": [state.label[p] for p in roots],
        "kept": [sorted(state.kept[p]) for p in roots], "unknown": [int(state.open[p]) for p in roots], "least": pd.array([state.first[p] for p in roots], dtype="Int64"),
    })


def _own_text(r, several: bool) -> bytes:
    """The text of a row that joins no posting: what it has in common with its like. Rows that fit no known posting agree if they know the same; of several postings only a key tells."""
    if not several and len(r.places) <= 1:
        return posting_text(r.tag, r.cycle, str(r.places[0]) if len(r.places) else "")
    may = "" if several else "".join(f"{r.tag} {r.cycle or '?'} ~{p}|" for p in r.places)
    return f"{r.tag}~{r.tie}|{may}".encode("ascii", "replace")


def _cogroup(new: DataFrame, stored: DataFrame | None, key: str, schema: str, task) -> DataFrame:
    """``task(new rows, stored segments)`` per group; ``stored`` has the groups' segments."""
    # a number of partitions that adaptive execution keeps: the rows are few bytes, but costly
    new = spread(new, key)
    if stored is None:
        return new.groupBy(key).applyInPandas(lambda pdf: task(pdf, []), schema)
    run = lambda pdf, seg: task(pdf, segments_of(seg)) if len(pdf) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
    return new.groupBy(key).cogroup(stored.groupBy(key)).applyInPandas(run, schema)


def _roles(kept: DataFrame, store: SegmentStore, standard: set[str]) -> DataFrame:
    """entity, signature, canonical of the roles of new rows; the roles not seen before are added to the store."""
    n = store.shards

    @F.pandas_udf("array<string>")
    def pairs(signatures: pd.Series) -> pd.Series:
        return signatures.map(role_keys)

    roles = write_shared(kept.groupBy("entity", "signature").agg(F.min("id").alias("id"), F.min("batch").alias("batch")), "roles")
    shared = roles.withColumn("shard", F.explode(F.array_distinct(F.transform(pairs("signature"), lambda k: F.pmod(F.xxhash64("entity", k), F.lit(n)).cast("int")))))
    stored = store.read("roles")
    found = write_shared(_cogroup(shared, stored, "shard", "entity string, signature string, canonical string, canonical_id long", lambda pdf, old: match_roles(pdf, old, standard)), "role-matches")
    best = found.groupBy("entity", "signature").agg(F.min("canonical_id").alias("first"), F.min_by("canonical", "canonical_id").alias("canonical"))
    known = write_shared(best, "canonical-roles")

    def build(pdf: pd.DataFrame) -> Segment:
        return Segment([role_text(e, s) for e, s in zip(pdf["entity"], pdf["signature"])], {c: pdf[c].tolist() for c in ("entity", "signature", "canonical", "first")})

    late = known.join(roles, ["entity", "signature"]).where(F.col("first") == F.col("id")).select("entity", "signature", "canonical", "first") if stored is not None else known
    store.add("roles", late.join(shared.select("entity", "signature", "shard"), ["entity", "signature"]), build)
    return known.select("entity", "signature", "canonical")


def _evidence(rows: DataFrame, store: SegmentStore) -> tuple[DataFrame, DataFrame]:
    """(rows with a missing cycle or place filled in, the keys of rows that lack one): what a row with the same link or source key of the same role told, in this batch or before."""
    keys = F.array_compact(F.array(F.concat(F.lit("u:"), "link"), F.concat(F.lit("s:"), "source")))
    cycle, place = F.when(F.col("cycle") != "", F.col("cycle")), F.when(F.size("places") == 1, F.col("places")[0])
    keyed = rows.select("id", "batch", "cycle", "places", F.explode(F.transform(keys, lambda k: F.xxhash64("tag", k))).alias("key"))
    told = keyed.select("key", cycle.alias("c"), place.alias("p"), "batch").where("c is not null or p is not null").groupBy("key", "c", "p").agg(F.min("batch").alias("since"))
    told = write_shared(told, "told")
    before = store.table("told")
    all_told = told if before is None else told.unionByName(before)
    partly = keyed.where((F.col("cycle") == "") | (F.size("places") != 1))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    hints = partly.join(all_told, "key").where("since <= batch").groupBy("id").agg(one("c").alias("key_c"), one("p").alias("key_p"))
    may = (F.size("places") == 0) | F.array_contains("places", F.col("key_p"))
    fill = F.when((F.size("places") != 1) & F.col("key_p").isNotNull() & may, F.array("key_p")).otherwise(F.col("places"))
    filled = rows.join(hints, "id", "left").withColumn("cycle", F.when(F.col("cycle") != "", F.col("cycle")).otherwise(F.coalesce("key_c", F.lit("")))).withColumn("places", fill).drop("key_c", "key_p")
    store.put("told", told, add=True)
    return filled, partly.select("key").distinct()


def accept_batches(rows: DataFrame, reference: DataFrame, aliases: DataFrame | None, store: SegmentStore) -> DataFrame:
    """first, later: for every row of the new batches whose posting had a row before it (in the store or in ``rows``), the first (smallest) id of the posting and its own.

    ``rows`` have id (rising with acceptance), batch, name, title, place, hint (cycle), link and source key; any of them may be null: without an id a row is no row, a null batch comes first. A call takes
    one batch or several, which are accepted in order: a batch is decided from itself, the earlier ones and the store, never from a later one, but for spelling (the words that count as rightly spelt, and the
    links of names), which is taken from all rows of the call. Rows are one posting if employer, role with team, cycle and place agree. A missing cycle or place is filled in from a
    row of the same employer and role with the same link or source key, else from the one posting that fits, or from that of several whose rows lie ``NEARER`` times nearer in order of acceptance;
    without such a one the row joins others only through link or source key. If no posting of the role fits, rows that know the same agree, and the first whole row that fits them takes them.
    Rows without employer or title are never repeats. Rows repeated under one id count once. Empty tables give an empty result; only the named columns are read.

    Equal descriptors of one batch are collapsed by aggregation, roles are searched in shards by pairs of their words and postings in shards by role; a role with more than ``SHARD_ROWS`` incomplete rows is shared out.
    """
    rows = rows.where("id is not null")
    counts, titles = count_tokens(rows.select("title"), store.table("words"), store.state.get("titles", 0))
    standard = standard_list(counts, titles)
    store.put("words", counts)
    store.state["titles"] = titles
    base = rows.select("id", F.coalesce("batch", F.lit(-1)).alias("batch"), "name", "title", F.lit(None).cast("string").alias("team"), "place", "hint", link_key(F.col("link")).alias("link"), "source")
    names, added = add_entities(rows.select("name"), aliases, store.table("names"))
    read = read_postings(base, standard, reference).join(names, "name").where("signature <> ''")
    kept = write_shared(read.select("id", "batch", "entity", "signature", F.coalesce("cycle", F.lit("")).alias("cycle"), F.array_sort("places").alias("places"), "link", "source"), "accepted")
    store.put("names", added, add=True)
    known = _roles(kept, store, set(standard))
    rows = kept.join(known, ["entity", "signature"]).withColumn("tag", F.lower(F.lpad(F.hex(F.xxhash64("entity", "canonical")), 16, "0"))).drop("entity", "signature", "canonical")
    tagged = write_shared(rows, "tagged")
    rows, lacking = _evidence(tagged, store)
    tie = F.coalesce(F.concat(F.lit("u:"), "link"), F.concat(F.lit("s:"), "source"))
    alone = F.when(F.size("places") > 1, F.concat_ws(" ", "cycle", F.to_json("places"))).otherwise(F.concat(F.lit("i:"), "id"))
    whole = (F.col("cycle") != "") & (F.size("places") == 1)
    rows = rows.withColumn("kind", F.when(whole, "c").otherwise("o")).withColumn("key", F.xxhash64("tag", tie)).withColumn("tie", F.when(tie.isNotNull(), F.hex("key")).otherwise(F.hex(F.xxhash64(alone))))
    parts = ["kind", "tag", "batch", "cycle", "places"]
    rows = write_shared(rows.withColumn("d", F.xxhash64(*parts, F.when(F.col("kind") == "o", F.col("tie")).otherwise(""))), "filled")
    collapse = lambda df: df.groupBy("d").agg(*[F.first(c).alias(c) for c in (*parts, "tie")], F.min("id").alias("id"), F.max("id").alias("high"))
    descriptors = collapse(rows)
    before = store.table("lacking")
    asked = lacking if before is None else lacking.unionByName(before).distinct()
    claims = rows.where("kind = 'c'").join(asked.distinct(), "key", "left_semi")
    claims = collapse(claims.withColumn("kind", F.lit("k")).withColumn("d", F.xxhash64(*parts, "tie")))
    work = write_shared(descriptors.unionByName(claims), "descriptors")
    store.put("lacking", lacking, add=True)
    labels = write_shared(_settle(work, store), "labels")
    one = labels.groupBy("d").agg(*[F.min(c).alias(c) for c in ("label", "first", "final", "kept", "unknown", "least")])
    named = write_shared(work.where("kind <> 'k'").join(one, "d"), "named")
    _keep(named, store)
    # tasks that share a role may each know a part of what was accepted up to a batch
    since = named.groupBy("tag", "label", "batch").agg(F.min("first").alias("first"))
    since = since.withColumn("first", F.min("first").over(Window.partitionBy("tag", "label").orderBy("batch")))
    answers = named.select("d", "tag", "label", "batch").join(since, ["tag", "label", "batch"]).select("d", "first")
    found = rows.select("id", "d").join(answers, "d").where("id > first")
    found = write_shared(found.select("first", F.col("id").alias("later")).distinct(), "repeats")
    store.commit()
    for df in (kept, tagged, rows, work, labels, named):
        discard(df)
    return found


def _settle(work: DataFrame, store: SegmentStore) -> DataFrame:
    """Labels of the descriptors: a task per shard of roles, and further ones for roles with very many incomplete rows, which share them out and have all else of the role."""
    n = store.shards
    shard = F.pmod(F.xxhash64("tag"), F.lit(n)).cast("int")
    large = work.where("kind = 'o'").groupBy("tag").count().where(F.col("count") > SHARD_ROWS).select("tag", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("parts"))
    work = work.join(large, "tag", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("tie"), F.col("parts")).cast("int")
    work = work.withColumn("part", F.explode(F.when(F.col("kind") == "o", F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    work = work.withColumn("shard", shard).withColumn("group", F.when(F.col("part") == 0, F.concat(F.lit("0:"), "shard")).otherwise(F.concat("part", F.lit(":"), "tag"))).drop("parts", "part")
    stored = store.read("postings")
    if stored is not None:
        stored = work.select("shard", "group").distinct().toDF("shard", "group").join(stored, "shard")
    return _cogroup(work, stored, "group", "d long, label string, first long, final string, kept array<long>, unknown int, least long", settle_postings)


def _keep(named: DataFrame, store: SegmentStore) -> None:
    """Add the new texts of this call's postings to the store, one record per posting and text, what took over stored postings, and the keys of rows that lacked a part under the rows' own ids."""
    cycle, place = F.col("cycle"), F.when(F.size("places") == 1, F.col("places")[0].cast("string")).otherwise("")
    named = named.withColumn("label", F.col("final"))
    seen = lambda f, c: F.coalesce(f(F.when(F.col("kind") == "c", F.col(c))), f(c))
    pid = F.when(F.col("label").rlike("^[cs]"), F.substring("label", 2, 20).try_cast("long")).otherwise(F.col("id"))
    firsts = named.groupBy("tag", "label").agg(F.min(pid).alias("pid"), seen(F.min, "id").alias("low"), seen(F.max, "high").alias("high"), F.array_distinct(F.flatten(F.collect_set("kept"))).alias("kept"), F.min("least").alias("first"))
    texts = named.where("kind = 'c' or label like 'o%'").select("tag", "label", F.when(F.col("label").startswith("o"), F.substring("label", 2, 1 << 20)).otherwise(F.concat("tag", F.lit(" "), cycle, F.lit(" @"), place, F.lit("|"), "tag", F.lit("@"), place, F.lit(" "), cycle, F.lit("|"))).alias("text"), F.col("label").startswith("o").cast("int").alias("open"))
    ties = named.where("kind = 'o'").groupBy("tag", "label", F.concat("tag", F.lit("~"), "tie", F.lit("|")).alias("text"), F.col("unknown").alias("open")).agg(F.min("id").alias("own"))
    records = texts.distinct().withColumn("own", F.lit(-1).cast("long")).unionByName(ties).join(firsts, ["tag", "label"]).withColumn("into", F.lit(-1).cast("long")).drop("kept", "label")
    over = firsts.select("tag", F.lit("").alias("text"), F.lit(1).alias("open"), F.lit(-1).cast("long").alias("own"), "low", "high", "first", F.explode("kept").alias("pid"), F.col("pid").alias("into")).where("pid <> into")
    records = records.unionByName(over).withColumn("shard", F.pmod(F.xxhash64("tag"), F.lit(store.shards)).cast("int")).drop("tag")

    def build(pdf: pd.DataFrame) -> Segment:
        return Segment([t.encode("ascii", "replace") for t in pdf["text"]], {c: pdf[c].astype(int).tolist() for c in ("pid", "first", "low", "high", "open", "own", "into")})

    store.add("postings", records, build)


def find_repeats(rows: DataFrame, reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``accept_batches`` of a whole table, batch after batch, into an empty store."""
    spark = rows.sparkSession
    shards = max(2 * spark.sparkContext.defaultParallelism, rows.count() // SHARD_ROWS + 1)
    root = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    found = accept_batches(rows, reference, aliases, SegmentStore(spark, root, shards))
    remove(spark, root)
    return found
