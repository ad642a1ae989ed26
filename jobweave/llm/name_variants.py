"""Variant spellings of names typed by people (problem 5).

Names are blocked by phonetic codes of their sorted tokens, compared with Jaro-Winkler plus a nickname table, and accepted pairs are clustered by
connected components. A name that leaves out what the organisation does joins a cluster only if exactly one fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import connected_components, spread
from jobweave.llm.names import codes, read_name, same_name, same_word
from jobweave.session import write_shared

#: A block with more forms than this is compared in slices, so that no task holds all pairs of it.
BLOCK_SLICE = 400


def _form(cores: tuple[str, ...], kind: str) -> str:
    return "+".join(cores) + "|" + kind


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [read_name(n) for n in b["readable"]]
        yield pd.DataFrame({"name": b["name"], "cores": [list(g[0]) for g in got], "trade": [g[1] for g in got], "form": [_form(*g) for g in got]})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocking keys of forms: full forms by code and trade, and every core by code alone for names without a trade."""
    for b in batches:
        rows = []
        for form, cores, kind in zip(b["form"], b["cores"], b["trade"]):
            full = bool(kind) or len(cores) > 1
            for c in cores:
                rows += [(form, list(cores), kind, full, f"{k}|{kind or ('&' if full else '')}") for k in codes(c)] if full else []
                rows += [(form, list(cores), kind, full, f"{k}|*") for k in codes(c)]
            if len(cores) > 1:
                rows.append((form, list(cores), kind, full, min(codes("".join(cores)), key=lambda x: (-len(x), x)) + "|*"))
        yield pd.DataFrame(rows, columns=["form", "cores", "trade", "full", "key"])


def _same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [same_name((tuple(x), s), (tuple(y), t)) for x, s, y, t in zip(b["cores_a"], b["trade_a"], b["cores_b"], b["trade_b"])]
        yield b.loc[keep, ["a", "b"]]


def _level(core: str, cores: list[str]) -> int:
    """0: the core is one of the cores, 1: it is one cut short or mistyped, 9: neither."""
    bare = core.rstrip("*")
    if bare in cores or bare in ("".join(cores), "".join(reversed(cores))):
        return 0
    return 1 if any(same_word(core, c) for c in cores) else 9


def _bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        level = [_level(c[0], list(d)) for c, d in zip(b["core"], b["cores"])]
        out = b.assign(level=level)
        yield out.loc[out["level"] < 9, ["form", "entity", "level"]]


def plain(name: Column) -> Column:
    """Lower case, letters, digits and ``+#.`` kept, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, "&amp;", "&")), "[^a-z0-9+#.]+", " "))


def link_names(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """name, entity for every distinct ``name``: names with one entity mean the same organisation.

    ``aliases`` (alias, canonical) is the nickname table: a name whose plain form is an alias is read as its canonical name. Null and blank names have no
    row. Names without any letter or digit are entities of their own. Repeated rows count once. A name without its trade that fits several organisations
    stays alone, so that it cannot tie them together. Empty tables give an empty result; only the named columns are read.
    """
    distinct = names.select("name").where(F.trim("name") != "").distinct()
    if aliases is not None:
        table = aliases.groupBy(plain(F.col("alias")).alias("plain")).agg(F.min("canonical").alias("canonical"))
        distinct = distinct.withColumn("plain", plain(F.col("name"))).join(table, "plain", "left").select("name", F.coalesce("canonical", "name").alias("readable"))
    else:
        distinct = distinct.withColumn("readable", F.col("name"))
    read = write_shared(spread(distinct).mapInPandas(_read, "name string, cores array<string>, trade string, form string"), "names")
    forms = read.where("form <> '|'").groupBy("form").agg(F.first("cores").alias("cores"), F.first("trade").alias("trade"))
    keys = write_shared(spread(forms).mapInPandas(_keys, "form string, cores array<string>, trade string, full boolean, key string"), "name-keys")
    # pairs within blocks; a large block is cut into slices, each compared with every other in tasks of its own
    strict = keys.where("full and not key like '%|*'")
    slices = strict.groupBy("key").agg(F.count("*").alias("n")).withColumn("slices", F.ceil(F.col("n") / BLOCK_SLICE).cast("int")).where("n > 1")
    sliced = strict.join(slices, "key").withColumn("slice", F.pmod(F.xxhash64("form"), F.col("slices")).cast("int"))
    left = sliced.select("key", F.col("slice").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("sb"), F.col("form").alias("a"), F.col("cores").alias("cores_a"), F.col("trade").alias("trade_a"))
    right = sliced.select("key", F.col("slice").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("sa"), F.col("form").alias("b"), F.col("cores").alias("cores_b"), F.col("trade").alias("trade_b"))
    pairs = left.join(right, ["key", "sa", "sb"]).where("a < b").drop("key", "sa", "sb").dropDuplicates(["a", "b"])
    edges = spread(pairs).mapInPandas(_same, "a string, b string")
    groups = connected_components(edges)
    full = forms.where("trade <> '' or size(cores) > 1").join(groups.withColumnRenamed("node", "form"), "form", "left").select("form", "cores", F.coalesce("component", "form").alias("entity"))
    full = write_shared(full, "name-entities")
    loose = keys.where("key like '%|*'")
    bare = loose.where("not full").select("form", F.col("cores").alias("core"), "key")
    against = loose.where("full").select(F.col("form").alias("other"), "key").join(full.withColumnRenamed("form", "other"), "other").select("key", "cores", "entity")
    near = spread(bare.join(against, "key").select("form", "core", "cores", "entity").distinct()).mapInPandas(_bare, "form string, entity string, level int")
    best = near.groupBy("form").agg(F.min("level").alias("best"))
    decided = near.join(best, "form").where("level = best").groupBy("form").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    chosen = full.select("form", "entity").unionByName(decided.select("form", F.when(F.col("low") == F.col("high"), F.col("low")).alias("entity")).withColumn("entity", F.coalesce("entity", F.lit("?"))))
    whole = read.join(chosen, "form", "left")
    return whole.select("name", F.when(F.col("entity") == "?", F.concat(F.lit("?"), "name")).when(F.col("form") == "|", F.concat(F.lit("?"), "name")).otherwise(F.coalesce("entity", "form")).alias("entity"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """name_a, name_b: all pairs of different names of one entity, the smaller by code points first.

    The pairs are the asked result; an entity's names are joined by key, so a large entity is split by adaptive execution and never held in one task.
    """
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
