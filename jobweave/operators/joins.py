"""Joins of the feed: aliases, overrides, exclusions, suppression, identity, top-1 per key. Disjunctions are unions of equi-joins, never nested loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.identity import EARLY, identity_words, same_employer, words_describe_one_role, words_describe_same_role
from jobweave.functions.text import normalize_text
from jobweave.operators.dedupe import distinct_first


def alias_table(*layers: DataFrame) -> DataFrame:
    """alias, canonical from layers of (alias, canonical), a later layer before an earlier one; within a layer the smallest canonical."""
    numbered = [layer.select("alias", "canonical", F.lit(k).alias("_layer")) for k, layer in enumerate(layers)]
    whole = reduce(DataFrame.unionByName, numbered).where("alias is not null")
    return distinct_first(whole, ["alias"], [F.col("_layer").desc(), F.col("canonical")]).drop("_layer")


def resolve_alias(rows: DataFrame, column: str, aliases: DataFrame, name: str = "resolved") -> DataFrame:
    """+ ``name``: the canonical name of ``column``, or the column itself. Each row stays one row."""
    table = aliases.select(F.col("alias").alias(column), F.col("canonical").alias("_canonical"))
    return rows.join(table, column, "left").withColumn(name, F.coalesce("_canonical", column)).drop("_canonical")


def lookup(rows: DataFrame, column: str, table: DataFrame, key: str, value: str, default: object, name: str) -> DataFrame:
    """+ ``name``: the value found for ``column``, or the default."""
    found = table.groupBy(F.col(key).alias(column)).agg(F.max(value).alias(name))
    return rows.join(found, column, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def first_override(rows: DataFrame, ident: str, company: str, source_id: str, url: str, overrides: DataFrame) -> DataFrame:
    """+ ``override``: the verdict of the first override (by ``ordinal``) of the row's company whose id or address is the row's; null without one.

    ``overrides``: ordinal, company, source_job_id, canonical_url, verdict, all but company and verdict nullable.
    """
    o = overrides.select("ordinal", F.col("company").alias("_c"), F.col("source_job_id").alias("_i"), F.col("canonical_url").alias("_u"), "verdict")
    by_id = rows.select(ident, company, source_id).join(o.where("_i is not null"), (F.col(company) == F.col("_c")) & (F.col(source_id) == F.col("_i"))).select(ident, "ordinal", "verdict")
    by_url = rows.select(ident, company, url).join(o.where("_u is not null"), (F.col(company) == F.col("_c")) & (F.col(url) == F.col("_u"))).select(ident, "ordinal", "verdict")
    best = by_id.unionByName(by_url).groupBy(ident).agg(F.min_by("verdict", "ordinal").alias("override"))
    return rows.join(best, ident, "left")


def excluded_ids(rows: DataFrame, ident: str, company: str, title: str, url: str, source_id: str, exclusions: DataFrame) -> DataFrame:
    """The ids of rows that an exclusion means: the same source id, the same http address, or the same company and a title of the same role.

    Three equi-joins, united. For the third, titles are reduced to their sets of meaningful words per company, so that wordings of one set are compared once.
    """
    e = exclusions
    by_id = rows.where(F.col(source_id).isNotNull() & (F.col(source_id) != "")).join(e.select(F.col("source_job_id").alias(source_id)).distinct(), source_id, "left_semi").select(ident)
    by_url = rows.where(F.col(url).startswith("http")).join(e.select(F.col("canonical_url").alias(url)).distinct(), url, "left_semi").select(ident)
    words = lambda c: F.array_sort(identity_words(F.col(c)))
    mine = rows.select(F.col(company).alias("_c"), words(title).alias("_x")).distinct()
    theirs = e.select(F.col("company_normalized").alias("_c"), words("title_normalized").alias("_y")).distinct()
    alike = mine.join(theirs, "_c").where(words_describe_one_role(F.col("_x"), F.col("_y"))).select("_c", "_x").distinct()
    by_words = rows.select(ident, F.col(company).alias("_c"), words(title).alias("_x")).join(alike, ["_c", "_x"], "left_semi").select(ident)
    equal = e.select(F.col("company_normalized").alias(company), F.col("title_normalized").alias(title)).distinct()
    by_title = by_words.unionByName(rows.join(equal, [company, title], "left_semi").select(ident))
    return by_id.unionByName(by_url).unionByName(by_title).distinct()


def drop_excluded(rows: DataFrame, ident: str, *args: object) -> DataFrame:
    return rows.join(excluded_ids(rows, ident, *args), ident, "left_anti")


def drop_sent(rows: DataFrame, signature: Column, sent: DataFrame) -> DataFrame:
    """Rows whose requisition signature is not among ``sent`` (column ``signature``); a null signature is never suppressed."""
    return rows.withColumn("_sig", signature).join(sent.select(F.col("signature").alias("_sig")).where("_sig is not null").distinct(), "_sig", "left_anti").drop("_sig")


def match_stored(incoming: DataFrame, stored: DataFrame, links: DataFrame) -> DataFrame:
    """id, stored_id: the stored posting that each incoming one is: the one first seen among those with the same key, the same address (of any source),
    the same company, title, place and cycle, or the same company and source id. ``links``: stored_id, url, source_job_id of each source's row.
    """
    s = stored.select(F.col("id").alias("stored_id"), "canonical_key", "company", "title", "location", "cycle", "first_seen_at")
    by_key = incoming.select("id", "canonical_key").join(s, "canonical_key").select("id", "stored_id", "first_seen_at")
    by_url = incoming.where(F.col("canonical_url").startswith("http")).select("id", F.col("canonical_url").alias("url")).join(links.select("stored_id", "url").distinct(), "url").join(s.select("stored_id", "first_seen_at"), "stored_id").select("id", "stored_id", "first_seen_at")
    same = ["company", "title", "location", "cycle"]
    by_tuple = incoming.select("id", *same).join(s.select("stored_id", "first_seen_at", *same), same).select("id", "stored_id", "first_seen_at")
    of_links = links.where("source_job_id is not null").select("stored_id", "source_job_id").distinct().join(s.select("stored_id", "company", "first_seen_at"), "stored_id")
    by_source = incoming.where("source_job_id is not null").select("id", "company", "source_job_id").join(of_links, ["company", "source_job_id"]).select("id", "stored_id", "first_seen_at")
    every = by_key.unionByName(by_url).unionByName(by_tuple).unionByName(by_source)
    return every.groupBy("id").agg(F.min_by("stored_id", F.struct("first_seen_at", "stored_id")).alias("stored_id"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the latest row of each key, by partial aggregation (no sort); ties by the later of ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def first_listing_match(listings: DataFrame, postings: DataFrame) -> DataFrame:
    """listing_id, posting_id: the first posting (by ordinal) whose employer's name contains or is contained in the listing's and whose title tells the same role.

    Both have name and title. Rows are reduced to distinct (name, set of meaningful words, early career or not), and the distinct names meet first: equal ones, and
    each with those that hold its first three characters anywhere, across word borders too. Rows without a name or a title match nothing.
    """
    def reduced(rows: DataFrame, ident: str, best: Column, side: str) -> DataFrame:
        keys = [normalize_text(F.col("name")).alias(f"{side}name"), F.array_sort(identity_words(normalize_text(F.col("title")))).alias(f"{side}words"), F.col("title").rlike(EARLY).alias("early")]
        out = rows.where("name is not null and title is not null").select(ident, *keys, *([best.alias("ordinal")] if side == "p" else []))
        return out.groupBy(f"{side}name", "pwords", "early").agg(F.min(F.struct("ordinal", ident)).alias("best")) if side == "p" else out

    def starts(names: DataFrame, name: str) -> DataFrame:
        return names.where(F.length(name) > 2).select(name, F.substring(name, 1, 3).alias("block"))

    def grams(names: DataFrame, name: str) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda k: F.substring(F.col(name), k, F.lit(3)))
        return names.where(F.length(name) > 2).select(name, F.explode(F.array_distinct(every)).alias("block"))

    left = reduced(listings, "listing_id", F.lit(0), "l")
    asked = left.select("lname", "lwords", "early").distinct()
    right = reduced(postings, "posting_id", F.col("ordinal"), "p")
    mine, theirs = asked.select("lname").where("lname <> ''").distinct(), right.select("pname").where("pname <> ''").distinct()
    equal = mine.join(theirs, F.col("lname") == F.col("pname"))
    held = starts(mine, "lname").join(grams(theirs, "pname"), "block").select("lname", "pname")
    holding = grams(mine, "lname").join(starts(theirs, "pname"), "block").select("lname", "pname")
    names = equal.unionByName(held).unionByName(holding).where(same_employer(F.col("lname"), F.col("pname"))).distinct()
    met = asked.join(names, "lname").join(right, ["pname", "early"]).where(words_describe_same_role(F.col("lwords"), F.col("pwords")))
    found = met.groupBy("lname", "lwords", "early").agg(F.min("best").alias("best"))
    return left.select("listing_id", "lname", "lwords", "early").distinct().join(found, ["lname", "lwords", "early"]).select("listing_id", F.col("best.posting_id").alias("posting_id"))
