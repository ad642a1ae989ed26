"""Ledger pages (JSON of typed properties) as exclusions, and boards guessed or harvested from addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.identity import company_key
from jobweave.functions.text import normalize_text, slug_candidates
from jobweave.functions.url import board_from_url, canonicalize_url

_PROPERTIES = "map<string,struct<type:string,title:array<struct<plain_text:string>>,rich_text:array<struct<plain_text:string>>,url:string,select:struct<name:string>,status:struct<name:string>>>"


def _text(p: Column) -> Column:
    """The text of a typed property."""
    plain = lambda a: F.nullif(F.array_join(F.transform(a, lambda t: t["plain_text"]), ""), F.lit(""))
    return F.coalesce(plain(p["title"]), plain(p["rich_text"]), p["url"], p["select"]["name"], p["status"]["name"])


def _named(properties: Column, names: list[str]) -> Column:
    """The first of several properties, by name without regard to case."""
    low = F.transform_keys(properties, lambda k, _: F.lower(k))
    return F.coalesce(*[_text(F.element_at(low, n.lower())) for n in names])


def read_exclusions(pages: DataFrame, company: list[str], title: list[str], link: list[str], ident: list[str]) -> DataFrame:
    """page_id, company_normalized, title_normalized, canonical_url, source_job_id of pages (page_id, properties as JSON) that name a company and a title."""
    p = pages.select("page_id", F.from_json("properties", _PROPERTIES).alias("p"))
    out = p.select("page_id", company_key(_named(F.col("p"), company)).alias("company_normalized"), normalize_text(_named(F.col("p"), title)).alias("title_normalized"), canonicalize_url(_named(F.col("p"), link)).alias("canonical_url"), _named(F.col("p"), ident).alias("source_job_id"))
    return out.where("company_normalized <> '' and title_normalized <> ''")


def board_candidates(companies: DataFrame, systems: list[str]) -> DataFrame:
    """company, ats, slug: the boards that companies may have, to be probed."""
    slugs = companies.select("company", F.explode(slug_candidates(F.col("company"))).alias("slug"))
    return slugs.select("company", F.explode(F.array(*[F.lit(s) for s in systems])).alias("ats"), "slug")


def harvest_boards(links: DataFrame, configured: DataFrame) -> DataFrame:
    """ats, board, url: boards met in addresses (url, ordinal) that are not configured yet, the first address of each."""
    b = links.withColumn("b", board_from_url(F.col("url"))).where("b is not null").select(F.col("b.ats").alias("ats"), F.col("b.board").alias("board"), "url", "ordinal")
    return b.groupBy("ats", "board").agg(F.min_by("url", F.struct("ordinal", "url")).alias("url")).join(configured.select("ats", "board"), ["ats", "board"], "left_anti")


def unconfigured(watchlist: DataFrame, configured: DataFrame) -> DataFrame:
    """parent of watched companies none of whose names is configured (column ``company``)."""
    names = watchlist.select("parent", F.explode(F.array_union(F.array("parent"), "aliases")).alias("n")).select("parent", F.lower("n").alias("n"))
    known = names.join(configured.select(F.lower("company").alias("n")).distinct(), "n", "left_semi").select("parent").distinct()
    return watchlist.select("parent").distinct().join(known, "parent", "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """The rows of all sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
