"""Lists kept as Markdown or HTML pages, as raw postings. A document is a row: source_name, url, cycle_hint, document, scraped_at."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from jobweave.functions.dates import parse_listed_date, parse_posted_at
from jobweave.functions.text import clean_cell, extract_text
from jobweave.functions.url import source_job_id
from jobweave.schema import RAW_COLUMNS

_KEEP = ["source_name", "url", "cycle_hint", "scraped_at"]


def forward_fill(rows: DataFrame, column: str, partition: list[str], order: list[str], name: str) -> DataFrame:
    """+ ``name``: the last value of ``column`` so far that is not null."""
    w = W.Window.partitionBy(*partition).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(w))


def _links(cell: Column) -> Column:
    """array(struct(label, url)) of a cell: Markdown links first, then anchors; image buttons are labelled by their alt text."""
    alt = lambda c: clean_cell(F.regexp_replace(c, r"""(?i)<img[^>]*\balt=["']([^"']*)["'][^>]*>""", " $1 "))
    md = F.regexp_extract_all(cell, F.lit(r"(\[[^\]]*\]\(https?://[^)\s]+[^)]*\))"))
    md = F.transform(md, lambda m: F.struct(alt(F.regexp_extract(m, r"^\[([^\]]*)\]", 1)).alias("label"), F.regexp_extract(m, r"\((https?://[^)\s]+)", 1).alias("url")))
    a = F.regexp_extract_all(cell, F.lit(r"""(?is)(<a[^>]+href=["']https?://[^"']+["'][^>]*>.*?</a>)"""))
    a = F.transform(a, lambda m: F.struct(alt(F.regexp_extract(m, r"(?is)<a[^>]*>(.*?)</a>", 1)).alias("label"), F.regexp_extract(m, r"""(?i)href=["'](https?://[^"']+)["']""", 1).alias("url")))
    return F.concat(md, a)


def table_rows(documents: DataFrame) -> DataFrame:
    """document columns + line_no, cells of every table row: pipe rows where the document has them, else rows of HTML tables with three cells or more."""
    pipe = F.filter(F.split("document", r"\r?\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^\s*\|?\s*:?-{3}"))
    html = F.regexp_extract_all("document", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"))
    d = documents.withColumn("_pipe", pipe)
    piped = d.where(F.size("_pipe") > 0).select(*_KEEP, F.posexplode("_pipe").alias("line_no", "line"))
    piped = piped.withColumn("cells", F.transform(F.split(F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", ""), r"\|", -1), lambda x: F.trim(x))).drop("line")
    tabled = d.where(F.size("_pipe") == 0).select(*_KEEP, F.posexplode(html).alias("line_no", "line"))
    tabled = tabled.withColumn("cells", F.regexp_extract_all("line", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"))).where(F.size("cells") >= 3).drop("line")
    return piped.unionByName(tabled)


def parse_table_postings(documents: DataFrame) -> DataFrame:
    """Raw postings of table pages. A company cell that is empty or a ditto mark repeats the one above; rows that are closed, headers, or without a link or
    title are dropped; the link is the one labelled apply, else the first that is no company profile, the role cell's before others; a last cell that is a date dates the row."""
    cell = lambda k: F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit(""))
    rows = table_rows(documents).where(F.size("cells") >= 3)
    rows = rows.where(~(cell(1).rlike("(?i)company") & cell(2).rlike("(?i)role|position")))
    own = F.trim(F.regexp_replace(clean_cell(cell(1)), r"^[^\p{L}\p{N}(]+", ""))
    raw_own = F.trim(clean_cell(cell(1)))
    ditto = raw_own.isin("↳", "same", "〃", "^") | (own == "") | own.isin("same")
    rows = forward_fill(rows.withColumn("_own", F.when(~ditto, own)), "_own", ["source_name", "url"], ["line_no"], "company")
    others = F.flatten(F.transform(F.filter("cells", lambda c, k: k != 1), _links))
    found = F.concat(_links(cell(2)), others)
    rows = rows.withColumn("title", clean_cell(cell(2))).withColumn("_links", found).withColumn("line", F.array_join("cells", " | "))
    rows = rows.where((F.col("company") != "") & (F.col("title") != "") & (F.size("_links") > 0) & ~F.col("line").rlike("(?i)closed|🔒"))
    pick = lambda f: F.try_element_at(F.filter("_links", f), F.lit(1))["url"]
    link = F.coalesce(pick(lambda x: x["label"].rlike("(?i)apply|application")), pick(lambda x: ~x["url"].rlike(r"(?i)simplify\.jobs/c/")), F.col("_links")[0]["url"])
    posted = parse_posted_at(clean_cell(F.element_at("cells", -1)), F.col("scraped_at").try_cast("timestamp"))
    rows = rows.withColumn("direct_apply_url", link).withColumn("_posted", posted)
    details = F.slice("cells", F.lit(4), F.greatest(F.size("cells") - 3 - F.when(F.col("_posted").isNotNull(), 1).otherwise(0), F.lit(0)))
    cols = {
        "source_job_id": source_job_id(F.col("direct_apply_url")), "title": F.col("title"), "company": F.col("company"), "location": F.coalesce(F.nullif(clean_cell(cell(3)), F.lit("")), F.lit("Unspecified")),
        "posted_at": F.date_format("_posted", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "description": clean_cell(F.array_join(details, " ")), "source_url": F.col("url"), "direct_apply_url": F.col("direct_apply_url"), "raw": F.to_json(F.struct(F.col("line").alias("row"))),
    }
    return _raw(rows, cols, "line_no")


def _raw(rows: DataFrame, cols: dict[str, Column], ordinal: str) -> DataFrame:
    given = {c: F.col(c) for c in ("source_name", "scraped_at", "cycle_hint")} | cols
    return rows.select(*[given.get(c, F.lit(None)).cast("string").alias(c) for c in RAW_COLUMNS], F.col(ordinal).alias("ordinal"))


_ANCHOR = re.compile(r"""<a[^>]+href=["'](https?://[^"']+)["'][^>]*>([\s\S]*?)</a>""", re.I)


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors with the text around them; the place of a match in the text is nothing that a column expression can give."""
    for b in batches:
        rows = []
        for n, document in enumerate(b["document"]):
            text = (document or "").replace("&quot;", '"').replace("&amp;", "&").replace("&#x27;", "'")
            rows += [(n, k, m[1], m[2], text[max(0, m.start() - 600) : m.start() + 600]) for k, m in enumerate(_ANCHOR.finditer(text))]
        found = pd.DataFrame(rows, columns=["_n", "line_no", "link", "label", "context"])
        yield b[_KEEP].reset_index(drop=True).join(found.set_index("_n"), how="inner")


def parse_link_postings(documents: DataFrame) -> DataFrame:
    """Raw postings of pages of links: anchors whose address looks like a job's, each address once, titled by their label or the text around."""
    rows = documents.select(*_KEEP, "document").mapInPandas(_anchors, "source_name string, url string, cycle_hint string, scraped_at string, line_no int, link string, label string, context string")
    rows = rows.withColumn("label", clean_cell(F.col("label"))).withColumn("context", clean_cell(F.col("context")))
    rows = rows.where((F.col("label") != "") & F.col("link").rlike("(?i)job|career|apply|greenhouse|lever|ashby|workday|smartrecruiters"))
    first = W.Window.partitionBy("source_name", "url", "link").orderBy("line_no")
    rows = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    title = F.when((F.length("label") > 4) & (F.length("label") < 180), F.col("label")).otherwise(F.substring("context", 1, 150))
    return _raw(rows, {"title": title, "company": F.lit("Unverified company"), "location": F.lit("Unspecified"), "description": F.col("context"), "source_url": F.col("url"), "direct_apply_url": F.col("link")}, "line_no")


def parse_cards(documents: DataFrame) -> DataFrame:
    """Raw postings of pages of cards (``<li>`` with an id, a title and a company); an id counts once per source, where it comes first by address and line."""
    get = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("card", p, 1), "<[^>]*>", " "), "&amp;", "&"), "&#x27;|&apos;", "'"), "&quot;", '"'), r"\s+", " "))
    cards = documents.select(*_KEEP, F.posexplode(F.split("document", "<li>")).alias("line_no", "card")).where("line_no > 0")
    rows = cards.withColumn("ident", get(r'data-entity-urn="urn:li:jobPosting:(\d+)"')).withColumn("title", get(r"(?s)<h3[^>]*base-search-card__title[^>]*>(.*?)</h3>")).withColumn("company", get(r"(?s)<h4[^>]*base-search-card__subtitle[^>]*>(.*?)</h4>")).withColumn("place", get(r"(?s)<span[^>]*job-search-card__location[^>]*>(.*?)</span>"))
    rows = rows.withColumn("href", F.substring_index(F.regexp_extract("card", r'<a[^>]*base-card__full-link[^>]*href="([^"]+)"', 1), "?", 1)).withColumn("day", F.regexp_extract("card", r'<time[^>]*datetime="([\d-]+)"', 1))
    rows = rows.where("ident <> '' and title <> '' and company <> ''").withColumn("_rn", F.row_number().over(W.Window.partitionBy("source_name", "ident").orderBy("url", "line_no"))).where("_rn = 1")
    url = F.when(F.col("href") != "", F.col("href")).otherwise(F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.col("ident")))
    posted = F.when(F.col("day") != "", F.concat(F.col("day"), F.lit("T00:00:00.000Z")))
    return _raw(rows, {"source_job_id": F.col("ident"), "title": F.col("title"), "company": F.col("company"), "location": F.coalesce(F.nullif("place", F.lit("")), F.lit("Unspecified")), "posted_at": posted, "source_url": url, "direct_apply_url": url}, "line_no")


def parse_collection(documents: DataFrame) -> DataFrame:
    """source_name, url, line_no, title, company, href, posted_at, next_href of pages that hold a collection of ``role="listitem"`` parts; an address counts once."""
    cls = lambda c: extract_text(F.regexp_extract("part", f'class="{c}">([^<]*)<', 1))
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1), "/$", "")
    parts = documents.select(*_KEEP, F.regexp_extract(F.regexp_extract("document", r'<a\b([^>]*class="[^"]*w-pagination-next[^"]*"[^>]*)>', 1), r'href="([^"]+)"', 1).alias("next_href"), F.posexplode(F.split("document", '<div role="listitem"')).alias("line_no", "part")).where("line_no > 0")
    hrefs = F.filter(F.regexp_extract_all("part", F.lit(r'href="([^"]+)"')), lambda h: h.startswith(F.concat(path, F.lit("/"))))
    rows = parts.withColumn("title", cls("jobtitle")).withColumn("company", cls("companyname_list")).withColumn("posted_at", parse_listed_date(cls("blogtag"))).withColumn("href", F.try_element_at(hrefs, F.lit(1)))
    rows = rows.where("href is not null and title <> '' and company <> ''").withColumn("_rn", F.row_number().over(W.Window.partitionBy("source_name", "url", "href").orderBy("line_no"))).where("_rn = 1")
    return rows.select(*_KEEP, "line_no", "title", "company", "href", "posted_at", F.nullif("next_href", F.lit("")).alias("next_href"))


def parse_detail(html: Column) -> Column:
    """struct(location, description) of a posting's own page: the chip under the title, and the text from the heading to the rating card."""
    location = F.nullif(extract_text(F.regexp_extract(html, r'class="text-block-47">([^<]*)<', 1)), F.lit(""))
    body = F.when(F.contains(html, F.lit("<h1")), F.substring_index(F.concat(F.lit("<h1"), F.regexp_extract(html, r"(?s)<h1(.*)", 1)), "Glassdoor", 1))
    return F.struct(location.alias("location"), F.coalesce(extract_text(body), F.lit("")).alias("description"))


def join_details(rows: DataFrame, details: DataFrame, wanted: Column) -> DataFrame:
    """List rows with their detail pages (href, location, description): rows whose detail is wanted but missing are dropped, unwanted ones keep ``Unspecified``."""
    j = rows.withColumn("_wanted", wanted).join(details.select("href", "location", "description"), "href", "left")
    return j.where(~F.col("_wanted") | F.col("description").isNotNull()).withColumn("location", F.when(F.col("_wanted"), F.coalesce("location", F.lit("Unspecified"))).otherwise("Unspecified")).drop("_wanted")


def parse_watchlist(documents: DataFrame, priorities: list[tuple[str, int]], otherwise: int = 4, skip: tuple[str, ...] = ()) -> DataFrame:
    """parent, aliases, section, priority of lists of companies under ``##`` headings: commas between companies, slashes between the names of one.

    ``priorities``: patterns of headings with their priority, first match wins. Of a company that comes twice the higher priority stays, then the earlier line.
    """
    lines = documents.select(F.col("source_name").alias("doc"), F.posexplode(F.split("document", r"\r?\n")).alias("line_no", "line"))
    lines = forward_fill(lines.withColumn("_head", F.nullif(F.trim(F.regexp_extract("line", r"^##\s+(.+)", 1)), F.lit(""))), "_head", ["doc"], ["line_no"], "section")
    body = lines.where(F.col("section").isNotNull() & ~F.col("section").isin(list(skip)) & (F.trim("line") != "") & ~F.col("line").rlike("^[#-]"))
    groups = body.select("section", "line_no", F.posexplode(F.split(F.regexp_replace("line", r"\.$", ""), r",\s*")).alias("no", "names"))
    aliases = F.filter(F.transform(F.split("names", "/"), lambda x: F.trim(x)), lambda a: a != "")
    priority = F.lit(otherwise)
    for pattern, n in reversed(priorities):
        priority = F.when(F.col("section").rlike(pattern), n).otherwise(priority)
    rows = groups.withColumn("aliases", aliases).where(F.size("aliases") > 0).withColumn("parent", F.col("aliases")[0]).withColumn("priority", priority)
    best = W.Window.partitionBy(F.lower("parent")).orderBy(F.col("priority").desc(), "line_no", "no")
    return rows.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("parent", "aliases", "section", "priority")


def page_runs(documents: DataFrame, postings: DataFrame, least: int) -> DataFrame:
    """source_name, status, fetched_count, error_message of every source of ``documents``: FAILED if its pages have more than ``least`` characters and gave no posting.

    Changed mark-up looks like a day without news unless it is reported; a null document has no characters.
    """
    sizes = documents.groupBy("source_name").agg(F.sum(F.coalesce(F.length("document"), F.lit(0))).alias("_size"))
    got = postings.groupBy("source_name").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    bad = (n == 0) & (F.col("_size") > least)
    message = F.when(bad, F.concat(F.lit("no posting in "), F.col("_size").cast("string"), F.lit(" characters")))
    return sizes.join(got, "source_name", "left").select("source_name", F.when(bad, "FAILED").otherwise("SUCCESS").alias("status"), n.alias("fetched_count"), message.alias("error_message"))


def page_hashes(pages: DataFrame, least: int = 500) -> DataFrame:
    """url, content_hash, text_length: the hash of a watched page's text; '' (unreadable) below ``least`` characters."""
    t = pages.select("url", extract_text(F.col("html")).alias("_t"))
    return t.select("url", F.when(F.length("_t") >= least, F.sha2("_t", 256)).otherwise("").alias("content_hash"), F.coalesce(F.length("_t"), F.lit(0)).alias("text_length"))
