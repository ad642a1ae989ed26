"""Registered queries of sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.session import shared_dir, table, write_shared
from jobweave.sources.boards import STUDENT_TITLE, read_boards
from jobweave.sources.pages import page_runs, parse_cards, parse_link_postings, parse_table_postings, table_rows
from jobweave.streaming import feeds


KINDS = ["greenhouse", "lever", "ashby", "smartrecruiters", "oracle", "workday", "generic", "items"]
_WRAP = {"greenhouse": '{{"jobs":[{}]}}', "lever": "[{}]", "ashby": '{{"jobs":[{}]}}', "smartrecruiters": '{{"content":[{}]}}', "oracle": '{{"items":[{{"requisitionList":[{}]}}]}}', "workday": '{{"jobPostings":[{}]}}', "generic": '{{"results":[{}]}}', "items": "[{}]"}


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every raw posting as a record of a board's payload, in all eight formats, up to five records to a payload; a missing title or address is a record that its board's format may not allow."""
    r = table(spark, d, "raw_postings")
    ident, u, place = F.col("posting_id").cast("string"), F.col("source_url"), F.struct(F.coalesce("location", F.lit("")).alias("name"))
    text, kind = F.col("description"), F.col("employment_type")
    records = {
        "greenhouse": F.struct(ident.alias("id"), "title", u.alias("absolute_url"), F.col("posted_at").alias("first_published"), place.alias("location"), text.alias("content")),
        "lever": F.struct(ident.alias("id"), F.col("title").alias("text"), u.alias("hostedUrl"), F.col("direct_apply_url").alias("applyUrl"), F.unix_millis("ingested_at").alias("createdAt"), F.struct("location", kind.alias("commitment")).alias("categories"), text.alias("descriptionPlain")),
        "ashby": F.struct(ident.alias("id"), "title", "location", F.col("posted_at").alias("publishedAt"), u.alias("jobUrl"), F.col("direct_apply_url").alias("applyUrl"), text.alias("descriptionPlain"), kind.alias("employmentType")),
        "smartrecruiters": F.struct(ident.alias("id"), F.col("title").alias("name"), u.alias("ref"), F.col("posted_at").alias("releasedDate"), F.struct(F.col("location").alias("city"), F.lit("US").alias("country")).alias("location")),
        "oracle": F.struct(ident.alias("Id"), F.col("title").alias("Title"), F.col("location").alias("PrimaryLocation"), F.date_format("ingested_at", "yyyy-MM-dd").alias("PostedDate"), text.alias("ShortDescriptionStr"), kind.alias("JobSchedule")),
        "workday": F.struct(F.array(ident).alias("bulletFields"), "title", F.col("location").alias("locationsText"), F.concat(F.lit("Posted "), (F.col("posting_id") % 30).cast("string"), F.lit(" Days Ago")).alias("postedOn"), kind.alias("timeType"), F.concat(F.lit("/job/"), ident).alias("externalPath")),
        "generic": F.struct(ident.alias("id"), "title", "location", F.lit("Posted Yesterday").alias("postedOn"), text.alias("description"), kind.alias("employmentType"), u.alias("url"), F.col("direct_apply_url").alias("applyUrl")),
        "items": F.struct(ident.alias("id"), "title", F.struct(F.col("company").alias("name")).alias("company"), "location", F.col("posted_at").alias("postedAt"), text.alias("descriptionText"), kind.alias("employmentType"), u.alias("url"), F.col("direct_apply_url").alias("applyUrl")),
    }
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod(F.col("posting_id"), F.lit(8)) + 1).cast("int"))
    one = F.lit(None).cast("string")
    for k in KINDS:
        one = F.when(F.col("kind") == k, F.to_json(records[k])).otherwise(one)
    r = r.withColumn("kind", name).select("posting_id", "kind", F.floor(F.col("posting_id") / 40).alias("group"), one.alias("record"))
    groups = r.groupBy("kind", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("posting_id", "record"))), lambda x: x["record"]).alias("records"))
    payload = F.lit(None).cast("string")
    for k, wrap in _WRAP.items():
        before, after = wrap.format("\x00").split("\x00")
        payload = F.when(F.col("kind") == k, F.concat(F.lit(before), F.array_join("records", ","), F.lit(after))).otherwise(payload)
    none = F.lit(None).cast("string")
    rows = groups.select(F.concat_ws(":", "kind", F.col("group").cast("string")).alias("source_name"), "kind", F.lit("Acme").alias("company"), F.lit("https://h.example/").alias("host"), F.lit("S").alias("site"), payload.alias("payload"), F.lit("2026-11-20T00:00:00Z").alias("scraped_at"), none.alias("profile"), F.lit(None).cast("int").alias("max_rows"))
    return write_shared(rows, "payloads")


def board_postings(spark: SparkSession, d: str) -> DataFrame:
    p, _ = read_boards(_payloads(spark, d))
    return p.select("source_name", "source_job_id", "title", "company", "location", "posted_at", "description", "employment_type", "source_url", "direct_apply_url")


def board_runs(spark: SparkSession, d: str) -> DataFrame:
    _, r = read_boards(_payloads(spark, d))
    return r.groupBy(F.substring_index("source_name", ":", 1).alias("kind"), "status").agg(F.count("*").alias("n"), F.sum("fetched_count").alias("fetched"))


_KIND = "([" + ", ".join(f"'{k}'" for k in KINDS) + "])[posting_id % 8 + 1]"
_RECORDS = f"""(select *, posting_id % 8 k, {_KIND} || ':' || (posting_id // 40) source, coalesce(title, '') <> '' and case when posting_id % 8 < 4 then coalesce(source_url, '') <> '' when posting_id % 8 = 7 then coalesce(source_url, '') <> '' and coalesce(company, '') <> '' else true end ok from raw_postings)"""


def document_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and cells of the tables within documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_name"), F.lit("").alias("url"), F.lit(None).cast("string").alias("cycle_hint"), F.lit("2026-11-20T00:00:00Z").alias("scraped_at"), F.col("text").alias("document"))
    return table_rows(docs).groupBy("source_name").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"))


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "raw_postings").where("direct_apply_url is not null and title is not null").select(F.concat_ws(":", "source_name", "posting_id").alias("source_name"), F.lit("https://lists.example").alias("url"), "cycle_hint", F.lit("2026-11-20T00:00:00Z").alias("scraped_at"), F.concat(F.lit("| Company | Role | Location | Link | Age |\n|---|---|---|---|---|\n| "), F.regexp_replace(F.coalesce("company", F.lit("")), r"\|", "/"), F.lit(" | "), F.regexp_replace("title", r"\|", "/"), F.lit(" | "), F.regexp_replace(F.coalesce("location", F.lit("")), r"\|", "/"), F.lit(" | [Apply]("), F.col("direct_apply_url"), F.lit(") | 9d |")).alias("document"))
    return parse_table_postings(docs).select("source_name", "title", "company", "location", "posted_at", "direct_apply_url")


def _pages(rows: DataFrame, item: Column, before: str = "", size: int = 25) -> DataFrame:
    """Pages of up to ``size`` items each (posting_id, source_name and the item's HTML), as documents; page breaks follow posting_id."""
    page = F.floor(F.col("posting_id") / size)
    d = rows.select("source_name", page.alias("page"), "posting_id", item.alias("item")).groupBy("source_name", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("posting_id", "item"))), lambda x: x["item"]), "\n").alias("items"))
    return d.select("source_name", F.concat(F.lit("https://lists.example/"), F.lpad(F.col("page").cast("string"), 20, "0")).alias("url"), F.lit(None).cast("string").alias("cycle_hint"), F.lit("2026-11-20T00:00:00Z").alias("scraped_at"), F.concat(F.lit(before), "items").alias("document"))


def _card_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every raw posting as a card; the id of a card is that of its posting but for every tenth, which repeats the one before."""
    r = table(spark, d, "raw_postings")
    ident = (F.col("posting_id") - F.when(F.col("posting_id") % 10 == 9, 1).otherwise(0)).cast("string")
    part = lambda c: F.coalesce(F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")")), F.lit(""))
    card = F.concat(F.lit('<li><div data-entity-urn="urn:li:jobPosting:'), ident, F.lit('"><h3 class="base-search-card__title">'), part("title"), F.lit('</h3><h4 class="base-search-card__subtitle"><a>'), part("company"), F.lit('</a></h4><span class="job-search-card__location">'), part("location"), F.lit('</span><time datetime="'), F.date_format("ingested_at", "yyyy-MM-dd"), F.lit('"></time></div></li>'))
    return _pages(r, card)


def card_postings(spark: SparkSession, d: str) -> DataFrame:
    return parse_cards(_card_documents(spark, d)).select("source_name", "source_job_id", "title", "company", "location", "posted_at", "source_url")


def link_postings(spark: SparkSession, d: str) -> DataFrame:
    """Every direct link of a raw posting in a page of links, a few of them repeated; short labels are titled by the text around."""
    u = F.col("direct_apply_url")
    r = table(spark, d, "raw_postings").where(u.startswith("http") & ~u.rlike(r'["<>&\s]'))
    label = F.concat(F.lit("Position "), F.col("posting_id").cast("string"))
    anchor = F.concat(F.lit('<p><a href="'), "direct_apply_url", F.lit('">'), label, F.lit("</a></p>"))
    again = F.when(F.col("posting_id") % 7 == 0, F.concat(anchor, F.lit('<a href="'), F.col("direct_apply_url"), F.lit('">again, later</a>'))).otherwise(anchor)
    return parse_link_postings(_pages(r, again)).select("source_name", "title", "company", "source_url", "direct_apply_url")


def page_run_states(spark: SparkSession, d: str) -> DataFrame:
    """Runs of pages of cards, where the mark-up of every third source has changed."""
    docs = _card_documents(spark, d).withColumn("document", F.when(F.length("source_name") % 3 == 0, F.replace("document", F.lit("<li>"), F.lit("<div>"))).otherwise(F.col("document")))
    return page_runs(docs, parse_cards(docs), 0).select("source_name", "status", "fetched_count")


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what there is, into a folder of the shared one, and read it."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, feeds.dedup_within_watermark(_events(spark, d), ["event_id"], "ts", "7 days").select("event_id", "event_type"))


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, feeds.tumbling_counts(_events(spark, d), "ts", "1 day", "1 day", ["event_type"])).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, feeds.sessions(_events(spark, d), "ts", "6 hours", "1 day", "user_id")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def stale_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    until = e.agg(F.max("ts")).first()[0]
    return feeds.stale_events(e, "user_id", "ts", str(until), 24)


_CARD_TEXT = "trim(regexp_replace(replace(replace(coalesce({0}, ''), '<', '('), '>', ')'), '\\s+', ' ', 'g'))"
_CARDS = f"""with f as (select posting_id, source_name, (posting_id - (posting_id % 10 = 9)::int)::varchar id, {_CARD_TEXT.format('title')} t, {_CARD_TEXT.format('company')} c, {_CARD_TEXT.format('"location"')} l, strftime(ingested_at at time zone 'UTC', '%Y-%m-%d') || 'T00:00:00.000Z' d, repeat('x', 200) card from raw_postings)"""

#: The pattern of student titles without look-around, which SQL lacks: the edges are matched as characters.
STUDENT_SQL = STUDENT_TITLE.replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])")

SQL = {
    "board_postings": f"""with r as {_RECORDS}, g as (select source, bool_and(ok) whole from r group by 1)
  select source source_name, posting_id::varchar source_job_id, title, case when k = 7 then company else 'Acme' end company,
  case k when 0 then coalesce("location", '') when 3 then coalesce(nullif("location", '') || ', ', '') || 'US' when 5 then coalesce(nullif("location", ''), 'Unspecified') when 6 then coalesce(nullif("location", ''), 'Unspecified') when 7 then nullif("location", '') else "location" end "location",
  case when k in (0, 2, 3) then posted_at when k = 7 then nullif(posted_at, '') when k = 1 then strftime(ingested_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') when k = 4 then strftime(ingested_at at time zone 'UTC', '%Y-%m-%d') || 'T00:00:00.000Z'
    when k = 5 then strftime(date '2026-11-19' - (posting_id % 30)::int, '%Y-%m-%d') || 'T00:00:00.000Z' else '2026-11-18T00:00:00.000Z' end posted_at,
  case when k = 0 then case when regexp_matches(title, '{STUDENT_SQL}') then description end when k in (1, 2) then description when k in (4, 6, 7) then nullif(description, '') end description,
  case when k = 0 then 'Internship' when k in (1, 2, 4) then employment_type when k in (5, 6, 7) then nullif(employment_type, '') end employment_type,
  case k when 4 then 'https://h.example/hcmUI/CandidateExperience/en/sites/S/job/' || posting_id when 5 then 'https://h.example/en-US/S/job/' || posting_id when 6 then coalesce(nullif(source_url, ''), 'https://h.example/') else source_url end source_url,
  case k when 1 then coalesce(direct_apply_url, source_url) when 2 then coalesce(direct_apply_url, source_url) when 4 then 'https://h.example/hcmUI/CandidateExperience/en/sites/S/job/' || posting_id when 5 then 'https://h.example/en-US/S/job/' || posting_id
    when 6 then nullif(direct_apply_url, '') when 7 then nullif(direct_apply_url, '') else source_url end direct_apply_url
  from r join g using (source) where case when k < 5 then whole else ok end""",
    "board_runs": f"with r as {_RECORDS}, g as (select source, any_value(k) k, bool_and(ok) whole, count(*) n from r group by 1) select split_part(source, ':', 1) kind, case when k < 5 and not whole then 'FAILED' else 'SUCCESS' end status, count(*) n, sum(case when k < 5 and not whole then 0 else n end)::bigint fetched from g group by 1, 2",
    "card_postings": _CARDS + " select source_name, id source_job_id, t title, c company, case when l = '' then 'Unspecified' else l end \"location\", d posted_at, 'https://www.linkedin.com/jobs/view/' || id source_url from f where t <> '' and c <> '' qualify row_number() over (partition by source_name, id order by posting_id) = 1",
    "page_run_states": _CARDS + """, s as (select source_name, count(*) n from (select distinct source_name, id from f where t <> '' and c <> '') group by 1), z as (select source_name, sum(length(card)) size from f group by 1)
  select source_name, case when length(source_name) % 3 = 0 and size > 0 then 'FAILED' else 'SUCCESS' end status, case when length(source_name) % 3 = 0 then 0 else coalesce(n, 0) end::bigint fetched_count from z left join s using (source_name)""",
    "link_postings": """with r as (select * from raw_postings where direct_apply_url like 'http%' and not regexp_matches(direct_apply_url, '["<>&\\s]') and regexp_matches(direct_apply_url, '(?i)job|career|apply|greenhouse|lever|ashby|workday|smartrecruiters'))
  select source_name, 'Position ' || posting_id title, 'Unverified company' company, 'https://lists.example/' || lpad((posting_id // 25)::varchar, 20, '0') source_url, direct_apply_url from r qualify row_number() over (partition by source_name, posting_id // 25, direct_apply_url order by posting_id) = 1""",
    "document_tables": r"""with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) x from documents),
  p as (select doc_id, count(*) n, sum(len(string_split(regexp_replace(regexp_replace(x, '^\s*\|', ''), '\|\s*$', ''), '|'))) c from l where regexp_matches(x, '^\s*\|') and not regexp_matches(x, '^\s*\|?\s*:?-{3}') group by 1),
  h as (select doc_id, unnest(list_transform(regexp_extract_all(text, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: len(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>')))) c from documents where doc_id not in (select doc_id from p))
  select doc_id::varchar source_name, n n_rows, c::bigint n_cells from p union all select doc_id::varchar, count(*), sum(c)::bigint from h where c >= 3 group by 1""",
    "stream_dedup": "select distinct event_id, event_type from events",
    "stream_tumbling": "select date_trunc('day', ts) window_start, event_type, count(*) n from events group by 1, 2 having date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 day",
    "stream_sessions": """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g)
  select user_id, min(ts) session_start, max(ts) + interval 6 hour session_end, count(*) n from s group by user_id, k having max(ts) + interval 6 hour <= (select max(ts) from events) - interval 1 day""",
    "stale_events": """with g as (select user_id, ts, lag(ts) over w b, lead(ts) over w a from events window w as (partition by user_id order by ts))
  select user_id, 'OPENED' event, ts "at" from g where b is null or ts > b + interval 24 hour union all select user_id, 'CLOSED', ts + interval 24 hour from g where coalesce(a, (select max(ts) from events)) > ts + interval 24 hour""",
}
QUERIES = {"board_postings": board_postings, "board_runs": board_runs, "card_postings": card_postings, "link_postings": link_postings, "page_run_states": page_run_states, "document_tables": document_tables, "document_postings": document_postings, "stream_dedup": stream_dedup, "stream_tumbling": stream_tumbling, "stream_sessions": stream_sessions, "stale_events": stale_events}
