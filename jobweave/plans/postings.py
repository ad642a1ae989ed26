"""Registered queries of the feed's own operators over the tables of postings, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions import dates, identity, rules, text, url
from jobweave.operators import dedupe, joins, metrics, sinks, state
from jobweave.operators.dedupe import Order
from jobweave.session import table
from jobweave.sources.pages import forward_fill

NOW = "2026-11-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Classified rows with the keys of their identity."""
    j = table(spark, d, "classified_jobs")
    sig = identity.title_signature(F.col("normalized_title"))
    return j.withColumn("cycle0", F.coalesce("cycle", F.lit(""))).withColumn("signature", sig).withColumn("requisition", identity.requisition_signature(F.col("normalized_company"), F.col("normalized_title"), F.col("cycle")))


# SQL has no compatibility forms; the ellipsis is the only character of the tables that has one with signs that are kept
_N = "trim(regexp_replace(replace(replace(lower({0}), '…', '...'), '&amp;', '&'), '[^a-z0-9+#.]+', ' ', 'g'))"
_SIG = r"array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex({0}, '[^a-z0-9+#]+'), lambda w: w <> '' and not regexp_full_match(w, '" + identity.TITLE_NOISE.strip("^$") + r"')), lambda w: left(w, 5)))), '.')"
_STATES = "map {{" + ", ".join(f"'{k}': '{v}'" for k, v in identity.STATES.items()) + "}}"
_COUNTRY = ", ".join(f"'{c}'" for c in identity.COUNTRY_WORDS)
_PARTS = "list_transform(list_filter(list_transform(string_split_regex({0}, '[;,]'), lambda p: " + _N.format("p") + f"), lambda p: p <> '' and p not in ({_COUNTRY})), lambda p: coalesce(({_STATES})[p], p))"
_SQ = "trim(regexp_replace({0}, '[\\s\\p{{Z}}\\x{{FEFF}}]+', ' ', 'g'))"
_JOBS = f"(select *, coalesce(cycle, '') cycle0, {_SIG.format('normalized_title')} signature, case when {_SIG.format('normalized_title')} <> '' then normalized_company || '|' || coalesce(cycle, '') || '|' || {_SIG.format('normalized_title')} end requisition from classified_jobs)"


# --- functions ---------------------------------------------------------------------------------------------------------------------------------------
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings").select("posting_id", text.normalize_text(F.col("title")).alias("title_key"), identity.company_key(F.col("company")).alias("company_key"))


def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings").select("posting_id", url.canonicalize_url(F.col("direct_apply_url")).alias("canonical"), url.canonicalize_url(F.col("source_url")).alias("canonical_source"))


_KEYS = ", ".join(f"'{k}'" for k in url.TRACKING_KEYS)
_DEC, _ENC = "url_decode(replace({0}, '+', ' '))", "replace(replace(replace(url_encode({0}), '%20', '+'), '~', '%7E'), '%2A', '*')"
_K, _V = _DEC.format("split_part(p, '=', 1)"), _DEC.format("case when contains(p, '=') then substr(p, instr(p, '=') + 1) else '' end")
_URL = (
    "case when regexp_full_match(trim({0}), '(?i)https?:/+[^/?#\\s]+[^\\s]*') then lower(regexp_extract(trim({0}), '^([A-Za-z]+):', 1)) || '://' || regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z]+:/+([^/?#]+)', 1)), '^www\\.', '')"
    " || case when regexp_replace(regexp_replace(regexp_extract(trim({0}), '^[A-Za-z]+:/+[^/?#]+([^?#]*)', 1), '/{{2,}}', '/', 'g'), '/$', '') = '' then '/' else regexp_replace(regexp_replace(regexp_extract(trim({0}), '^[A-Za-z]+:/+[^/?#]+([^?#]*)', 1), '/{{2,}}', '/', 'g'), '/$', '') end"
    " || coalesce('?' || nullif(array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(trim({0}), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and lower(" + _K + ") not in (" + _KEYS + ") and not starts_with(lower(" + _K + "), 'utm_')),"
    " lambda p, i: {{'key': " + _K + ", 'k': i, 'p': " + _ENC.format(_K) + " || '=' || " + _ENC.format(_V) + "}})), lambda x: x.p), '&'), ''), '') else trim({0}) end"
)


def link_facts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("direct_apply_url")
    board = url.board_from_url(u)
    return table(spark, d, "raw_postings").select("posting_id", url.apply_link_rank(u).alias("link_rank"), url.source_job_id(u).alias("link_id"), board["board"].alias("board"), F.size(sinks.apply_links(u, F.col("source_url"))).alias("n_links"), F.array_join(F.transform(sinks.apply_links(u, F.col("source_url")), lambda x: F.concat_ws(" ", x["label"], x["url"])), "\n").alias("links"))


_LINK_ID = "coalesce(" + ", ".join(f"nullif(regexp_extract(direct_apply_url, '{p}', 1), '')" for p in url.ID_PATTERNS) + ")"
_RANK = f"case when direct_apply_url is null or not starts_with(direct_apply_url, 'http') then 0 when regexp_matches(direct_apply_url, '{url.LISTING_HOSTS}') then 1 when regexp_matches(direct_apply_url, '{url.FORM_HOSTS}') then 3 else 2 end"
_BOARD = "coalesce(" + ", ".join(f"nullif(nullif(lower(regexp_extract(direct_apply_url, '{p}', 1)), ''), 'embed')" for p, _ in url.BOARDS) + ")"


def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_postings")
    t, loc, link = text.normalize_text(F.col("title")), F.col("location"), url.canonicalize_url(F.coalesce("direct_apply_url", "source_url"))
    return r.select("posting_id", identity.canonical_location(loc).alias("place"), identity.location_bucket(loc, text.normalize_text(loc)).alias("bucket"), identity.title_signature(t).alias("signature"), identity.material_fingerprint(F.col("title"), loc, F.coalesce("cycle_hint", F.lit(""))).alias("fingerprint"), identity.canonical_key(F.col("source_name"), F.col("source_job_id"), link, identity.company_key(F.col("company")), t, text.normalize_text(loc), F.col("cycle_hint")).alias("canonical_key"))



IDENTITY_SQL = f"""
with r as (select *, {_N.format('title')} t, {_N.format('location')} l, {_PARTS.format('location')} parts, {_URL.format('coalesce(direct_apply_url, source_url)')} u, {_N.format("regexp_replace(company, '" + identity.LEGAL_SUFFIX + "', '')")} c from raw_postings),
s as (select *, {_SIG.format('t')} sig, case when len(parts) > 0 then array_to_string(parts, ' ') else l end place, trim(regexp_replace(coalesce(source_job_id, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) sid from r)
select posting_id, place, case when regexp_matches(location, '{identity.SEVERAL_PLACES}') or len(parts) >= 3 then '*' when len(parts) > 0 then array_to_string(parts, ' ') else l end bucket, sig signature,
  case when title is null and sig is null then sha256(concat_ws('|', place, coalesce(cycle_hint, ''))) else sha256(concat_ws('|', coalesce(nullif(sig, ''), t), place, coalesce(cycle_hint, ''))) end fingerprint,
  sha256(case when sid <> '' then 'id:' || {_N.format('source_name')} || ':' || sid when starts_with(u, 'http') then 'url:' || u else 'tuple:' || concat_ws('|', coalesce(c, ''), coalesce(t, ''), coalesce(l, ''), coalesce(cycle_hint, '')) end) canonical_key from s
"""


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings").select("posting_id", text.short_summary(F.col("description")).alias("summary"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    t = text.extract_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("hash"), F.sha2(text.escape_html(F.col("text")), 256).alias("escaped_hash"))


_ENT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)&(?:nbsp|#160|#x00a0);', ' ', 'g'), '(?i)&(?:lt|#60|#x3c);', '<', 'g'), '(?i)&(?:gt|#62|#x3e);', '>', 'g'), '(?i)&(?:quot|#34|#x22);', '\"', 'g'), '(?i)&(?:apos|#39|#x27);', '''', 'g'), '(?i)&(?:amp|#38|#x26);', '&', 'g')"
_SUM = _SQ.format("regexp_replace(" + _ENT.format(_ENT.format("coalesce(description, '')")) + ", '<[^>]*>', ' ', 'g')")
_HTML = "text"
for _p, _t in (("(?is)<script\\b[^>]*>.*?</script>", " "), ("(?is)<style\\b[^>]*>.*?</style>", " "), ("(?is)<noscript\\b[^>]*>.*?</noscript>", " "), ("<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&#x27;|&apos;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_t}', 'g')"


def skills_and_cycle(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_postings").withColumn("text", F.concat_ws(" ", "title", "description"))
    cycle = F.coalesce(rules.season_cycle(F.col("title")), F.col("cycle_hint"))
    points = [(cycle.isNotNull(), 20), (F.col("direct_apply_url").isNotNull(), 10)]
    return r.select("posting_id", F.array_join(rules.all_matches(rules.SKILLS), ",").alias("skills"), cycle.alias("cycle"), rules.score(points, F.least(F.lit(15), 3 * F.size(rules.all_matches(rules.SKILLS)))).alias("points"))


_SK = "list_filter([" + ", ".join(f"case when regexp_matches(t, '(?i)(^|[^a-z0-9]){r.value.lower()}($|[^a-z0-9])') then '{r.value}' end" for r in rules.SKILLS) + "], lambda x: x is not null)"
_CY = "case " + " ".join(
    f"when regexp_matches(title, '(?i)(^|[^a-z]){s}( quarter| term| semester)?[\\s,]+''?(20)?[0-9][0-9]($|[^0-9])') then '{s.capitalize()} 20' || regexp_extract(title, '(?i)(?:^|[^a-z]){s}(?: quarter| term| semester)?[\\s,]+''?(?:20)?([0-9][0-9])(?:$|[^0-9])', 1)"
    f" when regexp_matches(title, '(?i)(^|[^0-9])(20)?[0-9][0-9]\\s+{s}($|[^a-z])') then '{s.capitalize()} 20' || regexp_extract(title, '(?i)(?:^|[^0-9])(?:20)?([0-9][0-9])\\s+{s}(?:$|[^a-z])', 1)" for s in rules.SEASONS) + " end"


def printed_dates(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "raw_postings"), _now()
    posted = F.col("posted_at")
    return r.select("posting_id", dates.parse_posted_at(posted, n).cast("timestamp_ntz").alias("relative"), dates.parse_listed_date(posted).cast("timestamp_ntz").alias("listed"), dates.parse_prose_day(posted, n).cast("timestamp_ntz").alias("prose"), dates.posted_day_key(F.when(posted.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), posted), F.lit(None)).alias("day_key"))


DATES_SQL = f"""
select posting_id, case when regexp_full_match(lower(trim(posted_at)), '[0-9]+\\s*(d|mo|y)') then timestamptz '{NOW}+00' - to_days(regexp_extract(posted_at, '([0-9]+)', 1)::int * case when regexp_matches(lower(posted_at), 'd') then 1 when regexp_matches(lower(posted_at), 'mo') then 30 else 365 end) end::timestamp relative,
  try_strptime(case when regexp_full_match(trim(posted_at), '(?i)[a-z]+\\s+[0-9]{{1,2}},\\s*[0-9]{{4}}') then trim(posted_at) end, '%B %d, %Y') listed,
  case when regexp_full_match(lower(trim(posted_at)), '(posted\\s+)?[0-9]+[+]?\\s+days?\\s+ago') then timestamp '2026-11-19' - to_days(regexp_extract(posted_at, '([0-9]+)', 1)::int) when regexp_full_match(lower(trim(posted_at)), '(posted\\s+)?today') then timestamp '2026-11-19' when regexp_full_match(lower(trim(posted_at)), '(posted\\s+)?yesterday') then timestamp '2026-11-18' end prose,
  coalesce(case when regexp_full_match(posted_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}Z') then strftime(case when regexp_matches(posted_at, 'T00:00:00Z$') then posted_at::timestamptz at time zone 'UTC' else posted_at::timestamptz at time zone 'America/Los_Angeles' end, '%Y%m%d')::int end, 0) day_key from raw_postings
"""


# --- joins -------------------------------------------------------------------------------------------------------------------------------------------
def company_alias(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "company_aliases").select(F.col("alias_normalized").alias("alias"), F.col("canonical_company").alias("canonical"))
    r = table(spark, d, "raw_postings").select("posting_id", "source_name", identity.company_key(F.col("company")).alias("key")).where("key is not null")
    resolved = joins.resolve_alias(r, "key", joins.alias_table(a), "display")
    return joins.lookup(resolved, "source_name", table(spark, d, "source_profiles"), "source_name", "trust_rank", 0, "priority").select("posting_id", "key", "display", "priority")


_CK = _N.format("regexp_replace(company, '" + identity.LEGAL_SUFFIX + "', '')")


def overrides(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "applied_exclusions").select(F.col("notion_page_id").alias("ordinal"), F.col("company_normalized").alias("company"), "source_job_id", "canonical_url", F.col("title_normalized").alias("verdict"))
    return joins.first_override(table(spark, d, "classified_jobs"), "job_id", "normalized_company", "source_job_id", "canonical_url", e).select("job_id", "override")


def excluded(spark: SparkSession, d: str) -> DataFrame:
    return joins.excluded_ids(table(spark, d, "classified_jobs"), "job_id", "normalized_company", "normalized_title", "canonical_url", "source_job_id", table(spark, d, "applied_exclusions"))


def not_excluded(spark: SparkSession, d: str) -> DataFrame:
    return joins.drop_excluded(table(spark, d, "classified_jobs"), "job_id", "normalized_company", "normalized_title", "canonical_url", "source_job_id", table(spark, d, "applied_exclusions")).select("job_id")


_W = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) > 2 and not regexp_full_match(w, '" + identity.FILLER.strip("^$") + "')))"
_ALIKE = f"(c.normalized_title = e.title_normalized or (least(len({_W.format('c.normalized_title')}), len({_W.format('e.title_normalized')})) > 0 and len(list_intersect({_W.format('c.normalized_title')}, {_W.format('e.title_normalized')})) >= 0.8 * least(len({_W.format('c.normalized_title')}), len({_W.format('e.title_normalized')})) and len(list_intersect({_W.format('c.normalized_title')}, {_W.format('e.title_normalized')})) >= 0.6 * greatest(len({_W.format('c.normalized_title')}), len({_W.format('e.title_normalized')}))))"
_EXCLUDED = f"""select distinct job_id from (select c.job_id from classified_jobs c join applied_exclusions e on c.source_job_id = e.source_job_id where c.source_job_id <> ''
  union all select c.job_id from classified_jobs c join applied_exclusions e on c.canonical_url = e.canonical_url where starts_with(c.canonical_url, 'http')
  union all select c.job_id from classified_jobs c join applied_exclusions e on c.normalized_company = e.company_normalized where {_ALIKE})"""


def unsent(spark: SparkSession, d: str) -> DataFrame:
    j = _jobs(spark, d)
    sent = j.where("batch_no <= 20").select(F.col("requisition").alias("signature"))
    return joins.drop_sent(j.where("batch_no > 20"), F.col("requisition"), sent).select("job_id", "requisition")


def stored_match(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "classified_jobs").select(F.col("job_id").alias("id"), "batch_no", "canonical_key", "canonical_url", F.col("normalized_company").alias("company"), F.col("normalized_title").alias("title"), F.col("normalized_location").alias("location"), "cycle", "source_job_id", F.col("accepted_at").alias("first_seen_at"))
    old = j.where("batch_no <= 20")
    links = old.select(F.col("id").alias("stored_id"), F.col("canonical_url").alias("url"), "source_job_id")
    return joins.match_stored(j.where("batch_no > 20"), old, links)


STORED_SQL = """
with j as (select job_id id, batch_no, canonical_key, canonical_url, normalized_company company, normalized_title title, normalized_location "location", cycle, source_job_id, accepted_at from classified_jobs), o as (select * from j where batch_no <= 20), n as (select * from j where batch_no > 20),
m as (select n.id, o.id s, o.accepted_at a from n join o using (canonical_key) union all select n.id, o.id, o.accepted_at from n join o on n.canonical_url = o.canonical_url where starts_with(n.canonical_url, 'http')
  union all select n.id, o.id, o.accepted_at from n join o on n.company = o.company and n.title = o.title and n."location" = o."location" and n.cycle = o.cycle union all select n.id, o.id, o.accepted_at from n join o on n.company = o.company and n.source_job_id = o.source_job_id)
select id, arg_min(s, (a, s)) stored_id from m group by 1
"""


def latest_source_row(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_postings").where("trim(source_job_id) <> ''").withColumn("source_job_id", F.trim("source_job_id"))
    return joins.latest_per_key(r, ["source_name", "source_job_id"], ["ingested_at", "posting_id"], ["posting_id", "title", "ingested_at"])


def listing_links(spark: SparkSession, d: str) -> DataFrame:
    """Requisitions without a link, resolved to the first posting of an employer of that name and a title of the same role."""
    r = table(spark, d, "employer_requisitions").where("apply_link is null").select(F.col("req_id").alias("listing_id"), F.col("employer").alias("name"), F.col("role_title").alias("title"))
    p = table(spark, d, "raw_postings").select("posting_id", F.col("company").alias("name"), "title", F.col("posting_id").alias("ordinal"))
    return joins.first_listing_match(r, p)


LISTING_SQL = f"""
with l as (select req_id, {_N.format('employer')} n, {_W.format(_N.format('role_title'))} w, regexp_matches(role_title, '{identity.EARLY}') e from employer_requisitions where apply_link is null and employer is not null and role_title is not null),
p as (select posting_id, {_N.format('company')} n, {_W.format(_N.format('title'))} w, regexp_matches(title, '{identity.EARLY}') e from raw_postings where company is not null and title is not null),
m as (select a.n a, b.n b from (select distinct n from l) a, (select distinct n from p) b where a.n <> '' and b.n <> '' and (a.n = b.n or (length(a.n) > 2 and length(b.n) > 2 and (contains(a.n, b.n) or contains(b.n, a.n))))),
r as (select n, w, e, min(posting_id) posting_id from p group by 1, 2, 3)
select l.req_id listing_id, min(r.posting_id) posting_id from l join m on l.n = m.a join r on r.n = m.b and r.e = l.e where least(len(l.w), len(r.w)) > 0 and len(list_intersect(l.w, r.w)) >= 0.7 * least(len(l.w), len(r.w)) group by 1
"""

# --- duplicates, groups, caps ------------------------------------------------------------------------------------------------------------------------
def local_dedupe(spark: SparkSession, d: str) -> DataFrame:
    j = _jobs(spark, d)
    bucket = identity.location_bucket(F.coalesce("normalized_location", F.lit("")), F.coalesce("normalized_location", F.lit("")))
    keys = dedupe.alternative_keys(F.col("canonical_url"), F.col("normalized_company"), F.col("source_job_id"), F.col("normalized_title"), F.coalesce("normalized_location", F.lit("")), F.col("cycle0"), bucket, F.col("signature"), F.col("canonical_key"))
    ranked = j.withColumn("keys", keys).withColumn("r1", -url.apply_link_rank(F.col("canonical_url"))).withColumn("r2", -F.coalesce("score", F.lit(0)))
    return dedupe.greedy_dedupe(ranked, "job_id", "keys", [F.col("r1"), F.col("r2")]).select("job_id")


DEDUPE_SQL = f"""
with recursive j as (select *, coalesce(normalized_location, '') l, {_PARTS.format("coalesce(normalized_location, '')")} parts from {_JOBS}),
a as (select job_id, -({_RANK.replace('direct_apply_url', 'canonical_url')}) r, -coalesce(score, 0) sc, list_distinct(list_filter(['key:' || canonical_key, case when starts_with(canonical_url, 'http') then 'url:' || canonical_url end,
  case when trim(source_job_id) <> '' then concat_ws('|', 'req:' || normalized_company, trim(source_job_id)) end, concat_ws('|', 'tuple:' || normalized_company, normalized_title, l, cycle0),
  case when signature <> '' then concat_ws('|', 'sig:' || normalized_company, cycle0, case when regexp_matches(l, '{identity.SEVERAL_PLACES}') or len(parts) >= 3 then '*' when len(parts) > 0 then array_to_string(parts, ' ') else l end, signature) end], lambda x: x is not null)) ks from j),
u as (select job_id, unnest(ks) k from a), d as (select k from u group by 1 having count(*) > 1), v as (select job_id, list(k) ks from u join d using (k) group by 1), k as (select a.job_id, row_number() over (order by r, sc, a.job_id) n, v.ks from a join v using (job_id)),
-- a row is kept if none of its keys is a kept row's; the scan goes row by row and carries the keys of kept rows
s as (select 0::bigint n, []::varchar[] taken, null::bigint job_id union all
  select k.n, case when list_has_any(s.taken, k.ks) then s.taken else list_concat(s.taken, k.ks) end, case when list_has_any(s.taken, k.ks) then null else k.job_id end from s join k on k.n = s.n + 1)
select job_id from s where job_id is not null union all select job_id from a where job_id not in (select job_id from v)
"""


def collapse_requisitions(spark: SparkSession, d: str) -> DataFrame:
    j = _jobs(spark, d).withColumn("place", F.coalesce("normalized_location", F.lit("")))
    g = dedupe.collapse(j, F.col("requisition"), "job_id", [-F.coalesce("score", F.lit(0))], "place", ["job_id", "company", "title", "score", "normalized_company"])
    return g.select("requisition", "job_id", "merged_location", "n_members")


COLLAPSE_SQL = f"""
with g as (select coalesce(requisition, 'alone:' || job_id) requisition, job_id, coalesce(score, 0) s, coalesce(normalized_location, '') place from {_JOBS}),
p as (select requisition, place, min((-s, job_id)) o from g where place <> '' group by 1, 2), l as (select requisition, list(place order by o) ps from p group by 1)
select requisition, first(job_id order by s desc, job_id) job_id, coalesce(any_value(case when len(ps) <= 3 then array_to_string(ps, ' · ') else array_to_string(ps[1:3], ' · ') || ' +' || (len(ps) - 3) || ' more' end), '') merged_location, count(*)::int n_members
from g left join l using (requisition) group by 1
"""

def _fair() -> list[Order]:
    return [Order(F.coalesce("score", F.lit(0)), True), Order(F.col("job_id"))]


def fair_top(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.fair_top(table(spark, d, "classified_jobs"), "normalized_company", _fair(), 100).select("job_id", "normalized_company", "deal_no")


FAIR_SQL = """
with r as (select job_id, normalized_company, coalesce(score, 0) s, row_number() over w rnd, first(coalesce(score, 0)) over w ts, first(job_id) over w tj from classified_jobs window w as (partition by normalized_company order by coalesce(score, 0) desc, job_id))
select job_id, normalized_company, row_number() over (order by rnd, ts desc, tj, normalized_company)::int deal_no from r order by rnd, ts desc, tj limit 100
"""


def capped_batch(spark: SparkSession, d: str) -> DataFrame:
    """All members of the requisitions that a fair cap of 100 keeps."""
    j = _jobs(spark, d).withColumn("place", F.coalesce("normalized_location", F.lit("")))
    order = [-F.coalesce("score", F.lit(0))]
    g = dedupe.collapse(j, F.col("requisition"), "job_id", order, "place", ["job_id", "score", "normalized_company"])
    kept = dedupe.cap_groups(g, "requisition", "normalized_company", _fair(), 100)
    return dedupe.members(j, F.col("requisition"), "job_id", order, kept).select(F.col("id").alias("job_id"), "member_no", (F.col("member_no") == 0).alias("displayed"))


CAPPED_SQL = f"""
with g as (select coalesce(requisition, 'alone:' || job_id) q, job_id, normalized_company c, coalesce(score, 0) s from {_JOBS}), m as (select *, row_number() over (partition by q order by s desc, job_id) k from g), b as (select * from m where k = 1),
r as (select q, row_number() over w rnd, first(s) over w ts, first(job_id) over w tj, c from b window w as (partition by c order by s desc, job_id)), t as (select q from r order by rnd, ts desc, tj, c limit 100)
select job_id, (k - 1)::int member_no, k = 1 displayed from m where q in (select q from t)
"""


def digest_sections(spark: SparkSession, d: str) -> DataFrame:
    """Roles per section of the digest: the sections are the kinds of source in order of trust."""
    j = table(spark, d, "classified_jobs").join(table(spark, d, "source_profiles").select("source_name", "kind"), "source_name", "left")
    return sinks.sections(j, F.col("kind"), ["board", "aggregator", "list", "mirror"]).groupBy("section_no", "section").agg(F.count("*").alias("n"), F.countDistinct("normalized_company").alias("n_companies"))


def batch_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of the digest that a fair cap of 100 makes."""
    top = dedupe.fair_top(table(spark, d, "classified_jobs"), "normalized_company", _fair(), 100)
    b = top.agg(F.collect_list(F.col("job_id").cast("string")).alias("ids"), F.max("accepted_at").alias("at"))
    return b.select(identity.batch_key(F.col("ids"), F.col("at")).alias("batch_key"), F.size("ids").alias("n_jobs"))


# --- state -------------------------------------------------------------------------------------------------------------------------------------------
def _state_of(spark: SparkSession, d: str, no: int) -> DataFrame:
    s = table(spark, d, "job_snapshots").where(F.col("snapshot_no") == no).where("trim(source_job_id) <> ''")
    key = F.concat_ws(":", F.lower(F.trim("source_name")), F.trim("source_job_id"))
    rows = s.groupBy(key.alias("id")).agg(F.max_by(F.struct("title", "company", "location", "direct_apply_url", "status", "material_version", "sent_at", "delivered_at"), F.struct("delivered_at", "material_version", F.coalesce("title", F.lit("")), F.coalesce("status", F.lit("")))).alias("r"))
    status = F.upper(F.coalesce(F.nullif(F.trim("r.status"), F.lit("")), F.lit("OPEN")))
    return rows.select("id", F.col("id").alias("canonical_key"), F.col("r.direct_apply_url").alias("canonical_url"), F.col("r.company").alias("company"), F.col("r.title").alias("title"), F.col("r.location").alias("location"), F.lit(None).cast("string").alias("cycle"), F.col("id").alias("source_job_id"), F.lit(None).cast("string").alias("description"), status.alias("status"), F.sha2(F.concat_ws("|", "r.title", "r.location"), 256).alias("material_fingerprint"), F.coalesce("r.material_version", F.lit(1)).alias("material_version"), F.col("r.delivered_at").alias("first_seen_at"), F.col("r.delivered_at").alias("last_seen_at"), F.when(status == "CLOSED", F.col("r.delivered_at")).alias("closed_at"), F.lit(None).cast("timestamp").alias("reopened_at"), F.col("r.sent_at").alias("sent_at"))


def merged_state(spark: SparkSession, d: str) -> DataFrame:
    old, new = _state_of(spark, d, 3), _state_of(spark, d, 7)
    incoming = new.join(old.select("id", F.col("id").alias("stored_id")), "id", "left")
    m = state.merge_state(old, incoming, _now())
    return m.select("id", "company", "title", "location", "cycle", "status", "material_version", "first_seen_at", "last_seen_at", "closed_at", "reopened_at", "sent_at")


_ST = "(select lower(trim(source_name)) || ':' || trim(source_job_id) id, arg_max({{'title': title, 'company': company, 'location': \"location\", 'status': upper(coalesce(nullif(trim(status), ''), 'OPEN')), 'v': coalesce(material_version, 1), 'sent': sent_at, 'at': delivered_at}}, (delivered_at, material_version, coalesce(title, ''), coalesce(status, ''))) r from job_snapshots where snapshot_no = {0} and trim(source_job_id) <> '' group by 1)"
MERGE_SQL = f"""
with o as {_ST.format(3)}, n as {_ST.format(7)}, j as (select coalesce(o.id, n.id) id, o.r o, n.r n, sha256(concat_ws('|', o.r.title, o.r."location")) fo, sha256(concat_ws('|', n.r.title, n.r."location")) fn from o full join n on o.id = n.id),
k as (select *, coalesce(n.status = 'OPEN' and o.status = 'CLOSED' and o.at < timestamptz '{NOW}+00' - interval 30 day, false) repost from j)
select id, coalesce(n.company, o.company) company, coalesce(n.title, o.title) title, coalesce(n."location", o."location") "location", null::varchar "cycle", coalesce(n.status, o.status) status, case when o is null then 1 else o.v + (n is not null and (repost or fo <> fn))::int end material_version, coalesce(o.at, timestamptz '{NOW}+00') first_seen_at, case when n is not null then timestamptz '{NOW}+00' else o.at end last_seen_at,
  case when n.status = 'OPEN' then null when n.status = 'CLOSED' then coalesce(case when o.status = 'CLOSED' then o.at end, timestamptz '{NOW}+00') else case when o.status = 'CLOSED' then o.at end end closed_at, case when n.status = 'OPEN' and o.status = 'CLOSED' then timestamptz '{NOW}+00' end reopened_at, case when repost then null else o.sent end sent_at from k
"""


def stale_closed(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-10-01 00:00:00").cast("timestamp")
    j = table(spark, d, "classified_jobs").select(F.col("job_id").alias("id"), "posting_id", F.lit("OPEN").alias("status"), F.col("accepted_at").alias("last_seen_at"), F.lit(None).cast("timestamp").alias("closed_at"))
    seen = j.select(F.col("id").alias("job_id"), "posting_id").join(table(spark, d, "raw_postings").select("posting_id", F.col("ingested_at").alias("scraped_at")), "posting_id")
    return state.close_stale(j, seen, now).groupBy("status").agg(F.count("*").alias("n"), F.max("closed_at").alias("closed_at"))


def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_postings").select(F.col("posting_id").alias("job_id"), "source_name", F.nullif(F.trim("source_job_id"), F.lit("")).alias("source_job_id"), "source_url", F.col("ingested_at").alias("updated_at"))
    half = F.pmod(F.col("job_id"), F.lit(2)) == 0
    return state.merge_sources(r.where(half), r.where(~half)).select("job_id", "source_url", "source_name", "source_job_id")


SOURCES_SQL = """
with r as (select posting_id job_id, source_name, nullif(trim(source_job_id), '') source_job_id, source_url, ingested_at u, posting_id % 2 n from raw_postings),
a as (select * exclude rn from (select *, row_number() over (partition by source_name, source_job_id order by u desc, n desc, job_id desc) rn from r where source_job_id is not null) where rn = 1 union all select * from r where source_job_id is null)
select job_id, source_url, source_name, source_job_id from (select *, row_number() over (partition by job_id, source_url order by u desc, source_name desc, coalesce(source_job_id, '') desc) rn from a) where rn = 1
"""


def due_sources(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "source_runs")
    marks = state.advance_watermarks(spark.createDataFrame([], "source_name string, watermark string, updated_at timestamp"), runs, table(spark, d, "raw_postings").select("source_name", F.col("ingested_at").alias("posted_at")))
    s = table(spark, d, "source_profiles").select("source_name", (F.col("trust_rank") * 30).alias("cadence_hours"))
    return state.due_sources(s, marks, F.lit("2026-11-10 00:00:00").cast("timestamp"))


def source_health(spark: SparkSession, d: str) -> DataFrame:
    """Per source: accepted and rejected rows, and whether its recent successful runs fetched nothing."""
    runs = table(spark, d, "source_runs")
    quiet = metrics.silent_sources(runs, F.lit("2026-10-26 00:00:00").cast("timestamp"), 500)
    counts = metrics.source_counts(table(spark, d, "raw_postings"), F.coalesce(F.upper(F.trim("status")), F.lit("OPEN")) != "CLOSED")
    return counts.join(quiet, "source_name", "left").select("source_name", "accepted", "rejected", F.coalesce("n_runs", F.lit(0)).alias("silent_runs"))


def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_postings").withColumn("reason", F.when(F.upper(F.trim("status")) == "CLOSED", "closed").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_title").when(F.coalesce(F.trim("company"), F.lit("")) == "", "no_company").when(F.col("direct_apply_url").isNull(), "no_link"))
    return metrics.histogram(r, "reason")


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_postings").withColumn("reason", F.when(F.upper(F.trim("status")) == "CLOSED", "closed"))
    kept = table(spark, d, "classified_jobs").select("posting_id", F.lit(True).alias("kept")).distinct()
    return metrics.totals(r.join(kept, "posting_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False))), "reason", "kept")


def company_coverage(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "employer_requisitions").select(identity.company_key(F.col("employer")).alias("key"))
    return metrics.coverage(table(spark, d, "raw_postings").select(identity.company_key(F.col("company")).alias("key")), wanted, "key")


def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recent_runs(table(spark, d, "source_runs")).select("run_id", "source_name", "status")


def rotating_cohort(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "source_profiles").select("source_name", (12 - F.least(F.col("trust_rank"), F.lit(11))).alias("priority"))
    return metrics.rotate(p, "source_name", "priority", 5, 6, 5).select("source_name", "cohort_no")


def page_changes(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose text changed between the first and the last half of the fetches of a company's pages (the newest page of each)."""
    t = table(spark, d, "documents").where("company is not null").select(F.concat_ws("/", "source", "company").alias("url"), F.when(F.length("text") >= 500, F.sha2(text.extract_text(F.col("text")), 256)).otherwise("").alias("content_hash"), F.col("fetched_at").alias("checked_at"), "doc_id")
    cut = F.lit("2026-05-01 00:00:00").cast("timestamp")
    last = lambda df: joins.latest_per_key(df, ["url"], ["checked_at", "doc_id"], ["content_hash", "checked_at"])
    return state.page_changes(last(t.where(F.col("checked_at") < cut)), last(t.where(F.col("checked_at") >= cut)))[1]


PAGES_SQL = f"""
with t as (select concat_ws('/', source, company) url, case when length(text) >= 500 then sha256({_SQ.format(_HTML)}) else '' end h, fetched_at a, doc_id from documents where company is not null),
o as (select url, arg_max(h, (a, doc_id)) h from t where a < timestamptz '2026-05-01 00:00:00+00' group by 1), n as (select url, arg_max(h, (a, doc_id)) h from t where a >= timestamptz '2026-05-01 00:00:00+00' group by 1)
select url, o.h old_hash, n.h new_hash from o join n using (url) where o.h <> '' and n.h <> '' and o.h <> n.h
"""


def filled_forward(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_postings").select("posting_id", "source_name", F.nullif(F.trim("location"), F.lit("")).alias("place"))
    return forward_fill(r, "place", ["source_name"], ["posting_id"], "last_place").select("posting_id", "last_place")


def restored_sent(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as sent when the last row of their batch was accepted, if the batch is one of those that were sent (here every second one)."""
    j = table(spark, d, "classified_jobs")
    at = j.groupBy("batch_no").agg(F.max("accepted_at").alias("sent_at"))
    deliveries = j.select(F.col("job_id").alias("id"), "batch_no").join(at, "batch_no").select("id", F.when(F.col("batch_no") % 2 == 0, "SENT").otherwise("CLAIMED").alias("status"), "sent_at")
    return state.restore_sent(j.select(F.col("job_id").alias("id"), F.lit(None).cast("timestamp").alias("sent_at")), deliveries)


COHORT_SQL = """
with p as (select source_name, 12 - least(trust_rank, 11) pr from source_profiles), q as (select *, pr >= 5 h, row_number() over (partition by pr >= 5 order by source_name) - 1 a, count(*) over (partition by pr >= 5) n from p), f as (select least(3, max(n) filter (h)) f from q),
w as (select true h, (5 * f + k) % (select max(n) from q where h) a, k from f, range(3) t(k) where k < f union all select false, (5 * (6 - f) + k) % (select max(n) from q where not h), f + k from f, range(6) t(k) where k < 6 - f)
select source_name, k::int cohort_no from q join w using (h, a)
"""


QUERIES = {
    "normalize_text": normalize_text, "canonical_url": canonical_url, "link_facts": link_facts, "identity_keys": identity_keys, "summaries": summaries, "page_text": page_text, "skills_and_cycle": skills_and_cycle,
    "printed_dates": printed_dates, "company_alias": company_alias, "overrides": overrides, "excluded": excluded, "not_excluded": not_excluded, "unsent": unsent, "stored_match": stored_match,
    "latest_source_row": latest_source_row, "listing_links": listing_links, "local_dedupe": local_dedupe, "collapse_requisitions": collapse_requisitions, "fair_top": fair_top, "capped_batch": capped_batch,
    "digest_sections": digest_sections, "batch_keys": batch_keys, "merged_state": merged_state, "stale_closed": stale_closed, "merged_sources": merged_sources, "due_sources": due_sources,
    "source_health": source_health, "rejection_reasons": rejection_reasons, "run_totals": run_totals, "company_coverage": company_coverage, "recent_runs": recent_runs, "rotating_cohort": rotating_cohort,
    "page_changes": page_changes, "filled_forward": filled_forward, "restored_sent": restored_sent,
}

SQL = {
    "normalize_text": f"select posting_id, {_N.format('title')} title_key, {_CK} company_key from raw_postings",
    "canonical_url": f"select posting_id, {_URL.format('direct_apply_url')} canonical, {_URL.format('source_url')} canonical_source from raw_postings",
    "link_facts": f"select posting_id, concat_ws(chr(10), case when {_RANK.replace('direct_apply_url', 'coalesce(direct_apply_url, source_url)')} = 1 then 'View listing ' else 'Apply ' end || coalesce(direct_apply_url, source_url), case when source_url <> coalesce(direct_apply_url, source_url) then 'Listing ' || source_url end) links, {_RANK} link_rank, {_LINK_ID} link_id, {_BOARD} board, ((coalesce(direct_apply_url, source_url) is not null)::int + coalesce((source_url <> coalesce(direct_apply_url, source_url))::int, 0))::int n_links from raw_postings",
    "identity_keys": IDENTITY_SQL,
    "summaries": f"select posting_id, case when {_SUM} = '' then '{text.NO_SUMMARY}' else left({_SUM}, 280) end summary from raw_postings",
    "page_text": f"select doc_id, length({_SQ.format(_HTML)})::int n, sha256({_SQ.format(_HTML)}) hash, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) escaped_hash from documents",
    "skills_and_cycle": f"with r as (select *, concat_ws(' ', title, description) t from raw_postings), s as (select posting_id, {_SK} k, coalesce({_CY}, cycle_hint) cycle, direct_apply_url u from r) select posting_id, array_to_string(k, ',') skills, cycle, (least(15, 3 * len(k)) + case when cycle is not null then 20 else 0 end + case when u is not null then 10 else 0 end)::int points from s",
    "printed_dates": DATES_SQL,
    "company_alias": f"with a as (select alias_normalized, min(canonical_company) c from company_aliases group by 1), r as (select posting_id, source_name, {_CK} key from raw_postings where company is not null) select posting_id, key, coalesce(c, key) display, coalesce(trust_rank, 0) priority from r left join a on a.alias_normalized = r.key left join source_profiles using (source_name)",
    "overrides": "with m as (select c.job_id, e.notion_page_id o, e.title_normalized v from classified_jobs c join applied_exclusions e on c.normalized_company = e.company_normalized and (c.source_job_id = e.source_job_id or c.canonical_url = e.canonical_url)) select job_id, b override from classified_jobs left join (select job_id, arg_min(v, o) b from m group by 1) using (job_id)",
    "excluded": _EXCLUDED,
    "not_excluded": f"select job_id from classified_jobs where job_id not in ({_EXCLUDED})",
    "unsent": f"with j as {_JOBS} select job_id, requisition from j where batch_no > 20 and (requisition is null or requisition not in (select requisition from j where batch_no <= 20 and requisition is not null))",
    "stored_match": STORED_SQL,
    "latest_source_row": "select source_name, trim(source_job_id) source_job_id, arg_max(posting_id, (ingested_at, posting_id)) posting_id, arg_max({'t': title}, (ingested_at, posting_id)).t title, max(ingested_at) ingested_at from raw_postings where trim(source_job_id) <> '' group by 1, 2",
    "listing_links": LISTING_SQL, "local_dedupe": DEDUPE_SQL,
    "collapse_requisitions": COLLAPSE_SQL, "fair_top": FAIR_SQL, "capped_batch": CAPPED_SQL,
    "digest_sections": "select list_position(['board', 'aggregator', 'list', 'mirror'], kind)::bigint section_no, kind section, count(*) n, count(distinct normalized_company) n_companies from classified_jobs join source_profiles using (source_name) group by 1, 2",
    "batch_keys": f"with t as ({FAIR_SQL}), k as (select job_id::varchar i, accepted_at a from classified_jobs where job_id in (select job_id from t)) select strftime(max(a) at time zone 'UTC', '%Y-%m-%dT%H') || ':' || left(sha256(string_agg(i, '|' order by i)), 24) batch_key, count(*)::int n_jobs from k",
    "merged_state": MERGE_SQL,
    "stale_closed": "with s as (select c.job_id, accepted_at a, ingested_at i from classified_jobs c left join raw_postings using (posting_id)), t as (select a < timestamptz '2026-10-01 00:00:00+00' - interval 72 hour and not coalesce(i >= timestamptz '2026-10-01 00:00:00+00' - interval 72 hour, false) x from s) select case when x then 'CLOSED' else 'OPEN' end status, count(*) n, max(case when x then timestamptz '2026-10-01 00:00:00+00' end) closed_at from t group by 1",
    "merged_sources": SOURCES_SQL,
    "due_sources": "with m as (select source_name, max(finished_at) u from source_runs where status = 'SUCCESS' group by 1) select source_name, trust_rank * 30 cadence_hours from source_profiles left join m using (source_name) where u is null or epoch_us(timestamptz '2026-11-10 00:00:00+00') - epoch_us(u) >= trust_rank * 30 * 3600000000",
    "source_health": "with q as (select source_name, count(*) n from source_runs where status = 'SUCCESS' and started_at > timestamptz '2026-10-26 00:00:00+00' - interval 500 hour group by 1 having sum(fetched_count) = 0), c as (select source_name, count(*) filter (coalesce(upper(trim(status)), 'OPEN') <> 'CLOSED') accepted, count(*) filter (coalesce(upper(trim(status)), 'OPEN') = 'CLOSED') rejected from raw_postings group by 1) select source_name, accepted, rejected, coalesce(n, 0) silent_runs from c left join q using (source_name)",
    "rejection_reasons": "select reason, count(*) n from (select case when upper(trim(status)) = 'CLOSED' then 'closed' when coalesce(trim(title), '') = '' then 'no_title' when coalesce(trim(company), '') = '' then 'no_company' when direct_apply_url is null then 'no_link' end reason from raw_postings) where reason is not null group by 1",
    "run_totals": "with r as (select coalesce(upper(trim(status)) = 'CLOSED', false) x, posting_id in (select posting_id from classified_jobs) k from raw_postings) select count(*) raw, count(*) filter (not x) eligible, count(*) filter (x) rejected, count(*) filter (not x and not k) deduplicated from r",
    "company_coverage": f"with w as (select distinct {_CK.replace('company', 'employer').replace('employer|co)', 'company|co)')} k from employer_requisitions), s as (select distinct {_CK} k from raw_postings where company is not null) select count(*) wanted, count(s.k) found, round(100 * count(s.k) / count(*))::int percent from w left join s using (k)",
    "recent_runs": "select run_id, source_name, status from source_runs order by started_at desc, run_id desc limit 50",
    "rotating_cohort": COHORT_SQL, "page_changes": PAGES_SQL,
    "filled_forward": "select posting_id, last_value(nullif(trim(\"location\"), '') ignore nulls) over (partition by source_name order by posting_id rows between unbounded preceding and current row) last_place from raw_postings",
    "restored_sent": "with b as (select batch_no, max(accepted_at) s from classified_jobs group by 1) select job_id id, case when batch_no % 2 = 0 then s end sent_at from classified_jobs join b using (batch_no)",
}
