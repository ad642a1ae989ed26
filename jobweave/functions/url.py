"""Web addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.instants import bind
from jobweave.functions.text import trim_space

#: Query keys that track the reader and name nothing, besides all that begin with ``utm_``.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gh_src", "gh_jid", "source", "ref", "referrer", "trk", "trackingid",
    "lever-source", "lever-origin", "fbclid", "gclid", "mc_cid", "mc_eid",
]
#: Hosts of application forms, and of pages that only list.
FORM_HOSTS = r"(?i)greenhouse\.io|lever\.co|ashbyhq\.com|myworkdayjobs\.com|myworkdaysite\.com|smartrecruiters\.com|icims\.com|workable\.com|jobvite\.com|taleo\.net|oraclecloud\.com|successfactors|avature\.net|phenompeople|eightfold\.ai|applytojob\.com|breezy\.hr|recruitee\.com|paylocity|dayforcehcm|ultipro|myworkday"
LISTING_HOSTS = r"(?i)intern-list\.com|jobright\.ai|simplify\.jobs/c/|github\.com|githubusercontent\.com"
#: Where addresses carry the posting's id, tried in this order.
ID_PATTERNS = [
    r"(?i)greenhouse\.io/(?:[^/]+/)?jobs/(\d+)",
    r"(?i)lever\.co/[^/]+/([a-f0-9-]{20,})",
    r"(?i)ashbyhq\.com/[^/]+/([a-f0-9-]{16,})",
    r"(?i)smartrecruiters\.com/[^/]+/(\d+-[^/?]+)",
    r"(?i)(?:myworkdayjobs\.com|wd\d+\.myworkdaysite\.com)/[^?#]*_((?:R|JR)[-_]?\d+(?:-\d+)?)(?:[/?]|$)",
    r"(?i)linkedin\.com/jobs/view/(\d+)",
    r"(?i)[?&](?:jk|jobkey)=([a-z0-9]+)",
    r"(?i)monster\.[^/]+/job-openings/[^/]*-([a-f0-9-]{8,})",
    r"(?i)/(?:jobs?|requisitions?)/(\d{5,})(?:[/?]|$)",
]
#: Hosts of boards, with the system they run.
BOARDS = [(r"(?i)(?:job-)?boards\.greenhouse\.io/([a-z0-9_-]+)", "greenhouse"), (r"(?i)jobs\.lever\.co/([a-z0-9_-]+)", "lever"), (r"(?i)jobs\.ashbyhq\.com/([a-z0-9_-]+)", "ashby")]

_WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*):/+([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonicalize_url(url: Column) -> Column:
    """An address without fragment, tracking and ``www.``: scheme and host in lower case, slashes single and none at the end, the query decoded, sorted by key and encoded again as forms are.

    Repeated keys keep their order; text that is no http(s) address is returned trimmed; null stays null.
    """

    def build(u: Column) -> Column:
        scheme, host = F.lower(F.regexp_extract(u, _WHOLE, 1)), F.regexp_replace(F.lower(F.regexp_extract(u, _WHOLE, 2)), r"^www\.", "")
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
        path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, _WHOLE, 3), "/{2,}", "/"), "/$", "")
        pairs = F.filter(F.split(F.regexp_extract(u, _WHOLE, 4), "&"), lambda p: p != "")
        plain = lambda x: F.coalesce(F.try_url_decode(x), x)
        key = lambda p: plain(F.substring_index(p, "=", 1))
        kept = F.filter(pairs, lambda p: ~F.lower(key(p)).isin(TRACKING_KEYS) & ~F.lower(key(p)).startswith("utm_"))
        value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
        numbered = F.array_sort(F.transform(kept, lambda p, k: F.struct(key(p).alias("key"), k.alias("k"), F.concat(F.url_encode(key(p)), F.lit("="), F.url_encode(plain(value(p)))).alias("p"))))
        query = F.array_join(F.transform(numbered, lambda x: x["p"]), "&")
        return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))

    return bind(trim_space(url), lambda u: F.when(u.rlike(rf"(?i)^https?:/+[^/?#\s]+[^\s]*$"), build(u)).otherwise(u))


def apply_link_rank(url: Column) -> Column:
    """3: the employer's form, 2: another page, 1: a listing, 0: no address."""
    return F.when(url.isNull() | ~url.startswith("http"), 0).when(url.rlike(LISTING_HOSTS), 1).when(url.rlike(FORM_HOSTS), 3).otherwise(2)


def source_job_id(url: Column) -> Column:
    """The posting's id within an address, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in ID_PATTERNS])


def board_from_url(url: Column) -> Column:
    """struct(ats, board) of a board's address, or null; ``embed`` is no board."""
    out = F.lit(None).cast("struct<ats:string,board:string>")
    for pattern, ats in reversed(BOARDS):
        board = F.lower(F.regexp_extract(url, pattern, 1))
        out = F.when((board != "") & (board != "embed"), F.struct(F.lit(ats).alias("ats"), board.alias("board"))).otherwise(out)
    return out


def linkedin_guest_url(url: Column) -> Column:
    """The public fragment of a posting on the network, or null for other addresses."""
    ident = F.regexp_extract(url, r"(?i)linkedin\.com/jobs/view/(?:[^/?#]*-)?(\d+)", 1)
    return F.when(ident != "", F.concat(F.lit("https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/"), ident))


def workday_json_url(url: Column) -> Column:
    """The machine-readable twin of a posting's page, or null for other addresses."""
    p = r"(?i)^(https?://([a-z0-9-]+)\.(?:wd\d+\.)?myworkdayjobs\.com)/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+)/(job/[^?#]+)"
    part = lambda k: F.regexp_extract(url, p, k)
    return F.when(part(1) != "", F.concat(part(1), F.lit("/wday/cxs/"), part(2), F.lit("/"), part(3), F.lit("/"), part(4)))
