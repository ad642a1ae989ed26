"""Board payloads (JSON) as raw postings. A payload is a row: source_name, kind, company, host, site, payload, scraped_at, profile, max_rows.

Each kind is a schema, the test a record must pass, and a projection. A payload of a strict kind with any bad record fails as a whole, as does one that cannot be read: its
source has a FAILED run and no postings. Records of a lenient kind are dropped one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.dates import iso_or_null, parse_prose_day
from jobweave.schema import RAW_COLUMNS

#: A longer payload that gives no record is an error, not an empty board.
EMPTY_PARSE_BYTES = 2_000
#: Fixed value: titles for which descriptions are kept.
STUDENT_TITLE = r"(?i)(?<![A-Za-z0-9_])(?:intern|internship|interns|internships|co-?op|student|new grad|graduate|apprentice|trainee|campus|summer analyst)(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Board:
    """How to read a kind: the payload's type, where its records are, what a record must have, its columns, and whether one bad record fails the payload."""

    schema: str
    records: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    columns: Callable[[Column], dict[str, Column]]
    strict: bool = True


def _iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _now() -> Column:
    return F.col("scraped_at").try_cast("timestamp")


def _joined(*parts: Column, sep: str = ", ") -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep)


def _any(r: Column, *paths: str) -> Column:
    """The first of several paths into a record kept as JSON text."""
    return F.coalesce(*[F.nullif(F.get_json_object(r, f"$.{p}"), F.lit("")) for p in paths])


def _texts(*paths: str) -> Callable[[Column], Column]:
    return lambda r: reduce(lambda a, b: a & b, [F.coalesce(r[p] != "", F.lit(False)) for p in paths])


#: Keys under which unknown boards keep their records, tried in this order.
CONTAINERS = ["jobs", "jobPostings", "items", "results", "positions", "content"]


def _generic_records(payload: Column) -> Column:
    array = lambda t: F.from_json(t, "array<string>")
    own = [F.when(F.get_json_object(payload, f"$.{k}").startswith("["), array(F.get_json_object(payload, f"$.{k}"))) for k in CONTAINERS]
    return F.when(F.trim(payload).startswith("["), array(payload)).otherwise(F.coalesce(*own, F.array().cast("array<string>")))


def _site(*rest: Column | str) -> Column:
    """An address under the board's host."""
    return F.concat(F.regexp_replace("host", "/$", ""), *[F.lit(r) if isinstance(r, str) else r for r in rest])


BOARDS: dict[str, Board] = {
    "greenhouse": Board(
        "struct<jobs:array<struct<id:string,title:string,absolute_url:string,updated_at:string,first_published:string,location:struct<name:string>,content:string>>>",
        lambda p: p["jobs"], lambda r: _texts("id", "title", "absolute_url")(r) & r["location"]["name"].isNotNull(),
        lambda r: {"source_job_id": r["id"], "title": r["title"], "location": r["location"]["name"], "posted_at": F.coalesce(r["first_published"], r["updated_at"]), "description": F.when(r["title"].rlike(STUDENT_TITLE), r["content"]), "employment_type": F.lit("Internship"), "source_url": r["absolute_url"], "direct_apply_url": r["absolute_url"]},
    ),
    "lever": Board(
        "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,categories:struct<location:string,commitment:string>,descriptionPlain:string>>",
        lambda p: p, _texts("id", "text", "hostedUrl"),
        lambda r: {"source_job_id": r["id"], "title": r["text"], "location": r["categories"]["location"], "posted_at": F.when(r["createdAt"] != 0, _iso(F.timestamp_millis(r["createdAt"]))), "description": r["descriptionPlain"], "employment_type": r["categories"]["commitment"], "source_url": r["hostedUrl"], "direct_apply_url": F.coalesce(r["applyUrl"], r["hostedUrl"])},
    ),
    "ashby": Board(
        "struct<jobs:array<struct<id:string,title:string,location:string,publishedAt:string,jobUrl:string,applyUrl:string,descriptionPlain:string,employmentType:string>>>",
        lambda p: p["jobs"], _texts("title", "jobUrl"),
        lambda r: {"source_job_id": r["id"], "title": r["title"], "location": r["location"], "posted_at": r["publishedAt"], "description": r["descriptionPlain"], "employment_type": r["employmentType"], "source_url": r["jobUrl"], "direct_apply_url": F.coalesce(r["applyUrl"], r["jobUrl"])},
    ),
    "smartrecruiters": Board(
        "struct<content:array<struct<id:string,name:string,ref:string,releasedDate:string,location:struct<city:string,region:string,country:string>>>>",
        lambda p: p["content"], _texts("id", "name", "ref"),
        lambda r: {"source_job_id": r["id"], "title": r["name"], "location": F.coalesce(F.nullif(_joined(r["location"]["city"], r["location"]["region"], r["location"]["country"]), F.lit("")), F.lit("Unspecified")), "posted_at": r["releasedDate"], "source_url": r["ref"], "direct_apply_url": r["ref"]},
    ),
    "oracle": Board(
        "struct<items:array<struct<requisitionList:array<struct<Id:string,Title:string,PrimaryLocation:string,PostedDate:string,ShortDescriptionStr:string,ExternalQualificationsStr:string,ExternalResponsibilitiesStr:string,JobSchedule:string>>>>>",
        lambda p: F.try_element_at(p["items"], F.lit(1))["requisitionList"], _texts("Id", "Title"),
        lambda r: {"source_job_id": r["Id"], "title": r["Title"], "location": r["PrimaryLocation"], "posted_at": F.when(r["PostedDate"].isNotNull(), F.concat(r["PostedDate"], F.lit("T00:00:00.000Z"))), "description": F.nullif(_joined(r["ShortDescriptionStr"], r["ExternalResponsibilitiesStr"], r["ExternalQualificationsStr"], sep="\n"), F.lit("")), "employment_type": r["JobSchedule"], "source_url": _site("/hcmUI/CandidateExperience/en/sites/", F.col("site"), "/job/", r["Id"]), "direct_apply_url": _site("/hcmUI/CandidateExperience/en/sites/", F.col("site"), "/job/", r["Id"])},
    ),
    "workday": Board(
        "string", _generic_records, lambda r: F.coalesce(_any(r, "title") != "", F.lit(False)),
        lambda r: {"source_job_id": F.coalesce(_any(r, "bulletFields[0]", "id", "externalPath"), F.lit("")), "title": _any(r, "title"), "location": F.coalesce(_any(r, "locationsText"), F.lit("Unspecified")), "posted_at": _iso(parse_prose_day(_any(r, "postedOn"), _now())), "employment_type": _any(r, "timeType"), "source_url": _site("/en-US/", F.col("site"), F.coalesce(_any(r, "externalPath"), F.lit(""))), "direct_apply_url": _site("/en-US/", F.col("site"), F.coalesce(_any(r, "externalPath"), F.lit(""))), "raw": r},
        strict=False,
    ),
    "generic": Board(
        "string", _generic_records, lambda r: F.coalesce(_any(r, "title", "jobTitle", "name") != "", F.lit(False)),
        lambda r: {"source_job_id": F.coalesce(_any(r, "id", "jobId", "requisitionId", "externalPath"), F.lit("")), "title": _any(r, "title", "jobTitle", "name"), "location": F.coalesce(_any(r, "location", "locationsText", "primaryLocation"), F.lit("Unspecified")), "posted_at": F.coalesce(iso_or_null(_any(r, "postedAt", "datePosted")), _iso(parse_prose_day(_any(r, "postedOn"), _now()))), "description": _any(r, "description", "jobDescription"), "employment_type": _any(r, "employmentType", "timeType"), "source_url": F.coalesce(_any(r, "url", "externalUrl", "jobUrl"), F.col("host")), "direct_apply_url": _any(r, "applyUrl", "externalUrl", "jobUrl"), "raw": r},
        strict=False,
    ),
    "items": Board(
        "string", _generic_records,
        lambda r: F.coalesce((_any(r, "title", "jobTitle", "positionName", "jobPosting.title") != "") & (_any(r, "company.name", "company", "companyName", "jobPosting.hiringOrganization.name") != "") & (_any(r, "sourceUrl", "linkedinUrl", "jobUrl", "url", "link", "apply.applyUrl") != ""), F.lit(False)),
        lambda r: {"source_job_id": F.coalesce(_any(r, "id", "jobId", "job_id"), F.lit("")), "title": _any(r, "title", "jobTitle", "positionName", "jobPosting.title"), "company": _any(r, "company.name", "company", "companyName", "jobPosting.hiringOrganization.name"), "location": F.coalesce(_any(r, "location.name", "location"), F.nullif(F.array_join(F.filter(F.transform(F.from_json(F.get_json_object(r, "$.jobPosting.jobLocation"), "array<struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>>"), lambda a: _joined(a["address"]["addressLocality"], a["address"]["addressRegion"], a["address"]["addressCountry"])), lambda t: t != ""), " / "), F.lit(""))), "posted_at": _any(r, "postedAt", "postedDate", "datePosted", "jobPosting.datePosted"), "description": _any(r, "descriptionText", "description", "jobPosting.description"), "employment_type": _listed(_any(r, "employmentType", "jobPosting.employmentType")), "source_url": _any(r, "sourceUrl", "linkedinUrl", "jobUrl", "url", "link", "apply.applyUrl"), "direct_apply_url": _any(r, "directApplyUrl", "applicationUrl", "applyUrl", "apply.applyUrl"), "raw": r},
        strict=False,
    ),
}


def _listed(value: Column) -> Column:
    """A JSON list of texts joined by commas, or the text itself."""
    return F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), ", ")).otherwise(value)


def _parsed(payloads: DataFrame, kind: str) -> DataFrame:
    """Each payload with its records, whether it could be read, and its own ordinal."""
    b = BOARDS[kind]
    own = payloads.where(F.col("kind") == kind)
    tree = F.col("payload") if b.schema == "string" else F.from_json("payload", b.schema, {"mode": "PERMISSIVE"})
    out = own.withColumn("_tree", tree).withColumn("_records", b.records(F.col("_tree")))
    readable = F.when(F.lit(b.schema == "string"), F.trim("payload").rlike(r"^[\[{]")).otherwise(F.col("_records").isNotNull())
    bad = F.exists("_records", lambda r: ~b.valid(r)) if b.strict else F.lit(False)
    error = F.when(~F.coalesce(readable, F.lit(False)), "payload cannot be read").when(F.coalesce(bad, F.lit(False)), "a record lacks a required field")
    error = F.coalesce(error, F.when((F.coalesce(F.size("_records"), F.lit(0)) <= 0) & (F.length("payload") > EMPTY_PARSE_BYTES), "parsed 0 rows"))
    return out.withColumn("error_message", error).drop("_tree")


def _postings(parsed: DataFrame, kind: str) -> DataFrame:
    b = BOARDS[kind]
    rows = parsed.where("error_message is null").select("*", F.posexplode("_records").alias("_no", "_r")).where(b.valid(F.col("_r")))
    rows = rows.where(F.col("_no") < F.coalesce("max_rows", F.lit(2**31 - 1)))
    cols = b.columns(F.col("_r"))
    given = {"source_name": F.col("source_name"), "company": cols.get("company", F.col("company")), "scraped_at": F.col("scraped_at")}
    return rows.select(*[(given.get(c) if c in given else cols.get(c, F.lit(None))).cast("string").alias(c) for c in RAW_COLUMNS], F.col("_no").alias("ordinal"))


def read_boards(payloads: DataFrame, profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, runs) of the payloads, of those of ``profile`` and of both if one is named (absent means technical).

    ``runs``: source_name, status, fetched_count, error_message; a kind that is not known is SKIPPED. Nothing is raised for bad data.
    """
    if profile:
        payloads = payloads.where(F.coalesce("profile", F.lit("technical")).isin("both", profile))
    parsed = {k: _parsed(payloads, k) for k in BOARDS}
    postings = reduce(DataFrame.unionByName, [_postings(p, k) for k, p in parsed.items()])
    runs = [p.select("source_name", F.when(F.col("error_message").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), F.when(F.col("error_message").isNull(), F.greatest(F.size("_records"), F.lit(0))).otherwise(0).alias("fetched_count"), "error_message") for p in parsed.values()]
    other = payloads.where(~F.col("kind").isin(list(BOARDS))).select("source_name", F.lit("SKIPPED").alias("status"), F.lit(0).alias("fetched_count"), F.lit("kind is not known").alias("error_message"))
    return postings, reduce(DataFrame.unionByName, [*runs, other])
