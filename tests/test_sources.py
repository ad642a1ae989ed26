import json

import pytest
from pyspark.sql import functions as F

from jobweave.sources.boards import read_boards
from jobweave.sources.pages import join_details, page_hashes, parse_cards, parse_collection, parse_detail, parse_link_postings, parse_table_postings, parse_watchlist

PAYLOAD = "source_name string, kind string, company string, host string, site string, payload string, scraped_at string, profile string, max_rows int"
NOW = "2026-08-20T18:00:00Z"


def read(spark, kind, payload, **more):
    row = {"source_name": f"{kind}:x", "kind": kind, "company": "Acme", "host": "https://h.example/", "site": "S", "payload": payload if isinstance(payload, str) else json.dumps(payload), "scraped_at": NOW, "profile": None, "max_rows": None} | more
    postings, runs = read_boards(spark.createDataFrame([tuple(row.values())], PAYLOAD))
    return [r.asDict() for r in postings.orderBy("ordinal").collect()], runs.first()


def test_greenhouse(spark):
    jobs = [{"id": 7, "title": "Software Intern", "absolute_url": "https://g/1", "first_published": None, "updated_at": "2026-08-01", "location": {"name": "NY"}, "content": "body"}, {"id": "8", "title": "Senior Engineer", "absolute_url": "https://g/2", "location": {"name": "LA"}, "content": "body"}]
    rows, run = read(spark, "greenhouse", {"jobs": jobs})
    assert [(r["source_job_id"], r["posted_at"], r["description"], r["employment_type"]) for r in rows] == [("7", "2026-08-01", "body", "Internship"), ("8", None, None, "Internship")]
    assert (run.status, run.fetched_count) == ("SUCCESS", 2)
    rows, run = read(spark, "greenhouse", {"jobs": [*jobs, {"id": 9, "title": None, "absolute_url": "https://g/3", "location": {"name": "x"}}]})
    assert rows == [] and run.status == "FAILED"


@pytest.mark.parametrize("payload", ["", "<html>not json</html>", "{\"other\": 1}", None])
def test_unreadable_payload_is_a_failed_run(spark, payload):
    rows, run = read(spark, "greenhouse", payload or "")
    assert rows == [] and run.status == "FAILED"


def test_lever_ashby_smartrecruiters(spark):
    rows, _ = read(spark, "lever", [{"id": "a", "text": "T", "hostedUrl": "https://l/1", "createdAt": 1786000000000, "categories": {"commitment": "Intern"}}, {"id": "b", "text": "U", "hostedUrl": "https://l/2", "applyUrl": "https://l/2/apply", "createdAt": 0, "categories": {}}])
    assert [(r["posted_at"], r["direct_apply_url"]) for r in rows] == [("2026-08-06T07:06:40.000Z", "https://l/1"), (None, "https://l/2/apply")]
    rows, _ = read(spark, "ashby", {"jobs": [{"title": "T", "jobUrl": "https://a/1"}]})
    assert rows[0]["source_job_id"] is None and rows[0]["direct_apply_url"] == "https://a/1"
    rows, _ = read(spark, "smartrecruiters", {"content": [{"id": "1", "name": "T", "ref": "https://s/1", "location": {"city": "", "region": "CA", "country": "us"}}, {"id": "2", "name": "U", "ref": "https://s/2"}]})
    assert [r["location"] for r in rows] == ["CA, us", "Unspecified"]


def test_workday_oracle_generic_items(spark):
    rows, _ = read(spark, "workday", {"jobPostings": [{"title": "T", "externalPath": "/job/1", "locationsText": "NY", "postedOn": "Posted Yesterday", "bulletFields": ["R-1"]}, {"title": ""}]})
    assert [(r["source_job_id"], r["posted_at"], r["source_url"]) for r in rows] == [("R-1", "2026-08-19T00:00:00.000Z", "https://h.example/en-US/S/job/1")]
    rows, _ = read(spark, "oracle", {"items": [{"requisitionList": [{"Id": 5, "Title": "T", "PostedDate": "2026-08-01", "ShortDescriptionStr": "a", "ExternalQualificationsStr": "c"}]}]})
    assert (rows[0]["posted_at"], rows[0]["description"], rows[0]["direct_apply_url"]) == ("2026-08-01T00:00:00.000Z", "a\nc", "https://h.example/hcmUI/CandidateExperience/en/sites/S/job/5")
    rows, _ = read(spark, "generic", {"results": [{"jobId": 3, "jobTitle": "T", "postedAt": "nonsense", "postedOn": "Posted Today"}, {"id": 4}]}, max_rows=1)
    assert [(r["source_job_id"], r["location"], r["posted_at"]) for r in rows] == [("3", "Unspecified", "2026-08-20T00:00:00.000Z")]
    item = {"positionName": "T", "company": {"name": "C"}, "link": "https://i/1", "employmentType": ["A", "B"], "jobPosting": {"jobLocation": [{"address": {"addressLocality": "NY", "addressRegion": "NY"}}, {"address": {"addressCountry": "US"}}]}}
    rows, _ = read(spark, "items", [item, {"title": "no company", "url": "u"}])
    assert [(r["company"], r["location"], r["employment_type"]) for r in rows] == [("C", "NY, NY / US", "A, B")]


def test_unknown_kind_and_profile(spark):
    _, run = read(spark, "nonsense", "{}")
    assert run.status == "SKIPPED"
    df = spark.createDataFrame([("a", "lever", "c", None, None, "[]", NOW, p, None) for p in (None, "finance", "both")], PAYLOAD)
    assert read_boards(df, "finance")[1].count() == 2 and read_boards(df, "technical")[1].count() == 2


def docs(spark, document, url="https://list.example/page"):
    return spark.createDataFrame([("s", url, "Summer 2027", document, NOW)], "source_name string, url string, cycle_hint string, document string, scraped_at string")


def test_markdown_table(spark):
    text = "\n".join([
        "| Company | Role | Location | Application | Age |", "|---|---|---|---|---|",
        "| 🔥 **[Acme](https://acme.example)** | SWE Intern | NY, NY | [Apply](https://boards.greenhouse.io/acme/jobs/1234567) | 9d |",
        "| ↳ | [Data Intern](https://jobs.lever.co/acme/x) | | <a href=\"https://simplify.jobs/c/Acme\"><img alt=\"Simplify\"></a> | Jul 31 |",
        "| Beta | Closed Intern 🔒 | LA | [Apply](https://b.example) | 1d |", "| Gamma | No link | LA | none | $20 |",
    ])
    rows = [(r.company, r.title, r.location, r.posted_at, r.direct_apply_url, r.source_job_id) for r in parse_table_postings(docs(spark, text)).orderBy("ordinal").collect()]
    assert rows == [
        ("Acme", "SWE Intern", "NY, NY", "2026-08-11T18:00:00.000Z", "https://boards.greenhouse.io/acme/jobs/1234567", "1234567"),
        ("Acme", "Data Intern", "Unspecified", "2026-07-31T00:00:00.000Z", "https://jobs.lever.co/acme/x", None),
    ]
    html = "<table><tr><th>Company</th><th>Role</th><th>L</th></tr><tr><td>Acme</td><td><a href='https://a.example/1'>SWE</a></td><td>NY</td></tr></table>"
    assert [(r.company, r.title) for r in parse_table_postings(docs(spark, html)).collect()] == [("Acme", "SWE")]
    assert parse_table_postings(docs(spark, "")).count() == 0


def test_links_cards_collection_detail_watchlist(spark):
    html = "<a href='https://x.example/jobs/1'>Software role here</a> text <a href='https://x.example/jobs/1'>again</a><a href='https://x.example/about'>About</a><a href='https://x.example/apply/2'>Go</a>"
    rows = parse_link_postings(docs(spark, html)).orderBy("ordinal").collect()
    assert [r.direct_apply_url[-1] for r in rows] == ["1", "2"] and rows[0].title == "Software role here" and rows[1].title.startswith("Software role here text")
    card = '<ul><li><div data-entity-urn="urn:li:jobPosting:42"></div><a class="base-card__full-link" href="https://l.example/jobs/view/42?trk=x"></a><h3 class="base-search-card__title"> A &amp; B </h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4><time datetime="2026-08-01"></li>'
    (r,) = parse_cards(docs(spark, card + card)).collect()
    assert (r.source_job_id, r.title, r.company, r.location, r.posted_at, r.source_url) == ("42", "A & B", "Acme", "Unspecified", "2026-08-01T00:00:00.000Z", "https://l.example/jobs/view/42")
    part = '<div role="listitem" class="c"><a href="/page/one">x</a><div class="jobtitle">Analyst</div><div class="companyname_list">Acme</div><div class="blogtag">August 18, 2026</div></div>'
    page = docs(spark, part + part + '<a class="w-pagination-next x" href="?p=2">n</a>')
    (r,) = parse_collection(page).collect()
    assert (r.title, r.company, r.href, str(r.posted_at), r.next_href) == ("Analyst", "Acme", "/page/one", "2026-08-18 00:00:00", "?p=2")
    detail = spark.createDataFrame([('<p class="text-block-47">NY</p><h1>Role</h1> body Glassdoor rest',), ("none",)], "h string").select(parse_detail(F.col("h")).alias("d")).collect()
    assert [tuple(x.d) for x in detail] == [("NY", "Role body"), (None, "")]
    kept = join_details(parse_collection(page), spark.createDataFrame([], "href string, location string, description string"), F.lit(True))
    assert kept.count() == 0 and join_details(parse_collection(page), spark.createDataFrame([], "href string, location string, description string"), F.lit(False)).first().location == "Unspecified"
    marks = "intro\n## Tier A\nAcme / Acme Labs, Beta.\n- note\n## Other\nbeta, Gamma"
    got = {r.parent: (r.aliases, r.priority) for r in parse_watchlist(docs(spark, marks), [("Tier A", 10)]).collect()}
    assert got == {"Acme": (["Acme", "Acme Labs"], 10), "Beta": (["Beta"], 10), "Gamma": (["Gamma"], 4)}
    pages = spark.createDataFrame([("a", "<p>" + "x" * 600), ("b", "short"), ("c", None)], "url string, html string")
    assert {r.url: len(r.content_hash or "") for r in page_hashes(pages).collect()} == {"a": 64, "b": 0, "c": 0}


def test_ledger_and_boards(spark):
    from jobweave.sources.exclusions import board_candidates, harvest_boards, read_exclusions, unconfigured

    page = {"Company": {"type": "title", "title": [{"plain_text": "Acme, "}, {"plain_text": "Inc."}]}, "Role": {"type": "rich_text", "rich_text": [{"plain_text": "SWE Intern"}]}, "LINK": {"type": "url", "url": "https://A.example/1?utm_source=x"}}
    pages = spark.createDataFrame([("p1", json.dumps(page)), ("p2", "{}"), ("p3", None), ("p4", "not json")], "page_id string, properties string")
    rows = [tuple(r) for r in read_exclusions(pages, ["company"], ["role", "title"], ["link"], ["id"]).collect()]
    assert rows == [("p1", "acme", "swe intern", "https://a.example/1", None)]
    assert board_candidates(spark.createDataFrame([("Acme Labs",)], "company string"), ["x", "y"]).count() == 6
    links = spark.createDataFrame([("https://jobs.lever.co/acme/2", 2), ("https://jobs.lever.co/acme/1", 1), ("https://jobs.ashbyhq.com/beta/1", 3), ("https://x.example", 4)], "url string, ordinal int")
    assert [tuple(r) for r in harvest_boards(links, spark.createDataFrame([("ashby", "beta")], "ats string, board string")).collect()] == [("lever", "acme", "https://jobs.lever.co/acme/1")]
    watch = spark.createDataFrame([("Acme", ["Acme", "Acme Labs"]), ("Beta", ["Beta"])], "parent string, aliases array<string>")
    assert [r.parent for r in unconfigured(watch, spark.createDataFrame([("ACME LABS",)], "company string")).collect()] == ["Beta"]
