import pytest
from pyspark.sql import functions as F

from jobweave.functions import dates, identity, rules, text, url


def one(spark, expression, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(expression(*[F.col(f"c{k}") for k in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize("raw,want", [
    ("https://WWW.Example.com/jobs/123/?utm_source=x&department=eng#top", "https://example.com/jobs/123?department=eng"),
    ("https://example.com", "https://example.com/"), ("HTTP://Example.com:80//a//b/", "http://example.com/a/b"), (" not a link ", "not a link"),
    ("https://e.com/p?b=2&a=1&b=1&REF=z", "https://e.com/p?a=1&b=2&b=1"), ("", ""), (None, None),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, url.canonicalize_url, raw) == want


@pytest.mark.parametrize("link,want", [
    ("https://boards.greenhouse.io/acme/jobs/4455667", "4455667"), ("https://jobs.lever.co/acme/0a1b2c3d-0000-1111-2222-333344445555", "0a1b2c3d-0000-1111-2222-333344445555"),
    ("https://www.linkedin.com/jobs/view/99", "99"), ("https://x.example/jobs/12345?x=1", "12345"), ("https://x.example/jobs/12", None), (None, None),
])
def test_source_job_id(spark, link, want):
    assert one(spark, url.source_job_id, link) == want


def test_links(spark):
    assert [one(spark, url.apply_link_rank, u) for u in ("https://jobs.lever.co/a", "https://simplify.jobs/c/a", "https://a.example", "mailto:x", None)] == [3, 1, 2, 0, 0]
    assert tuple(one(spark, url.board_from_url, "https://job-boards.greenhouse.io/Acme/jobs/1")) == ("greenhouse", "acme")
    assert one(spark, url.board_from_url, "https://boards.greenhouse.io/embed/x") is None
    assert one(spark, url.linkedin_guest_url, "https://www.linkedin.com/jobs/view/swe-at-acme-77?x=1").endswith("/77")


def test_texts(spark):
    assert one(spark, lambda c: text.normalize_text(c), "ﬁne  C++ &amp; R&D!") == "fine c++ r d"
    assert one(spark, text.extract_text, "<p>Hi&nbsp;<b>you</b></p><script>x<y</script> &amp; me") == "Hi you & me"
    assert one(spark, text.short_summary, "&amp;lt;p&amp;gt;Hello &amp;amp; all") == "Hello & all"
    assert one(spark, text.short_summary, None) == text.NO_SUMMARY and len(one(spark, text.short_summary, "ab " * 9999)) == 280
    assert one(spark, text.escape_html, "<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, text.slug_candidates, "Acme Labs, Inc") == ["acmelabsinc", "acme-labs-inc", "acme"]


def test_identity(spark):
    assert one(spark, identity.title_signature, "software engineering intern c++ or python summer 2027") == "c++.engin.pytho.softw"
    assert one(spark, identity.canonical_location, "Atlanta, Georgia, United States") == "atlanta ga"
    assert one(spark, identity.canonical_location, "United States") == "united states"
    assert one(spark, lambda a, b: identity.location_bucket(a, b), "Atlanta, GA +5", "x") == "*"
    assert one(spark, lambda a, b, c: identity.requisition_signature(a, b, c), "acme", "summer internship", "Fall 2026") is None
    same = lambda a, b: one(spark, identity.titles_describe_one_role, a, b)
    assert same("software engineer intern search platform", "software engineer intern search platform 2027") and not same("computer architecture", "deep learning computer architecture") and not same("intern", "internship")
    assert one(spark, identity.same_employer, "acme", "acme health") and not one(spark, identity.same_employer, "", "x")
    assert one(spark, identity.describes_same_role, "Software Engineer Intern", "Software Engineer Internship") and not one(spark, identity.describes_same_role, "Software Engineer", "Software Engineer Intern")
    a, b = (spark.createDataFrame([(x,)], "i array<string>").select(identity.digest_hash(F.col("i"))).first()[0] for x in (["1", "2"], ["2", "1"]))
    assert a == b and len(one(spark, lambda c: identity.sign_id(c, "secret"), "id")) == 32


NOW = "2026-01-15T12:00:00Z"


@pytest.mark.parametrize("f,cell,want", [
    (dates.parse_posted_at, "9d", "2026-01-06 12:00:00"), (dates.parse_posted_at, "1mo", "2025-12-16 12:00:00"), (dates.parse_posted_at, "Dec 18", "2025-12-18 00:00:00"), (dates.parse_posted_at, "Jan 3", "2026-01-03 00:00:00"),
    (dates.parse_posted_at, "Foo 3", None), (dates.parse_posted_at, "Feb 30", None), (dates.parse_posted_at, None, None),
    (dates.parse_prose_day, "Posted 30+ Days Ago", "2025-12-16 00:00:00"), (dates.parse_prose_day, "Posted Today", "2026-01-15 00:00:00"), (dates.parse_prose_day, "Soon", None),
])
def test_relative_dates(spark, f, cell, want):
    got = one(spark, lambda c, n: f(c, n.cast("timestamp")).cast("string"), cell, NOW)
    assert got == want


def test_printed_dates(spark):
    assert one(spark, lambda c: dates.parse_listed_date(c).cast("string"), "August 18, 2026") == "2026-08-18 00:00:00"
    assert one(spark, dates.posted_day_key, "2026-08-21T05:39:00Z", None) == 20260820 and one(spark, dates.posted_day_key, "2026-08-21T00:00:00Z", None) == 20260821 and one(spark, dates.posted_day_key, "x", None) == 0
    assert one(spark, dates.posted_label, "2026-08-21T05:39:00Z", None) == "Aug 20, 2026, 10:39 PM" and one(spark, dates.posted_label, None, None).endswith("first seen today")


def test_rules(spark):
    rs = [rules.Rule("a", "(?i)alpha"), rules.Rule("b", "(?i)beta", unless="(?i)gamma")]
    df = spark.createDataFrame([("Alpha beta",), ("BETA",), ("beta gamma",), (None,)], "title string")
    assert [r[0] for r in df.select(rules.first_match(rs, "none")).collect()] == ["a", "b", "none", "none"]
    assert [r[0] for r in df.select(rules.evidence(rs)).collect()] == ["Alpha", "BETA", None, None] and df.select(rules.all_matches(rs)).first()[0] == ["a", "b"]
    assert [one(spark, rules.season_cycle, t) for t in ("Trading Intern - Winter Quarter 2027", "2026 Fall intern", "Summer '27 intern", "intern 2027", "Springfield 2027")] == ["Winter 2027", "Fall 2026", "Summer 2027", None, None]


def test_compatibility_forms_against_the_character_database(spark):
    import re
    import unicodedata

    chars = [chr(c) for c in [*range(0xA0, 0xD800), *range(0xF900, 0x1F000)] if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    values = ["".join(f"a{c}b " for c in chars[k : k + 40]) for k in range(0, len(chars), 40)]
    values += [f"{b}{m}x" for b in "aAqQzsN" for m in map(chr, range(0x300, 0x370))] + ["Ｆｕｌｌ　Ｗｉｄｔｈ＋", "①②③ №5 ½ ℡ ﬃ", "plain C++ &amp; R&D", "", "İstanbul"]
    want = [re.sub("[^a-z0-9+#.]+", " ", unicodedata.normalize("NFKC", v).lower().replace("&amp;", "&")).strip() for v in values]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(-1, None)], "k int, v string")
    got = {r.k: r.n for r in df.select("k", text.normalize_text(F.col("v")).alias("n")).collect()}
    wrong = [(values[k], w, got[k]) for k, w in enumerate(want) if got[k] != w]
    assert got[-1] is None and not wrong, wrong[:5]


def test_queries_are_encoded_as_forms_are(spark):
    cases = {
        "https://a.example/x?b=1%202&a=%C3%A9": "https://a.example/x?a=%C3%A9&b=1+2", "https://a.example/x?q=a~b*c(d)": "https://a.example/x?q=a%7Eb*c%28d%29", "https://a.example/x?q=50%&utm%5Fsource=z": "https://a.example/x?q=50%25",
        "https://a.example/x?k=a=b": "https://a.example/x?k=a%3Db", "https://a.example/x?flag": "https://a.example/x?flag=",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", url.canonicalize_url(F.col("u")).alias("c")).collect()} == cases
