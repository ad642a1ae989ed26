import math
import random
from collections import Counter

import pytest

from jobweave.llm.names import read_name, same_name
from jobweave.llm.places import Places
from jobweave.llm.strings import NgramIndex, edits, grams, jaro_winkler, skeleton
from jobweave.llm.titles import Titles, standard_tokens

ROWS = [(100, None, None, None, None), (1, "Halcyville", "TX", "Texas", None), (2, "Mount Garnet", "IL", "Illinois", "GRNQ"), (3, "Quill Falls", "UT", "Utah", None), (4, "Quill Falls", "OR", "Oregon", None), (5, "Saint Dunmor", "MO", "Missouri", "Old Sain"), (6, "Port Cinder", "PA", "Pennsylvania", None)]


@pytest.fixture(scope="module")
def places():
    return Places(ROWS)


def brute(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_against_brute_force():
    rnd = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(8))) for _ in range(2))
        for most in (0, 1, 2, 9):
            assert edits(a, b, most) == min(brute(a, b), most + 1), (a, b, most)


def test_jaro_winkler_and_codes():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dwayne", "duane"), 2) == 0.84 and jaro_winkler("", "x") == 0 and jaro_winkler("", "") == 1
    assert skeleton("quorvyne") == skeleton("qourvyne") and skeleton("") == ""


def test_index_is_the_cosine():
    names = ["halcyville", "halcyport", "mountgarnet", "quillfalls"]
    index = NgramIndex(names)

    def cosine(a, b):
        df = Counter(g for n in names for g in grams(n))
        w = lambda t: {g: v * (math.log(1 + 4 / df[g]) if df[g] else math.log(5)) for g, v in grams(t).items()}
        x, y = w(a), w(b)
        return sum(x[g] * y.get(g, 0) for g in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    for q in ("halcyvile", "garnet", "zzz"):
        got = dict(index.search(q, 9))
        for k, n in enumerate(names):
            assert got.get(k, 0) == pytest.approx(cosine(q, n))


@pytest.mark.parametrize("text,want", [
    ("Halcyville, TX", 1), ("halcyville tx", 1), ("HALCYVILLE - TX", 1), ("US-TX-Halcyville", 1), ("Texas: Halcyville", 1), ("Halcyville, TX 75001", 1), ("Halcyville HQ", 1), ("Greater Halcyville Area, Texas", 1),
    ("Halcyvlile, Texas, United States", 1), ("Halcyvi., TX", 1), ("Hybrid - Halcyville, TX", 1), ("Halcyville, TX / On-site", 1), ("Mt. Garnet, IL", 2), ("grnq office", 2), ("MountqGarnet", 2), ("Old Sain", 5), ("St. Dunmor, MO", 5),
    ("us or quill falls", 4), ("Quill Falls, OR", 4), ("Quill Falls", -1), ("Halcyville, IL", -1), ("Halcyville, TX; Mount Garnet, IL", -1), ("Halcyville or Mount Garnet", -1), ("halcyville tx mount garnet il", -1), ("Halcyville, TX +5 more", -1),
    ("6 locations Halcyville, TX …", -1), ("Remote", 100), ("Remtoe, US", 100), ("Work from home (US)", 100), ("Anywhere in the US", 100), ("TBD", -1), ("—", -1), ("Toronto Heights, Ontario, Canada", -1), ("", -1), (None, -1), ("x" * 100_000, -1),
])
def test_places(places, text, want):
    assert places.read(text)[0] == want


def test_possible_places(places):
    assert places.read("Quill Falls")[1] == (3, 4) and set(places.read("Halcyville or Mount Garnet")[1]) == {1, 2} and places.read("HQ")[1] == ()
    assert Places([]).read("Halcyville, TX") == (-1, ())


SAME = ["Quorvyne Systems", "QUORVYNE SYSTEMS", "Systems, Quorvyne", "QuorvyneSystems", "quorvyne-systems", "Quorvyne Systems, Inc.", "Quorvyne Sys", "The Quorvyne Systems Company", "Quorvyne Systems (US)", "Quorvyne Systems d/b/a Quorvyne", "Qourvyne Systems", "Quorvyné Systems", "quorvynesystems", "Quorvy Systems", "Quorvyne Sysqems", "Quorvyne Systems L.L.C."]


def test_names():
    for a in SAME:
        assert same_name(read_name(SAME[0]), read_name(a)), (a, read_name(a))
    assert not same_name(read_name("Quorvyne Systems"), read_name("Quorvyne Capital")) and not same_name(read_name("Quorvyne Systems"), read_name("Quorfyla Systems"))
    assert same_name(read_name("Kubiwina & Nigimeza"), read_name("Nigimeza + Kubiwina Partners")) and same_name(read_name("Kubiwina & Nigimeza"), read_name("Kubiwina, Nigime"))
    assert read_name("Cubojemi.example") == (("cubojemi",), "") and read_name("Coroji's") == (("coroji*",), "") and read_name(None) == read_name("  ") == ((), "") and read_name("???") == ((), "")
    assert read_name("A" * 10_000)[0]


def test_titles(places):
    t = Titles({"storage": 90, "telemetry": 80}, places)
    one = t.read("Summer 2027 Software Engineer Intern (Storage Foundations)")
    for other in ("SWE Intern, Storage Fndns - Su27", "Storage Foundations: Software Engineering Internship ('27 Summer)", "INTERN - SOFTWARE ENG. / STORAGE FOUNDATIONS / SUMMER 2027 - Halcyville", "Sofware Engineer Interns | Storaeg Foundations | Sumemr 2027 *NEW*"):
        assert t.read(other)[:2] == one[:2], t.read(other)
    assert t.read("Data Engineer Intern - Class of 2028")[1] == t.read("'28 Data Engineer")[1] == "Later compatible" and t.read("Data Engineer Intern")[1] == ""
    assert t.read("Analyst, Data Intern")[0] == t.read("Data Analytics Internship")[0] != t.read("Data Science Intern")[0]
    assert t.read("PM (Product) Intern")[0] == t.read("Product Mgmt Internship")[0] and t.read("Treasury Intern")[0] == t.read("Treasury Analyst Intern")[0]
    assert t.read("Data Engineer Intern - Halcyville")[2] == (1,) and t.read(None) == t.read("  ") == ("", "", ()) and t.read("x " * 50_000)[1] == ""


def test_standard_tokens():
    assert standard_tokens({"mobile": 900, "moblie": 90, "labs": 50, "rare": 1, "a1": 99}, 10_000) == {"mobile": 900, "labs": 50}


def test_recall_of_the_index_against_brute_force():
    rnd = random.Random(9)
    heads, tails = ["hal", "quo", "mar", "wex", "tam", "dun", "pel", "ivo", "lar", "gar", "fen", "bra"], ["ville", "port", "burgh", "field", "ton", "mountain", "creek", "harbor", "springs"]
    names = sorted({rnd.choice(heads) + rnd.choice(["", "low", "rin", "cy", "mor"]) + rnd.choice(tails) for _ in range(300)})
    index = NgramIndex(names)
    hit = total = 0
    for name in names:
        for _ in range(4):
            k = rnd.randrange(1, len(name) - 1)
            noisy = rnd.choice([name[:k] + name[k + 1 :], name[:k] + rnd.choice("qxyz") + name[k:], name[:k] + rnd.choice("qxyz") + name[k + 1 :], name[: k - 1] + name[k] + name[k - 1] + name[k + 1 :]])
            best = min(edits(noisy, n, 3) for n in names)
            near = {n for n in names if edits(noisy, n, 3) == best}
            hit += bool(near & {names[i] for i, _ in index.search(noisy, 12)})
            total += 1
    assert hit / total >= 0.97
