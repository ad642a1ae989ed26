import json


from jobweave.config import load_aliases, load_rules
from jobweave.functions.rules import first_match
from jobweave.operators.joins import alias_table, resolve_alias


def test_config_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Alphabet": ["Google LLC", "google"], "Acme": []}))
    (tmp_path / "r.json").write_text(json.dumps([{"value": "x", "pattern": "(?i)alpha", "field": "t"}, {"value": "y", "pattern": ".", "field": "t", "unless": "z"}]))
    aliases = load_aliases(spark, str(tmp_path / "a.json"))
    rows = spark.createDataFrame([("google llc",), ("acme",), ("other",)], "k string")
    assert {r.k: r.resolved for r in resolve_alias(rows, "k", alias_table(aliases)).collect()} == {"google llc": "Alphabet", "acme": "Acme", "other": "other"}
    df = spark.createDataFrame([("Alpha z",), ("b",), ("z",)], "t string")
    assert [r[0] for r in df.select(first_match(load_rules(str(tmp_path / "r.json")))).collect()] == ["x", "y", None]
