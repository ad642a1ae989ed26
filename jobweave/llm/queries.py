"""The registered queries of the operators for training data, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.consensus import survivors, undisputed
from jobweave.llm.history import find_repeats
from jobweave.llm.linkage import match_records
from jobweave.llm.location_mapping import map_locations
from jobweave.llm.mixing import draw_mixes, share_report
from jobweave.llm.name_variants import link_names, variant_pairs
from jobweave.llm.packing import fill_report, pack_documents
from jobweave.llm.text_quality import text_statistics
from jobweave.session import table, write_shared


def _typed_locations(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "raw_postings").select(F.lit("raw_postings").alias("table_name"), F.col("posting_id").alias("record_id"), F.col("location").alias("value"))
    jobs = table(spark, folder, "classified_jobs").select(F.lit("classified_jobs").alias("table_name"), F.col("job_id").alias("record_id"), F.col("normalized_location").alias("value"))
    return raw.unionByName(jobs.where("value <> 'unspecified'"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return map_locations(_typed_locations(spark, folder), table(spark, folder, "ref_locations")).select("table_name", "record_id", "location_id")


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that name no entry, with the number of their rows."""
    found = map_locations(_typed_locations(spark, folder), table(spark, folder, "ref_locations"))
    return found.where("location_id = -1").groupBy("table_name", "value").agg(F.count("*").alias("n_rows"), F.first(F.size("places")).alias("n_possible"))


def _aliases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "company_aliases").select(F.col("alias_normalized").alias("alias"), F.col("canonical_company").alias("canonical"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "raw_postings").select(F.col("company").alias("name")).unionByName(table(spark, folder, "applied_exclusions").select(F.col("company_normalized").alias("name")))
    return variant_pairs(link_names(names, _aliases(spark, folder)))


def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every name with its organisation: the classes of which p5_found has the pairs."""
    names = table(spark, folder, "raw_postings").select(F.col("company").alias("name")).unionByName(table(spark, folder, "applied_exclusions").select(F.col("company_normalized").alias("name")))
    linked = write_shared(link_names(names, _aliases(spark, folder)), "entities")
    return linked.join(linked.groupBy("entity").agg(F.min("name").alias("first")), "entity").select("name", F.col("first").alias("entity"))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_statistics(spark, folder).where("kind <> 'prose'").select("doc_id").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return undisputed(table(spark, folder, "merge_candidates"), table(spark, folder, "source_profiles"))


def p6_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors(table(spark, folder, "merge_candidates"), table(spark, folder, "source_profiles")).select("group_id", "field_name", "value", "copy_id", F.round("distance", 4).alias("distance"))


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    r, p = table(spark, folder, "employer_requisitions"), table(spark, folder, "raw_postings")
    place = F.concat_ws(", ", "work_city", "work_state")
    left = r.select(F.col("req_id").alias("id"), F.col("employer").alias("name"), F.col("role_title").alias("title"), "team", place.alias("place"), F.col("term").alias("hint"), F.col("apply_link").alias("link"))
    none = F.lit(None).cast("string")
    right = p.select(F.col("posting_id").alias("id"), F.col("company").alias("name"), "title", none.alias("team"), F.col("location").alias("place"), F.col("cycle_hint").alias("hint"), F.col("direct_apply_url").alias("link"))
    found = match_records(left, right, table(spark, folder, "ref_locations"), _aliases(spark, folder))
    return found.select(F.col("left_id").alias("req_id"), F.col("right_id").alias("posting_id"), F.round("confidence", 4).alias("confidence"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_matches(spark, folder).select("req_id", "posting_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "classified_jobs")
    source = F.when(F.trim("source_job_id") != "", F.concat_ws(":", "source_name", F.trim("source_job_id")))
    place = F.when(F.col("normalized_location") != "unspecified", F.col("normalized_location"))
    rows = c.select(F.col("job_id").alias("id"), F.col("batch_no").alias("batch"), F.col("company").alias("name"), "title", place.alias("place"), F.col("cycle").alias("hint"), F.col("canonical_url").alias("link"), source.alias("source"))
    found = find_repeats(rows, table(spark, folder, "ref_locations"), _aliases(spark, folder))
    return found.select(F.col("first").alias("job_id_a"), F.col("later").alias("job_id_b"))


def p8_windows(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), table(spark, folder, "pack_sizes"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(p8_windows(spark, folder), table(spark, folder, "pack_sizes"))


def p8_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Per pack: windows that hold more than they may, texts cut without need, pieces that are there twice, and the texts in the windows."""
    sizes = table(spark, folder, "pack_sizes")
    packed = write_shared(p8_windows(spark, folder), "windows")
    full = packed.groupBy("pack_name", "window_id").agg(F.sum("n_tokens").alias("used")).join(sizes, "pack_name").where("used > capacity_tokens").groupBy("pack_name").agg(F.count("*").alias("n_overfull"))
    texts = packed.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.countDistinct("first_token").alias("places")).join(sizes, "pack_name")
    kept = texts.groupBy("pack_name").agg(F.count("*").alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_cut"), F.count_if(F.col("pieces") != F.col("places")).alias("n_twice"))
    return kept.join(full, "pack_name", "left").select("pack_name", F.coalesce("n_overfull", F.lit(0).cast("long")).alias("n_overfull"), "n_cut", "n_twice", "n_texts")


def p9_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Per mix: documents drawn too often, from a source that was not asked for, or twice, and whether every source with tokens has its share to within two points or the largest document drawn."""
    targets = table(spark, folder, "mix_targets")
    drawn = write_shared(p9_draw(spark, folder), "drawn")
    asked = drawn.join(targets, ["mix_name", "source"], "left")
    each = asked.groupBy("mix_name").agg(F.count_if(F.col("n_copies") > F.col("max_repeats")).alias("n_often"), F.count_if(F.col("max_repeats").isNull()).alias("n_stray"), (F.count("*") - F.countDistinct("doc_id")).alias("n_twice"))
    there = share_report(drawn, targets).where("n_tokens > 0").groupBy("mix_name").agg(F.sum("target_share").alias("whole"), F.collect_list(F.struct("target_share", "actual_share")).alias("s"))
    grain = drawn.groupBy("mix_name").agg((F.max("n_tokens") / F.sum(F.col("n_tokens") * F.col("n_copies"))).alias("grain"))
    kept = there.join(grain, "mix_name").select("mix_name", F.forall("s", lambda x: F.abs(x["target_share"] / F.col("whole") - x["actual_share"]) <= F.greatest(F.lit(0.02), F.col("grain"))).alias("shares_kept"))
    return each.join(kept, "mix_name")


def p9_draw(spark: SparkSession, folder: str) -> DataFrame:
    return draw_mixes(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return share_report(p9_draw(spark, folder), table(spark, folder, "mix_targets"))


P6_SQL = """
with t as (select m.*, coalesce(p.trust_rank, 2147483647) tr from merge_candidates m left join source_profiles p using (source_name)),
l as (select group_id, copy_id, tr, scraped_at, 'canonical_url' f, canonical_url v, regexp_matches(canonical_url, '^https?://[^/?#\\s.]+\\.[^/?#\\s]+/([^/?#]+/)+[^/?#]*[0-9][^/?#]*/?([?#].*)?$') u, 0 z from t
  union all select group_id, copy_id, tr, scraped_at, 'direct_apply_url', direct_apply_url, regexp_matches(direct_apply_url, '^https?://[^/?#\\s.]+\\.[^/?#\\s]+/([^/?#]+/)+[^/?#]*[0-9][^/?#]*/?([?#].*)?$'), 0 from t
  union all select group_id, copy_id, tr, scraped_at, 'score', score::varchar, score >= 0, 0 from t
  union all select group_id, copy_id, tr, scraped_at, 'description', description, not regexp_matches(description, '(\\.\\.\\.|…|\\[more\\])\\s*$') and regexp_matches(description, '[.!?]\\s*$')
    and lower(description) not in ('n/a', 'no description given.', 'see website.', 'duplicate copy.', 'apply on company site') and regexp_replace(description, '<[^>]*>|\\s', '', 'g') <> '', length(description) from t),
d as (select group_id, f from l group by 1, 2 having count(distinct v) + (count(*) > count(v))::int > 1),
v as (select group_id, f, v, min(tr) tr, max(scraped_at) s, max(z) z, min(copy_id) c from l where coalesce(u, false) group by 1, 2, 3),
b as (select group_id, f, min(tr) tr, max(s) s, max(z) z from v group by 1, 2)
select v.group_id, v.f field_name, min(v.c) copy_id from v join b on v.group_id = b.group_id and v.f = b.f and v.tr = b.tr and v.s = b.s and v.z = b.z join d on d.group_id = v.group_id and d.f = v.f group by 1, 2
"""

QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p5_found": p5_found, "p5_entities": p5_entities, "p2_found": p2_found, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_found": p7_found, "p7_matches": p7_matches, "p8_windows": p8_windows, "p8_fill": p8_fill, "p8_faults": p8_faults, "p9_draw": p9_draw, "p9_shares": p9_shares, "p9_faults": p9_faults, "p10_found": p10_found, "p10_statistics": p10_statistics}
SQL: dict[str, str] = {
    "p6_found": P6_SQL,
    # what must hold of any packing and draw
    "p8_faults": "select pack_name, 0::bigint n_overfull, 0::bigint n_cut, 0::bigint n_twice, (select count(distinct doc_id) from documents where text <> '') n_texts from pack_sizes",
    "p9_faults": "select distinct mix_name, 0::bigint n_often, 0::bigint n_stray, 0::bigint n_twice, true shares_kept from mix_targets join documents using (source) where text <> ''",
}
