"""What leaves the engine: tables replaced or merged, rendered digests, payloads for outside systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import escape_html
from jobweave.functions.url import apply_link_rank


def replace_all(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of the same key replaced by ``rows`` (which should have one row per key)."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def trimmed(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Texts cut to what a store takes."""
    return rows.withColumns({c: F.left(c, F.lit(n)) for c, n in limits.items()})


def apply_links(direct: Column, source: Column) -> Column:
    """array(struct(label, url)): the apply link, which is the source's where there is no direct one (``View listing`` if it only lists), and the listing if it is another address."""
    apply = F.coalesce(direct, source)
    first = F.when(apply.isNotNull(), F.struct(F.when(apply_link_rank(apply) == 1, "View listing").otherwise("Apply").alias("label"), apply.alias("url")))
    second = F.when(source.isNotNull() & (source != apply), F.struct(F.lit("Listing").alias("label"), source.alias("url")))
    return F.array_compact(F.array(first, second))


def sections(rows: DataFrame, section: Column, order: list[str]) -> DataFrame:
    """+ section, section_no of the rows that have one; sections without rows do not come up."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("section"))
    return rows.withColumn("section", section).where("section is not null").withColumn("section_no", place)


def degraded(runs: DataFrame) -> DataFrame:
    """source_name, note of runs that failed or were cut short; skipped ones are none."""
    bad = runs.where(F.upper("status").isin("FAILED", "DEGRADED"))
    return bad.select("source_name", F.concat_ws(": ", "source_name", F.coalesce("error_message", F.upper("status"))).alias("note"))


def _listed(rows: DataFrame | None, spark_rows: DataFrame, text: Column, html: Column) -> DataFrame:
    """One row with arrays of the texts and of the HTML items of a short list."""
    if rows is None:
        return spark_rows.limit(0).agg(F.collect_list(F.lit("")).alias("text"), F.collect_list(F.lit("")).alias("html"))
    pairs = F.array_sort(F.collect_list(F.struct(text.alias("t"), html.alias("h"))))
    return rows.agg(pairs.alias("p")).select(F.transform("p", lambda x: x["t"]).alias("text"), F.transform("p", lambda x: x["h"]).alias("html"))


def render_digest(rows: DataFrame, sort: list[Column], name: str = "New roles", stamp: Column | None = None, changes: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """One row: subject, html, text, n_roles of rows with section, section_no, title, company, place, label, url, and where they are there cycle, posted, source_name, skills (array), summary.

    ``changes`` (company, label, url) and ``notes`` (note) follow in sections of their own, if they have rows; without roles the changes give the subject. A digest is small by its cap; its rows are gathered here only.
    """
    has = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    skills = F.when(F.size("skills") > 0, F.array_join("skills", ", ")) if "skills" in rows.columns else F.lit(None).cast("string")
    facts = F.concat_ws(" · ", has("cycle"), F.concat(F.lit("Posted: "), has("posted")), F.concat(F.lit("Source: "), has("source_name")), F.concat(F.lit("Skills: "), skills), has("summary"))
    line = F.concat_ws("\n", F.concat_ws(" · ", "title", "company", "place", F.concat_ws(": ", "label", "url")), F.nullif(facts, F.lit("")))
    item = F.concat(F.lit("<li><a href=\""), escape_html(F.coalesce("url", F.lit(""))), F.lit("\">"), escape_html(F.col("title")), F.lit("</a> · "), escape_html(F.col("company")), F.lit(" · "), escape_html(F.coalesce("place", F.lit(""))), F.lit(" · "), escape_html(F.coalesce("label", F.lit(""))), F.when(facts != "", F.concat(F.lit("<br>"), escape_html(facts))).otherwise(""), F.lit("</li>"))
    lines = rows.select("section", "section_no", F.struct(*sort, line.alias("text"), item.alias("html")).alias("r"))
    per = lines.groupBy("section_no", "section").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    html = F.concat(F.lit("<h2>"), escape_html(F.col("section")), F.lit("</h2><ul>"), F.array_join(F.transform("rs", lambda x: x["html"]), ""), F.lit("</ul>"))
    text = F.concat(F.col("section"), F.lit("\n"), F.array_join(F.transform("rs", lambda x: x["text"]), "\n"))
    parts = per.agg(F.array_sort(F.collect_list(F.struct("section_no", html.alias("html"), text.alias("text"), F.size("rs").alias("n")))).alias("p"))
    anchor = F.concat(F.lit("<li><a href=\""), escape_html(F.coalesce("url", F.lit(""))), F.lit("\">"), escape_html(F.coalesce("company", F.lit(""))), F.lit("</a>"), F.coalesce(F.concat(F.lit(" - "), escape_html(F.col("label"))), F.lit("")), F.lit("</li>"))
    changed = _listed(changes, rows, F.concat_ws(": ", F.concat_ws(" - ", "company", "label"), "url"), anchor).select(F.col("text").alias("ct"), F.col("html").alias("ch"))
    noted = _listed(notes, rows, F.col("note"), F.concat(F.lit("<li>"), escape_html(F.col("note")), F.lit("</li>"))).select(F.col("text").alias("nt"), F.col("html").alias("nh"))
    n = F.aggregate("p", F.lit(0), lambda a, x: a + x["n"])
    more = lambda title, c, h: F.when(F.size(c) > 0, F.concat(F.lit(f"<h2>{title}</h2><ul>"), F.array_join(c, ""), F.lit("</ul>")) if h else F.concat(F.lit(f"{title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    at = F.concat(F.lit(", "), stamp) if stamp is not None else F.lit("")
    subject = F.when((n == 0) & (F.size("ct") > 0), F.concat(F.lit("Page updates: "), F.size("ct").cast("string"), F.lit(" changed"), at)).otherwise(F.concat(F.lit(f"{name}: "), n.cast("string"), F.lit(" roles"), at))
    one = lambda df: df.withColumn("_one", F.lit(1))
    whole = one(parts).join(one(changed), "_one").join(one(noted), "_one")  # three tables of one row each
    html = F.concat_ws("", F.array_join(F.transform("p", lambda x: x["html"]), ""), more("Page updates", "ch", True), more("Sources that failed or were cut short", "nh", True))
    text = F.concat_ws("\n\n", F.nullif(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), F.lit("")), more("Page updates", "ct", False), more("Sources that failed or were cut short", "nt", False))
    return whole.select(subject.alias("subject"), html.alias("html"), text.alias("text"), n.alias("n_roles"))


def report_json(report: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return report.select(F.to_json(F.struct("*")).alias("value"))


def ledger_payload(rows: DataFrame, fields: dict[str, tuple[str, str]], options: dict[str, list[str]], limit: int = 2_000) -> DataFrame:
    """id, payload: rows as a page of a ledger whose properties are typed. ``fields``: property -> (type, column); a select is written only if its option exists.

    Types: title, text, url, select, date, number. Texts are cut to ``limit`` characters; nulls are left out.
    """
    def encode(kind: str, name: str, c: Column) -> Column:
        text = F.left(c.cast("string"), F.lit(limit))
        if kind in ("title", "text"):
            return F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("text"))).alias("title" if kind == "title" else "rich_text")))
        if kind == "select":
            c = F.when(c.isin(options.get(name, [])), c)
            return F.when(c.isNotNull(), F.to_json(F.struct(F.struct(c.alias("name")).alias("select"))))
        if kind == "date":
            return F.to_json(F.struct(F.struct(c.cast("string").alias("start")).alias("date")))
        return F.to_json(F.struct(c.alias(kind)))

    pairs = F.array_compact(F.array(*[F.when(F.col(col).isNotNull(), F.concat(F.lit(f'"{name}":'), encode(kind, name, F.col(col)))) for name, (kind, col) in fields.items()]))
    return rows.select("id", F.concat(F.lit('{"properties":{'), F.array_join(pairs, ","), F.lit("}}")).alias("payload"))


def status_patch(field: str, status: Column) -> Column:
    """The payload that sets the status of a page of the ledger and nothing else."""
    return F.to_json(F.struct(F.create_map(F.lit(field), F.struct(F.struct(status.alias("name")).alias("select"))).alias("properties")))


def mirror_queue(jobs: DataFrame, limit: int, drained: bool = False) -> DataFrame:
    """The oldest postings that are open and not mirrored yet, up to ``limit``; once the backlog is ``drained`` only those seen in the latest round, so that a page removed by hand does not come back."""
    queue = jobs.where("status = 'OPEN' and page_id is null")
    if drained:
        newest = jobs.agg(F.max("last_seen_at").alias("_newest"))
        queue = queue.join(F.broadcast(newest), F.col("last_seen_at") == F.col("_newest")).drop("_newest")
    return queue.orderBy("first_seen_at", "id").limit(limit)
