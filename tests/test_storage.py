"""Tables, logs, snapshots and feeds."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gazette.sources import feeds, raw_log, tables
from gazette.sources.parted_table import PartedTable

COLUMNS = "link string, title string, published timestamp, collected_at timestamp"
NOW = dt.datetime(2026, 4, 14)


def rows(spark, *items):
    return spark.createDataFrame([(link, title, day, NOW) for link, title, day in items], COLUMNS)


def stored(spark, folder):
    return {r.link: r.title for r in PartedTable(spark, folder).read().collect()}


def files(folder):
    return {
        os.path.join(d, f): os.path.getmtime(os.path.join(d, f))
        for d, _, names in os.walk(f"{folder}/rows") for f in names if f.endswith(".parquet")
    }


def order():
    return [F.col("published").desc_nulls_last()]


def test_upsert_replaces_by_link(spark, folder):
    table = PartedTable(spark, folder)
    table.upsert(rows(spark, ("a", "1", NOW), ("b", "2", NOW)), order=order())
    table.upsert(rows(spark, ("a", "old", dt.datetime(2020, 1, 1)), ("a", "new", NOW)), order=order())
    assert stored(spark, folder) == {"a": "new", "b": "2"}
    # A row moves to another day, and one without any day is found again.
    table.upsert(rows(spark, ("a", "moved", dt.datetime(2020, 1, 1))).withColumn("collected_at", F.lit(None).cast("timestamp")), order=order())
    table.upsert(rows(spark, ("c", "x", None)).withColumn("collected_at", F.lit(None).cast("timestamp")), order=order())
    table.upsert(rows(spark, ("c", "y", None)), order=order())
    assert stored(spark, folder) == {"a": "moved", "b": "2", "c": "y"}
    table.upsert(rows(spark).withColumn("extra", F.lit(1)), order=order())
    table.upsert(rows(spark, ("d", "z", NOW)).withColumn("extra", F.lit(1)), order=order())
    assert {(r.link, r.extra) for r in table.read().collect()} == {("a", None), ("b", None), ("c", None), ("d", 1)}


def test_a_missing_link_fails_the_whole_batch(spark, folder):
    table = PartedTable(spark, folder)
    table.upsert(rows(spark, ("a", "1", NOW)), order=order())
    with pytest.raises(Exception, match="link is NULL"):
        table.upsert(rows(spark, ("b", "2", NOW), (None, "3", NOW)), order=order())
    assert stored(spark, folder) == {"a": "1"}


def test_untouched_parts_keep_their_files(spark, folder):
    table = PartedTable(spark, folder, buckets=4)
    many = [(f"l{i}", "first", NOW - dt.timedelta(days=i % 5)) for i in range(100)]
    table.upsert(rows(spark, *many), order=order())
    before, parts = files(folder), table.parts()
    assert len(parts) == 20 and sum(n for _, n in parts.values()) == 100
    table.upsert(rows(spark, ("l7", "second", NOW - dt.timedelta(days=2))), order=order())
    after = table.parts()
    assert {k for k in parts if parts[k] != after.get(k)} == {k for k, v in after.items() if v[0] == 2}
    assert len([v for v in after.values() if v[0] == 2]) == 1 and sum(n for _, n in after.values()) == 100
    assert {f: m for f, m in files(folder).items() if f in before} == before
    # One key moves to another day: its old part and its new one, in one bucket.
    table.upsert(rows(spark, ("l7", "third", NOW)), order=order())
    assert sorted(k[0] for k, v in table.parts().items() if v[0] == 3) == ["2026-04-12", "2026-04-14"]
    assert stored(spark, folder) == {link: "third" if link == "l7" else "first" for link, *_ in many}
    # Later rows stay when the stamp decides.
    stamped = PartedTable(spark, folder + "-stamped", buckets=2)
    for title, hour in (("late", 5), ("early", 3)):
        stamped.upsert(rows(spark, ("a", title, NOW)).withColumn("s", F.lit(NOW + dt.timedelta(hours=hour))), order=[F.col("s").desc()], stamp="s")
    assert [r.title for r in stamped.read().collect()] == ["late"]


def test_appended_batches_merge_as_upserts_do(spark, folder):
    stamps = [[("a", 5), ("b", 1)], [("a", None), ("c", 2)], [("a", 3), ("b", 1)], [("a", 2), ("c", None), ("b", 0)], [("d", None)], [("d", 1), ("a", 3)]]
    one, many = PartedTable(spark, folder + "-one", buckets=2), PartedTable(spark, folder + "-many", buckets=2)
    first = rows(spark, *[(f"l{i}", "first", NOW - dt.timedelta(days=i % 3)) for i in range(20)]).withColumn("s", F.lit(NOW))
    for table in (one, many):
        table.upsert(first, order=order(), stamp="s")
    before = files(folder + "-many")
    for i, batch in enumerate(stamps):
        items = [(k, f"{k}{i}", NOW, None if s is None else NOW + dt.timedelta(hours=s)) for k, s in batch] + [("l1", f"late{i}", NOW, NOW - dt.timedelta(days=1))]
        df = spark.createDataFrame([(k, t, d, NOW, s) for k, t, d, s in items], COLUMNS + ", s timestamp")
        one.upsert(df, order=order(), stamp="s")
        many.append(df, order=order(), stamp="s")
        assert stored(spark, folder + "-many") == stored(spark, folder + "-one")
    # No part is written again until the batches outgrow the table, or another change needs them.
    assert files(folder + "-many") == before
    extra = rows(spark, ("e", "x", None)).withColumns({"collected_at": F.lit(None).cast("timestamp"), "extra": F.lit(1)})
    many.append(extra, order=order())
    one.upsert(extra, order=order())
    many.compact()
    assert stored(spark, folder + "-many") == stored(spark, folder + "-one") and "extra" in many.read().columns
    assert tables.list_names(spark, f"{folder}-many/pending") and not many._pending()
    many.append(rows(spark, *[(f"n{i}", "new", NOW) for i in range(100)]), order=order())
    assert sum(n for _, n in many.parts().values()) == 125 and len(stored(spark, folder + "-many")) == 125
    many.append(rows(spark, ("a", "last", None)), order=order())
    assert many.delete_older_than(as_of=NOW, keep_days=1) == 6 and stored(spark, folder + "-many")["a"] == "last"
    with pytest.raises(Exception, match="link is NULL"):
        many.append(rows(spark, (None, "3", NOW)), order=order())
    assert PartedTable(spark, folder + "-many").read().count() == 119


def test_retention_drops_whole_days(spark, folder):
    table = PartedTable(spark, folder, buckets=2)
    noon = dt.datetime(2026, 4, 14, 12)
    many = [(f"l{i}", "x", noon - dt.timedelta(hours=6 * i)) for i in range(80)]
    undated = rows(spark, ("none", "x", None)).withColumn("collected_at", F.lit(None).cast("timestamp"))
    table.upsert(rows(spark, *many).unionByName(undated), order=order())
    before = files(folder)
    removed = table.delete_older_than(as_of=noon, keep_days=10)
    left = {link for link, _, time in many if time >= noon - dt.timedelta(days=10)} | {"none"}
    assert removed == 81 - len(left) and set(stored(spark, folder)) == left
    # Only the day of the limit has new files.
    new = set(files(folder)) - set(before)
    assert new and all("/day=2026-04-04/" in f for f in new)
    assert {k[0] for k, v in table.parts().items() if v[0] == 2} == {"2026-04-04"}
    # A key of a dropped day comes back as a new row.
    table.upsert(rows(spark, ("l79", "again", noon)), order=order())
    assert stored(spark, folder)["l79"] == "again" and len(stored(spark, folder)) == len(left) + 1
    assert table.delete_older_than(as_of=noon, keep_days=10) == 0


def test_merge_keeps_one_row_per_key_before_the_shuffle(spark):
    batch = rows(spark, ("a", "1", NOW), ("a", "2", NOW))
    plan = tables.newest_per_key(batch, "link", F.col("title"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_snapshots(spark, folder):
    assert tables.latest_snapshot(spark, folder) is None
    for day, title in ((dt.date(2026, 1, 1), "old"), (dt.date(2026, 2, 1), "new")):
        tables.write_snapshot(rows(spark, ("a", title, NOW)), folder, day)
    rows(spark, ("a", "odd", NOW)).write.parquet(f"{folder}/snapshot_date=2026-13-99")
    rows(spark, ("a", "odd", NOW)).write.parquet(f"{folder}/other")
    assert tables.latest_snapshot(spark, folder).first().title == "new"
    assert tables.read_with_fallback(spark, folder + "-none", folder).first().title == "new"
    assert tables.drop_expired_folders(spark, folder, today=dt.date(2026, 2, 10), keep_days=20) == 1
    assert tables.list_names(spark, folder) == ["other", "snapshot_date=2026-02-01", "snapshot_date=2026-13-99"]


def test_snapshots_of_many_days_in_one_job(spark, folder):
    tables.write_snapshot(rows(spark, ("a", "kept", NOW)), folder, dt.date(2026, 1, 1))
    tables.write_snapshot(rows(spark, ("a", "replaced", NOW)), folder, dt.date(2026, 1, 2))
    days = [(t, d) for t, d in (("b", 2), ("c", 3), ("d", 3)) for _ in range(2)] + [("none", None)]
    dated = spark.createDataFrame([(t, d and dt.date(2026, 1, d)) for t, d in days], "title string, day date")
    tables.write_snapshots(dated, folder, "day")
    found = tables.snapshot_days(spark, folder)
    assert sorted(d.day for d in found) == [1, 2, 3]
    titles = {d.day: sorted(r.title for r in spark.read.parquet(f).collect()) for d, f in found.items()}
    assert titles == {1: ["kept"], 2: ["b", "b"], 3: ["c", "c", "d", "d"]}
    assert tables.list_names(spark, folder) == [f"snapshot_date=2026-01-0{n}" for n in (1, 2, 3)]
    tables.write_snapshots(dated.where("false"), folder + "-none", "day")
    assert tables.latest_snapshot(spark, folder + "-none") is None


def test_raw_log(spark, folder):
    article = rows(spark, ("a", "한글 제목", NOW), ("b", "B", None)).withColumns(
        {"summary": F.lit("s"), "source": F.lit("A/B"), "category": F.lit("c")}
    )
    raw_log.log_articles(article, folder, logged_at=NOW, run_id="r1")
    raw_log.log_articles(article, folder, logged_at=NOW, run_id="r1")
    raw_log.log_articles(article, folder, logged_at=NOW, run_id="r2")
    raw_log.log_articles(article, folder, logged_at=NOW)
    logged = raw_log.read_raw(spark, folder)
    assert logged.count() == 6
    first = logged.where("link = 'a' and run_id = 'r1'").first()
    assert (first.title, first.source, first.log_date) == ("한글 제목", "A/B", "2026-04-14")
    assert first.published.startswith("2026-04-14T00:00:00")


def payload(spark, kind, text, config=None):
    return spark.createDataFrame(
        [("S", kind, "c", text, config or {})], "source string, type string, category string, payload string, config map<string,string>"
    )


def test_rss(spark):
    text = (
        "<rss><channel>"
        "<item><title>A &amp;amp; B</title><link>https://x/1</link><description>d &lt;p&gt;</description>"
        "<pubDate>Tue, 04 Aug 2026 10:00:00 GMT</pubDate></item>"
        "<item><title>(no title)</title><link>https://x/2</link></item>"
        "<item><title>No link</title></item>"
        "<item><title>Only title</title><link>https://x/3</link></item>"
        "<item><title>Beyond</title><link>https://x/4</link></item></channel></rss>"
    )
    got = feeds.rss_rows(payload(spark, "rss", text), limit=4).orderBy("position").collect()
    assert [(r.title, r.link, r.summary) for r in got] == [
        ("A & B", "https://x/1", "d <p>"), ("Only title", "https://x/3", "Only title")
    ]


def test_works_of_a_citation_source_have_no_date(spark):
    text = (
        '{"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/a", "display_name": "T",'
        ' "publication_year": 2020, "publication_date": "2020-02-03", "cited_by_count": 12}, {"display_name": "no link"}]}'
    )
    row = feeds.works_rows(payload(spark, "openalex", text, {"event_model": "citation_snapshot"}), limit=5).collect()
    assert len(row) == 1 and row[0].published is None
    assert row[0].summary == (
        "DOI: https://doi.org/10.1/a. Citation count: 12. Publication date: 2020-02-03. OpenAlex ID: https://openalex.org/W1"
    )
    dated = feeds.works_rows(payload(spark, "openalex", text), limit=5).select(F.to_date("published").cast("string"))
    assert dated.first()[0] == "2020-02-03"


def test_registry_dates(spark):
    text = (
        '{"items": [{"title": ["A"], "DOI": "10.1/a", "published": {"date-parts": [[2020, 5]]}},'
        ' {"title": ["B"], "DOI": "10.1/b", "published": {"date-parts": [[2020, 15, 1]]}}, {"title": [], "DOI": "10.1/c"}]}'
    )
    got = feeds.registry_rows(payload(spark, "crossref", text), limit=5).orderBy("position")
    assert [r[0] for r in got.select(F.to_date("published").cast("string")).collect()] == ["2020-05-01", None]


def test_bad_payloads_become_errors(spark):
    bad = payload(spark, "rss", "<rss><channel>").unionByName(payload(spark, "crossref", "{oops")).unionByName(
        payload(spark, "gopher", "x")
    ).unionByName(payload(spark, "rss", "<rss><channel><item><title>T</title><link>https://x</link></item></channel></rss>"))
    rows_, errors = feeds.normalise_feeds(bad)
    assert rows_.count() == 1
    assert sorted(r.message for r in errors.collect()) == [
        "S: Failed to parse payload", "S: Failed to parse payload", "S: Unsupported source type 'gopher'"
    ]
