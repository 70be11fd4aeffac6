"""Operators on small tables with known results."""

from __future__ import annotations

import datetime as dt
import itertools
import os
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazette.functions.text import SPACE
from gazette.operators import duplicates, graph, quality_checks, recency, search, source_health, summary, tagging, validation
from gazette.operators.read_only_sql import REFUSED, REFUSED_CALL, read_only_sql
from gazette.operators.signals import build_events, with_identifiers
from gazette.plans.ingest_run import collect_articles
from gazette.plans.quality_report import quality_report, write_report
from gazette.sources.search_index import SearchIndex, _term_counts
from gazette.sources.config import category_from, keywords_of, quality_settings, sources_table

ARTICLE = "link string, title string, summary string, published timestamp, source string, category string, collected_at timestamp"


def plan_of(rows):
    return rows._jdf.queryExecution().toString()


def article(spark, **values):
    row = {
        "link": "https://example.com/a", "title": "A title", "summary": "Text.", "published": dt.datetime(2026, 4, 13),
        "source": "Feed", "category": "research", "collected_at": dt.datetime(2026, 4, 13, 12),
    } | values
    names = [f.split()[0] for f in ARTICLE.split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names)], ARTICLE)


def tags(spark, title, entities, summary="", **options):
    rows = tagging.tag_articles(article(spark, title=title, summary=summary), keywords_of(entities), **options)
    return rows.first()["matched_entities"]


def test_joined_tagging_carries_no_text_with_words(spark):
    """Only key and word meet the dictionary; rows of a key share their hits, rows without a key have none."""
    rows = [("k", "ai and cloud", "x"), ("k", "ai 인공지능", ""), (None, "ai", ""), ("m", None, "cloud of rain")]
    words = [{"name": "e", "keywords": ["ai", "cloud of", "인공지능", "--"]}]
    tagged = tagging.tag_articles(spark.createDataFrame(rows, "link string, title string, summary string"), keywords_of(words), plan=tagging.JOINED)
    got = sorted((r.link or "", r.title or "", r.matched_entities) for r in tagged.collect())
    both = {"e": ["ai", "ai", "인공지능"]}
    assert got == [("", "ai", {}), ("k", "ai and cloud", both), ("k", "ai 인공지능", both), ("m", "", {"e": ["cloud of"]})]
    carried = re.findall(r"Generate explode\(array_distinct.*?\), \[([^\]]*)\]", tagged._jdf.queryExecution().executedPlan().toString())
    assert carried and all(re.fullmatch(r"link#\d+", c) for c in carried)


@pytest.mark.parametrize("plan", [tagging.ROW_LOCAL, tagging.JOINED])
def test_tagging(spark, plan):
    topic = [{"name": "topic", "keywords": ["AI", "cloud", "", "ai"]}, {"name": "lang", "keywords": ["python"]}]
    assert tags(spark, "Ai and CLOUD", topic, plan=plan) == {"topic": ["ai", "cloud", "ai"]}
    assert tags(spark, "Wooden chair", topic, plan=plan) == {}
    assert tags(spark, "AI를 쓰다", topic, plan=plan) == {}
    assert tags(spark, "x", topic, "in Python", plan=plan) == {"lang": ["python"]}
    assert tags(spark, "인공지능연구", [{"name": "t", "keywords": ["인공지능"]}], plan=plan) == {"t": ["인공지능"]}
    assert tags(spark, "t", [], plan=plan) == {}
    odd = [{"name": "t", "keywords": ["c++", "continuous batching", "transformers.js", ".net"]}]
    assert tags(spark, "c++ c++11 a.net continuous  batching", odd, plan=plan) == {"t": ["c++", ".net"]}
    assert tags(spark, "Continuous batching in Transformers.js", odd, plan=plan) == {
        "t": ["continuous batching", "transformers.js"]
    }


def test_tagging_equals_one_pattern_per_keyword(spark):
    rng = random.Random(7)
    alphabet = ["ai", "AI", "é", "a", "b", "_", "-", ".", " ", " ", "x1", "ção", "\n", "of", "the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(25)) for _ in range(400)]
    words = ["ai", "a", "of the", "a-b", "x1", "the", "b.a", "ção", "-a", "a_b", "of"]
    rows = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)], "link string, title string, summary string")
    for plan in (tagging.ROW_LOCAL, tagging.JOINED):
        got = tagging.tag_articles(rows, keywords_of([{"name": "e", "keywords": words}]), plan=plan)
        found = {r.link: r.matched_entities.get("e", []) for r in got.collect()}
        for i, t in enumerate(texts):
            text = f"{t}\n"
            want = [
                w for w in words
                if (re.search(rf"\b{re.escape(w)}\b", text, re.IGNORECASE) if w.isascii() else w in text.lower())
            ]
            assert found[str(i)] == want, (t, limit)


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ({}, []),
        ({"title": None}, ["title is missing or not a string"]),
        ({"title": " \t"}, ["title is empty"]),
        ({"link": "no url"}, ["link has invalid URL format: no url"]),
        ({"summary": "", "source": None, "category": ""}, [
            "summary is missing or not a string", "source is missing or not a string", "category is missing or not a string"]),
        ({"summary": "  ", "published": None}, ["summary is empty"]),
    ],
)
def test_validation(spark, values, want):
    rows = article(spark, **values)
    assert validation.with_messages(rows).first()["messages"] == want
    assert validation.valid_rows(rows).count() == (0 if want else 1)
    assert validation.error_rows(rows).count() == (1 if want else 0)


def test_blank_texts_are_told_without_reading_them_through(spark):
    texts = ["", " ", "\t\n\x1c\x1f", "\u2003\u0085\u00a0", "a", "  b ", "\u200b", "😀", "- ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, title string")
    removed = F.regexp_replace("title", SPACE, "") == ""
    shown = rows.select("i", validation._is_blank(F.col("title")).alias("blank"), removed.alias("removed")).collect()
    assert [r.blank for r in shown] == [r.removed for r in shown]
    assert "regexp_replace(summary" not in plan_of(validation.valid_rows(article(spark)))


def test_articles_and_payloads_stay_where_they_are_to_meet_their_source(spark):
    category = category_from({"sources": [{"name": "Feed", "type": "rss", "config": {"a": 1}, "info_purpose": ["paper_release"]}, {"name": "Off", "enabled": False}]})
    sources = sources_table(spark, category.sources)
    assert [(r.name, r.enabled, r.info_purpose, r.config) for r in sources.collect()] == [("Feed", True, ["paper_release"], {"a": "1"}), ("Off", False, [], {})]
    assert sources_table(spark, []).count() == 0 and sources_table(spark, []).schema == sources.schema
    payloads = spark.createDataFrame([("Feed", "research", "<rss/>")], "source string, category string, payload string")
    rows, _ = collect_articles(payloads, summary.select_sources(sources, sources.select("name").limit(0)))
    for joined in (rows, build_events(article(spark), sources, category.quality)):
        assert "SortMergeJoin" not in plan_of(joined) and "hashpartitioning" not in plan_of(joined)


def pairs_of(rows):
    return {tuple(sorted(((r.left_title, r.left_link), (r.right_title, r.right_link)))) for r in rows.collect()}


def test_fuzzy_duplicates_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    stems = ["attention is all you need", "a survey of large models", "on the théorie of graphs", ""]
    data = []
    for i in range(160):
        title = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            if title:
                title[rng.randrange(len(title))] = rng.choice("abc xyz")
        host = rng.choice(["a.org", "b.org"])
        data.append((f"https://{host}/paper/{rng.randint(1, 30)}", "".join(title), ""))
    rows = spark.createDataFrame(data, "link string, title string, summary string")
    keyed = duplicates.with_duplicate_keys(rows).groupBy("norm_title", "authority", "path").agg(F.min("link").alias("id"))
    reps = sorted((r.id, r.norm_title, r.path, r.authority) for r in keyed.collect())
    want = set()
    for i, a in enumerate(reps):
        for b in reps[i + 1:]:
            if a[3] != b[3] or SequenceMatcher(None, a[1], b[1]).ratio() < 0.85:
                continue
            if a[2] == b[2] or SequenceMatcher(None, a[2], b[2]).ratio() >= 0.8:
                want.add(tuple(sorted(((a[1], a[0]), (b[1], b[0])))))
    assert want
    assert pairs_of(duplicates.fuzzy_duplicates(rows)) == want
    monkeypatch.setattr(duplicates, "BLOCK", 3)
    assert pairs_of(duplicates.fuzzy_duplicates(rows)) == want


def test_only_similar_texts_leave_the_comparison(spark, monkeypatch):
    rng = random.Random(11)
    words = ["the", "of", "ation", "ing", "and", "ther", "é", "日本"]
    texts = {"", "a"} | {" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)}
    texts |= {t[: len(t) // 2] + rng.choice("xyz") + t[len(t) // 2 :] for t in sorted(texts)}
    texts = sorted(texts)
    rows = spark.createDataFrame([(i, "a.org", t) for i, t in enumerate(texts)], "row long, host string, text string")
    want = {
        (a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
        if SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.85
    }
    assert len(want) > 40
    for block, tile, columns in ((4096, 128, 2048), (7, 3, 2)):
        monkeypatch.setattr(duplicates, "BLOCK", block)
        monkeypatch.setattr(duplicates, "TILE", tile)
        monkeypatch.setattr(duplicates, "COLUMNS", columns)
        got = [(r.a_row, r.b_row) for r in duplicates._similar(rows, "text", 0.85, within="host").collect()]
        assert sorted(got) == sorted(want)


def test_common_subsequences_and_ratios_of_short_texts():
    rng = random.Random(4)
    texts = ["", "a", "x" * 64, "\0a\0", "日本語" * 21] + ["".join(rng.choice("ab/é1") for _ in range(rng.randint(0, 64))) for _ in range(40)]
    counts = duplicates._Counts(np.arange(len(texts)), texts)
    u, v = (x.ravel() for x in np.indices((len(texts), len(texts))))
    got, compare = duplicates._short_common(counts, counts, u, v), duplicates._Ratios()
    for i, j, n in zip(u.tolist(), v.tolist(), got.tolist()):
        a, b = counts.texts[i], counts.texts[j]
        above = [0] * (len(b) + 1)
        for c in a:
            row = [0]
            for k, d in enumerate(b):
                row.append(above[k] + 1 if c == d else max(above[k + 1], row[k]))
            above = row
        assert n == above[-1] == duplicates._common_subsequence(duplicates._places(a), len(a), b)
        assert compare(a, b) == SequenceMatcher(None, a, b).ratio()
    assert compare("/en/123", "/en/132") == compare("/de/745", "/de/754")
    assert len([k for k in compare.known if k == (7, bytes([0, 1, 2, 0, 3, 4, 5, 0, 1, 2, 0, 3, 5, 4]))]) == 1


def test_long_texts_are_compared_many_at_a_time(monkeypatch):
    rng = random.Random(12)
    words = ["the", "of", "ation", "ing", "and", "ther", "é", "日本", "on", "re"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(150)]
    texts = sorted({*texts, *[t[:90] + "x" + t[92:] for t in texts[:40]], "a" * 130, "a" * 128 + "b"})
    want = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.85]
    assert len(want) > 30
    single, n = [], len(texts)
    common = duplicates._common_subsequence
    monkeypatch.setattr(duplicates, "_common_subsequence", lambda *a: single.append(a) or common(*a))
    rows = pa.table({"side": [0] * n, "row": list(range(n)), "text": texts, "within": ["a.org"] * n})
    for _ in range(2):
        got = duplicates._compared(0.85, False)(rows).to_pydict()
        assert sorted(zip(got["a_row"], got["b_row"])) == want
        assert len(single) < 500
        monkeypatch.setattr(duplicates, "WORDS", 1)
        monkeypatch.setattr(duplicates, "TABLE", 1)
    counts = duplicates._Counts(np.arange(n), texts)
    u, v = (x.ravel() for x in np.indices((n, n)))
    exact = np.array([common(duplicates._places(counts.texts[i]), len(counts.texts[i]), counts.texts[j]) for i, j in zip(u.tolist(), v.tolist())])
    assert (duplicates._short_common(counts, counts, u, v) == exact).all()
    least = np.array([rng.choice([n - 3, n, n + 1, n + 9]) for n in exact.tolist()])
    got = duplicates._Common(counts, counts)(u, v, least)
    assert (got[least <= exact] == exact[least <= exact]).all() and (got < least)[least > exact].all()
    some = [i for i in range(len(u)) if i % 401 == 0]
    assert all((common(duplicates._places(counts.texts[u[i]]), int(counts.n[u[i]]), counts.texts[v[i]], int(least[i])) >= least[i]) == (exact[i] >= least[i]) for i in some)


def test_only_paths_that_may_be_similar_are_rated(monkeypatch):
    rng = random.Random(13)
    texts = ["", "/a", "/" + "long/" * 900, "/" + "long/" * 900 + "x"] + [f"/{rng.choice(['en', 'fr'])}/{rng.randint(1, 4000)}" for _ in range(120)]
    left, right = zip(*[(a, b) for a in texts for b in texts])
    rows = pa.record_batch({"left_path": left, "right_path": right, "row": list(range(len(left)))})
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]
    rated = []
    monkeypatch.setattr(duplicates, "_ratio", lambda a, b: rated.append((a, b)) or SequenceMatcher(None, a, b).ratio())
    for threshold in (0.8, 1.5):
        (got,) = duplicates._with_similar_paths(threshold)(iter([rows]))
        assert got.column_names == ["row", "path_ratio"]
        assert list(zip(*got.to_pydict().values())) == [(i, r) for i, (a, b, r) in enumerate(zip(left, right, want)) if r >= threshold or a == b]
    assert len(rated) < len(want) / 20


def test_a_title_on_many_paths_is_compared_once(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "MEMBERS", 4)
    titles = ["attention is all you need", "attention is all you needed", "graphs"]
    links = [(f"https://a.org/paper/{i}", titles[i % 3]) for i in range(40)]
    rows = spark.createDataFrame([(u, t, "") for u, t in links], "link string, title string, summary string")
    compared = []
    similar = duplicates._similar
    monkeypatch.setattr(duplicates, "_similar", lambda rows, *a, **b: compared.append(rows.count()) or similar(rows, *a, **b))
    got = sorted((r.left_link, r.right_link) for r in duplicates.fuzzy_duplicates(rows).collect())
    want = sorted(
        tuple(sorted((u, v))) for i, (u, t) in enumerate(links) for v, s in links[i + 1:]
        if (t == "graphs") == (s == "graphs") and SequenceMatcher(None, u[13:], v[13:]).ratio() >= 0.8
    )
    assert got == want
    assert compared == [3]


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.95])
def test_similar_urls_equal_all_pairs(spark, threshold):
    rng = random.Random(5)
    links = sorted({f"https://x.org/{rng.choice(['en', 'fr'])}/{rng.randint(1, 400)}" for _ in range(80)} | {"https://x.org", "https://x.org/a", "https://x.org/b", "https://x.org/ab", "https://x.org/ba"})
    rows = spark.createDataFrame([(u,) for u in links], "url string")
    got = {(r.left_url, r.right_url) for r in duplicates.similar_urls(rows, "url", threshold=threshold).collect()}
    paths = {u: u.removeprefix("https://x.org") for u in links}
    want = {
        (a, b) for i, a in enumerate(links) for b in links[i + 1:]
        if SequenceMatcher(None, paths[a], paths[b]).ratio() >= threshold
    }
    assert got == want


SETTINGS = {
    "data_quality": {
        "quality_outputs": {"tracked_event_models": ["paper_release", "code_repository", "benchmark_result", "citation_snapshot"]},
        "freshness_sla": {"citation_snapshot_days": 14, "paper_release_hours": 24},
        "event_models": {
            "paper_release": {"required_fields": ["paper_id", "title", "source_url", "doi"]},
            "benchmark_result": {"required_fields": ["benchmark_name", "metric_name", "metric_value"]},
        },
    },
    "source_backlog": {"operational_candidates": [{"name": "Later", "signal_type": "x", "activation_gate": "gate"}]},
}


def report(spark, articles, sources, folder, as_of=dt.datetime(2026, 4, 14), errors=None):
    table = sources_table(spark, sources)
    return quality_report(articles, table, quality_settings(SETTINGS), as_of=as_of, events_folder=folder, errors=errors)


def test_report_counts_rows_of_every_section(spark, folder):
    """Two papers and a repository of one source each, a score without its metric, and sources in every state."""
    sources = [
        {"name": "Left", "type": "rss", "content_type": "preprint"},
        {"name": "Right", "type": "rss", "content_type": "preprint"},
        {"name": "Forge", "type": "rss", "config": {"event_model": "code_repository"}},
        {"name": "Scores", "type": "rss", "config": {"event_model": "benchmark_result"}},
        {"name": "Closed", "type": "rss", "enabled": False, "content_type": "preprint", "config": {"skip_reason": "shut"}},
    ]
    parts = [
        article(spark, source="Left", link="https://left.test/7", summary="DOI: 10.5555/Quartz.7. Citation count: 3,210"),
        article(spark, source="Right", link="https://right.test/8", summary="arXiv: 2211.00042v3 Announce"),
        article(spark, source="Forge", link="https://forge.test/9", summary="DOI: 10.5555/quartz.7 Repository: github.com/basalt/gneiss."),
        article(spark, source="Scores", link="https://scores.test/1", summary="Benchmark: Strata-12. Metric value: 17"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    errors = spark.createDataFrame([("Forge: 503",), ("Forge: again",), ("Forged: no",)], "message string")
    tables = report(spark, rows, sources, folder, errors=errors)
    events = {r.url: r for r in tables["events"].collect()}
    assert events["https://left.test/7"].canonical_key == "paper:doi:10.5555-quartz.7"
    assert events["https://left.test/7"].citation_count == 3210
    assert events["https://right.test/8"].canonical_key == "paper:arxiv:2211.00042v3"
    assert events["https://forge.test/9"].canonical_key == "repository:github.com:basalt:gneiss:paper:doi-10.5555-quartz.7"
    assert events["https://scores.test/1"].required_field_gaps
    status = {r.source: (r.status, r.error_count) for r in tables["sources"].collect()}
    assert status["Closed"] == ("skipped_disabled", 0) and status["Forge"] == ("fresh", 2) and status["Left"] == ("fresh", 0)
    assert [r.reason for r in tables["review"].collect()][0] == "missing_required_fields"
    summary_row = tables["summary"].first()
    assert summary_row.research_signal_event_count == 4 and summary_row.citation_count_present_count == 1
    places = write_report(tables, folder + "-report", as_of=dt.datetime(2026, 4, 14))
    assert spark.read.json(places["latest"] + "/events").count() == 4


def test_citation_snapshots_age_by_collection(spark, folder):
    source = {"name": "Cites", "type": "openalex", "config": {"event_model": "citation_snapshot"}}
    row = article(
        spark, source="Cites", link="https://doi.org/10.5555/agate.31", summary="DOI: 10.5555/agate.31. Citation count: 1,234.",
        published=dt.datetime(2020, 1, 1), collected_at=dt.datetime(2026, 4, 22),
    )
    tables = report(spark, row, [source], folder, as_of=dt.datetime(2026, 4, 23))
    assert tables["sources"].first().status == "fresh"
    assert tables["sources"].first().age_days == 1.0
    assert tables["events"].first().citation_count == 1234


def test_stale_source_and_title_proxy(spark, folder):
    source = {"name": "Posts", "type": "rss", "config": {"event_model": "paper_release"}}
    row = article(spark, source="Posts", title="", link="https://example.com/u", published=dt.datetime(2026, 4, 1))
    tables = report(spark, row, [source], folder)
    event = tables["events"].first()
    assert event.canonical_key_status == "title_proxy"
    assert event.required_field_gaps == ["title", "doi"]
    assert event.canonical_key.startswith("paper:title:u-")
    assert tables["sources"].first().status == "stale"
    reasons = [r.reason for r in tables["review"].collect()]
    assert reasons[:3] == ["missing_required_fields", "title_proxy_canonical_key", "source_stale"]


def test_unknown_sources_give_no_events(spark):
    events = build_events(article(spark, source="?"), sources_table(spark, [{"name": "A"}]), quality_settings({}))
    assert events.count() == 0


def test_rollup_groups_before_the_shuffle(spark):
    rows = article(spark, source="A")
    events = build_events(rows, sources_table(spark, [{"name": "A", "content_type": "preprint"}]), quality_settings({}))
    plan = source_health.event_rollup(events)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "WindowGroupLimit" in plan
    assert "SortAggregate" not in plan and "CartesianProduct" not in plan


def test_latest_event_on_ties_and_without_dates(spark):
    one, two = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    data = [("a", "u2", "k", two), ("a", "u1", "z", two), ("a", "u1", "b", two), ("a", "u0", "k", one), ("b", "u9", "k", None), ("b", "u8", "k", None),
            ("c", "u1", "k", None), ("c", "u2", "k", one)]
    events = spark.createDataFrame(data, "source string, url string, event_key string, event_at timestamp").selectExpr(
        "*", "'paper_release' AS event_model", "event_key AS title", "'' AS required_field_proxy", "'paper:x' AS canonical_key", "'x' AS canonical_key_status",
        "array('doi') AS required_field_gaps", "cast(null AS bigint) AS citation_count", "'' AS repository", "'' AS benchmark_name", "'' AS metric_name", "'' AS metric_value",
    ).repartition(4)
    got = {r.source: (r.latest.url, r.latest.title, r.latest.event_at, r.event_count, r.field_gaps) for r in source_health.event_rollup(events).collect()}
    assert got == {"a": ("u1", "b", two, 4, 4), "b": ("u8", "k", None, 2, 2), "c": ("u2", "k", one, 2, 2)}


@pytest.mark.parametrize(
    ("query", "text", "days", "limit"),
    [
        ("지난 12일 서버 로그", "서버 로그", 12, None),
        ("최근 4주일간 색인", "색인", 28, None),
        ("지난 2개월 문서 비교", "문서 비교", 60, None),
        ("past 45 days shard layout", "shard layout", 45, None),
        ("문서 1234567개", "문서", None, 1234567),
        ("top 1234567 shards", "shards", None, 1234567),
        ("last 1234567 days of it", "of it", 1234567, None),
        ("  최근  6주  병합   계획  15개 ", "병합 계획", 42, 15),
        ("row groups", "row groups", None, None),
        ("", "", None, None),
    ],
)
def test_parse_queries(spark, query, text, days, limit):
    row = search.parse_queries(spark.createDataFrame([(query,)], "query string")).first()
    assert (row.search_text, row.days, row.max_results, row.category) == (text, days, limit, None)


def found(spark, documents, query, **options):
    rows = spark.createDataFrame(documents, "doc_key string, title string, abstract string, authors string")
    queries = spark.createDataFrame([(1, query)], "query_id int, query string")
    hits = search.search(search.postings(rows), queries, **options)
    return [r.doc_key for r in hits.orderBy("rank").collect()]


DOCS = [
    ("a", "Red wine", "the wine market of France", "Ann Ål"),
    ("b", "Beer", "the market for beer and red ale", "Bob"),
    ("c", "와인 시장", "보르도 와인", ""),
    ("d", "Winery", "no market", "Ann"),
]


SEARCHES = [
    ("wine", ["a"]),
    ("market red", ["a", "b"]),
    ("market AND red NOT beer", ["a"]),
    ("wine OR beer", ["a", "b"]),
    ("win*", ["a", "d"]),
    ('"red wine"', ["a"]),
    ('"wine red"', []),
    ('"the mark"*', ["b"]),
    ("title:red", ["a"]),
    ("authors:al", ["a"]),
    ("보르도", ["c"]),
    ("", []),
    ("NOT wine", []),
    ("market NOT red ale", ["a", "d"]),
    ("(wine OR beer) AND red", ["a", "b"]),
    ("wine OR (beer AND ann)", ["a"]),
    ("market NOT (red OR (ann NOT wine))", []),
    ("NEAR(market red, 3)", ["b"]),
    ("NEAR(the France, 3)", ["a"]),
    ("NEAR(the France, 2)", []),
    ('NEAR("the market" ale, 4) OR 보르도', ["b", "c"]),
    ("NEAR(market)", ["a", "b", "d"]),
    ("^the", ["a", "b"]),
    ("^market", []),
    ("{title authors}: ann", ["a", "d"]),
    ("- title: red", ["b"]),
    ("title: (red OR beer)", ["a", "b"]),
    ("red + wine", ["a"]),
    ('"..." wine', ["a"]),
    ("red-wine", []),
]


def test_search(spark):
    """All queries as one batch."""
    rows = spark.createDataFrame(DOCS, "doc_key string, title string, abstract string, authors string")
    queries = spark.createDataFrame(list(enumerate(q for q, _ in SEARCHES)), "query_id int, query string")
    hits = search.search(search.postings(rows), queries).orderBy("rank").collect()
    assert {q: [r.doc_key for r in hits if r.query_id == i] for i, (q, _) in enumerate(SEARCHES)} == dict(SEARCHES)


def test_search_limit_and_snippet(spark):
    assert found(spark, DOCS, "market", limit=2) == ["a", "b"]
    rows = spark.createDataFrame(DOCS, "doc_key string, title string, abstract string, authors string")
    queries = spark.createDataFrame([(1, "ale OR win*")], "query_id int, query string")
    hits = search.search(search.postings(rows), queries)
    shown = {r.doc_key: r.snippet for r in search.snippets(hits, search.postings(rows), rows, queries, words=4).collect()}
    assert shown == {"a": "Red <b>wine</b>", "b": "...beer and red <b>ale</b>", "d": "<b>Winery</b>"}
    queries = spark.createDataFrame([(1, '"red wine" OR market')], "query_id int, query string")
    hits = search.search(search.postings(rows), queries)
    shown = {r.doc_key: r.snippet for r in search.snippets(hits, search.postings(rows), rows, queries, words=3).collect()}
    assert shown == {"a": "<b>Red wine</b>", "b": "...<b>market</b> for beer...", "d": "no <b>market</b>"}


ERRORS = [
    ("wine AND", 'syntax error near ""'), ("(wine", 'syntax error near ""'), ("wine)", 'syntax error near ")"'), ("NOT wine", 'syntax error near "NOT"'),
    ("city: wine", "no such column: city"), ("red-wine", 'syntax error near "-"'), ("NEAR()", 'syntax error near ")"'), ("NEAR(a, x)", 'expected integer, got "x"'),
    ("(" * 5000 + "a" + ")" * 5000, "too many parentheses"), ("wine", None), ("", None), (None, None),
]


def test_query_errors(spark):
    queries = spark.createDataFrame(list(enumerate(q for q, _ in ERRORS)), "query_id int, query string")
    found = {r.query_id: r.error for r in search.query_errors(queries).collect()}
    assert found == {i: error for i, (_, error) in enumerate(ERRORS) if error}


def test_near_in_long_texts(spark):
    """Groups by brute force over all places, on random words."""
    rng = random.Random(5)
    docs = [(f"d{i:02}", "", " ".join(rng.choices("abcdx", weights=[1, 1, 1, 1, 8], k=60)), "") for i in range(40)]
    for words, distance in (("ab", 2), ("abc", 4), ("aa", 0), ("ddc", 1)):
        want = []
        for key, _, text, _ in docs:
            places = [[p for p, w in enumerate(text.split()) if w == word] for word in words]
            if any(max(c) - min(c) - 1 <= distance for c in itertools.product(*places)):
                want.append(key)
        assert found(spark, docs, f"NEAR({' '.join(words)}, {distance})") == want


def test_stored_index(spark, folder):
    """Two upserts, a delete and a compaction: searches and counts are those of an index built anew."""
    schema = "doc_key string, title string, abstract string, authors string"
    index = SearchIndex(spark, folder, parts=4)
    queries = spark.createDataFrame([(1, "red"), (2, "market NOT wine"), (3, "win*"), (4, '"red ale" OR 보르도')], "query_id int, query string")

    def same(docs):
        rows = spark.createDataFrame(docs, schema)
        posted = search.postings(rows)
        places = sorted(tuple(r)[:4] for r in index.postings().collect())
        assert places == sorted(map(tuple, posted.collect()))
        assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, search.postings_stats(posted).collect()))
        assert sorted(map(tuple, index.search(queries).collect())) == sorted(map(tuple, search.search(posted, queries).collect()))
        for some in (queries, queries.where("query_id = 1")):
            got = sorted(map(tuple, index.ranked(some).collect()))
            assert got == sorted(map(tuple, search.ranked_search(posted, search.document_lengths(rows), some).collect()))
        n, mean = index.corpus().first()
        assert (n or 0) == len(docs) and (not docs or mean == pytest.approx(posted.count() / len(docs)))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}

    same([])
    index.upsert(spark.createDataFrame(DOCS[:3] + [DOCS[0]], schema))
    same(DOCS[:3])
    before = {f: os.path.getmtime(f) for f in files()}
    newer = [("b", "Red red beer", "ale", "Bob"), DOCS[3], ("e", "", None, "")]
    index.upsert(spark.createDataFrame(newer, schema))
    assert before == {f: os.path.getmtime(f) for f in before}
    now = [DOCS[0], DOCS[2], newer[0], newer[1], newer[2]]
    same(now)
    index.delete(spark.createDataFrame([("a",), ("unknown",), (None,)], "doc_key string"))
    same(now[1:])
    index.upsert(spark.createDataFrame([DOCS[0]], schema))
    same(now)
    # A batch that did not end is not read.
    index._write(spark.createDataFrame([("z", 1, [("title", ["red"])], 0)], "doc_key string, length bigint, fields array<struct<field: string, words: array<string>>>, slot int"), "documents", 99, "slot")
    same(now)
    index.compact()
    assert len(index.batches()) == 1
    same(now)
    index.upsert(spark.createDataFrame([("c", "red", "", "")], schema))
    same([now[0], ("c", "red", "", ""), *now[2:]])


def test_a_large_slot_fills_several_files_sorted_by_term(spark, folder):
    rows = [(f"d{i}", f"t{i}", " ".join(f"w{(i * 31 + j) % 977}" for j in range(400)), "") for i in range(300)]
    index = SearchIndex(spark, folder, parts=1)
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        index.upsert(spark.createDataFrame(rows, "doc_key string, title string, abstract string, authors string"))
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len([f for f in os.listdir(f"{folder.removeprefix('file://')}/documents/batch=1/slot=0") if f.endswith(".parquet")]) > 1
    for name in os.listdir(f"{folder.removeprefix('file://')}/postings/batch=1/bucket=0"):
        if name.endswith(".parquet"):
            terms = [r.term for r in spark.read.parquet(f"{folder}/postings/batch=1/bucket=0/{name}").select("term").collect()]
            assert terms == sorted(terms)
    assert index.terms().agg(F.sum("occurrences")).first()[0] == 300 * 401
    assert index.corpus().first().n == 300


def test_term_counts_move_sums_only(spark):
    """Words of a document are counted where it lies, however often they stand there; a negative sign takes them off."""
    fields = [("title", ["b", "a", "b"]), ("abstract", ["b"]), ("authors", [])]
    rows = [("x", fields, 1), ("y", [("title", ["a", "c"])], 1), ("z", [("title", ["c", "c"])], -1), ("v", [], 1)]
    signed = spark.createDataFrame(rows, "doc_key string, fields array<struct<field: string, words: array<string>>>, sign int")
    counts = _term_counts(signed)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, counts.collect())) == [("a", 2, 2), ("b", 1, 3), ("c", 0, -1)]


def test_index_reads_only_the_parts_of_its_terms(spark, folder):
    index = SearchIndex(spark, folder, parts=8)
    index.upsert(spark.createDataFrame(DOCS, "doc_key string, title string, abstract string, authors string"))
    parsed = search.parse_batch(spark.createDataFrame([(1, "wine")], "query_id int, query string"))
    plan = index.postings(search.query_clauses(parsed))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan[plan.index("PartitionFilters") :][:200] and "GreaterThanOrEqual(term,wine)" in plan


def test_ranked_search_prefers_more_hits(spark):
    docs = [(f"d{i}", "x", "filler words here", "") for i in range(5)]
    docs += [("p", "wine", "wine wine", ""), ("q", "x", "one wine among many other long words in here", "")]
    rows = spark.createDataFrame(docs, "doc_key string, title string, abstract string, authors string")
    queries = spark.createDataFrame([(1, "wine")], "query_id int, query string")
    hits = search.ranked_search(search.postings(rows), search.document_lengths(rows), queries, limit=2000)
    assert [r.doc_key for r in hits.orderBy("rank").collect()] == ["p", "q"]


def test_read_only_sql(spark, folder):
    spark.range(3).createOrReplaceTempView("three")
    assert read_only_sql(spark, " select sum(id) AS s from three; ").first().s == 3
    assert read_only_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a").first().x == 1
    assert "Range" in read_only_sql(spark, "EXPLAIN SELECT * FROM three").first()[0]
    assert read_only_sql(spark, "DROP VIEW three").first().error == REFUSED
    call = "('java.lang.System', 'getProperty', 'user.dir')"
    spark.udf.register("own_code", lambda x: x, "string")
    try:
        for text in (
            f"SELECT reflect{call}", f"SELECT `java_method`{call}", f"SELECT reflect/**/{call}", f"SELECT try_reflect\n{call}",
            f"SELECT * FROM three WHERE EXISTS (SELECT 1 WHERE reflect/* */{call} = 'x')", f"WITH a AS (SELECT reflect {call} AS x) SELECT x FROM a",
            f"SELECT (SELECT `reflect` {call}) FROM three", f"SELECT transform(array(1), x -> java_method{call})", f"EXPLAIN SELECT reflect{call}",
            f"SELECT sum(1) OVER (ORDER BY reflect{call}) FROM three", "SELECT own_code('a')", "SELECT `own_code`/**/('a') FROM three",
        ):
            assert read_only_sql(spark, text).first().error == REFUSED_CALL, text
    finally:
        spark.sql("DROP TEMPORARY FUNCTION own_code")
    fine = "SELECT 'reflect(' AS a, percentile(id, 0.5), count(DISTINCT id), array_sort(collect_list(id)), map('a', 1)['a'], current_date(), rand() FROM three JOIN three USING (id) GROUP BY ROLLUP (id)"
    assert len(read_only_sql(spark, fine).collect()) == 4 and "error" not in read_only_sql(spark, fine).columns
    windows = "SELECT id, rank() OVER (ORDER BY id), explode(sequence(0, 1)) AS e, to_json(struct(id)), date_format(now(), 'yyyy'), split('a,b', ','), regexp_replace('a', 'a', 'b'), from_json('{}', 'a int') FROM three"
    assert len(read_only_sql(spark, windows).collect()) == 6
    assert read_only_sql(spark, "SELECT CAST('a' || id AS INT) FROM range(3)").first().error.startswith("Error: [CAST_INVALID")
    assert read_only_sql(spark, "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`").first().error.startswith("Error: ")
    spark.sql(f"CREATE TABLE guarded (x INT) USING parquet LOCATION '{folder}'")
    try:
        for text in (
            "WITH a AS (SELECT 1 AS x) INSERT INTO guarded SELECT * FROM a",
            "EXPLAIN INSERT INTO guarded VALUES (1)",
            "SELECT 1); INSERT INTO guarded VALUES (1); SELECT (2",
        ):
            assert read_only_sql(spark, text).first().error.startswith("Error: ")
        assert spark.table("guarded").count() == 0
    finally:
        spark.sql("DROP TABLE guarded")


def test_trends_count_keywords_and_skip_bad_json(spark):
    rows = spark.createDataFrame(
        [('{"Region": ["a", "b"]}',), ('{"Region": ["a"], "Roaster": ["c"], "Odd": "x"}',), ("{bad",), (None,)],
        "entities_json string",
    ).withColumn("collected_at", F.lit(dt.datetime(2026, 1, 1)))
    got = summary.top_trends(rows, as_of=dt.datetime(2026, 1, 2)).collect()
    assert [(r.entity, r.n) for r in got] == [("Region", 3), ("Roaster", 1)]
    assert summary.top_trends(rows, as_of=dt.datetime(2026, 1, 2), limit=0).count() == 0


def test_graph_keeps_the_first_24_names(spark):
    rows = spark.createDataFrame([([f"n{i:02d}" for i in range(30)],), (["n01", "n00", ""],), (["n00", "n00"],)], "authors array<string>")
    edges = graph.author_edges(rows)
    assert edges.count() == 24 * 23 // 2 + 1
    assert edges.where("left = 'n00' and right = 'n01'").first().weight == 2
    weights = {r.node: r.weight for r in graph.node_weights(edges).collect()}
    assert weights["n00"] == 23 + 1 + 1 and "n24" not in weights


def test_graph_keeps_all_names_without_a_limit(spark):
    rows = spark.createDataFrame([([f"n{i:02d}" for i in range(30)],)], "authors array<string>")
    assert graph.author_edges(rows, most=None).count() == 30 * 29 // 2
    assert graph.author_edges(rows, most=5).count() == 10
    tagged = rows.select(F.map_from_arrays("authors", "authors").alias("matched_entities"))
    assert graph.topic_edges(tagged, most=None).count() == 30 * 29 // 2


def test_long_titles_keep_their_keys_apart_without_a_limit(spark):
    titles = ["a" * 100 + end for end in "xy"]
    rows = article(spark, title=titles[0]).unionByName(article(spark, title=titles[1]))
    keys = [r.normalized_title for r in with_identifiers(rows, title_chars=None).collect()]
    assert sorted(keys) == titles
    assert {r.normalized_title for r in with_identifiers(rows).collect()} == {"a" * 96}


def test_lookup_takes_any_identifier(spark):
    papers = article(spark, summary="x" * 301).withColumns({"doi": F.lit("10.1/a"), "arxiv_id": F.lit(None).cast("string")})
    ids = spark.createDataFrame([("10.1/a",), (" https://example.com/a ",), ("none",), ("",)], "identifier string")
    rows = recency.lookup(papers, ids).collect()
    assert {r.identifier for r in rows} == {"10.1/a", "https://example.com/a"}
    assert {len(r.summary) for r in rows} == {303}


def test_missing_fields_of_an_empty_table(spark):
    empty = spark.createDataFrame([], ARTICLE)
    assert quality_checks.missing_fields(empty, {"title": "title IS NULL"}).count() == 0


def test_category_from_configuration(spark):
    category = category_from(
        {"category_name": "c", "sources": [{"name": "A", "config": {"freshness_sla_days": 3}}],
         "entities": [{"name": "E", "keywords": ["X", "", "x"]}], **SETTINGS}
    )
    assert [k.keyword for k in category.keywords] == ["x", "x"]
    assert category.quality.tracked_models[0] == "paper_release"
    assert category.quality.backlog[0]["name"] == "Later"
    assert sources_table(spark, category.sources).first().config == {"freshness_sla_days": "3"}
