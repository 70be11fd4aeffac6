"""Column functions on single values."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from gazette.functions import dates, identifiers, text, urls
from gazette.functions.labelled import field, labelled_fields


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function("v").alias("r")).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("  Two   Words ", "two words"),
        ("Release (Second)!", "release second"),
        ("state-of-the-art", "state-of-the-art"),
        ("Été – l'année", "été lannée"),
        ("!!!", ""),
        (None, ""),
    ],
)
def test_normalise_title(spark, value, want):
    assert one(spark, value, text.normalise_title) == want


@pytest.mark.parametrize(
    ("value", "want"), [("A b/C", "a-b-c"), ("x..y_z", "x..y_z"), ("--Q--", "q"), ("10.1/AbC", "10.1-abc")]
)
def test_slug(spark, value, want):
    assert one(spark, value, text.slug) == want


def test_slug_of_other_scripts_is_a_digest(spark):
    digest = hashlib.sha1("논문".encode()).hexdigest()[:12]
    assert one(spark, "논문", text.slug) == f"u-{digest}"
    empty = hashlib.sha1(b"").hexdigest()[:12]
    assert one(spark, None, text.slug) == f"u-{empty}"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("a &amp; b", "a & b"),
        ("&amp;lt;", "&lt;"),
        ("&lt;b&gt; &#233; &#xe9; &eacute;", "<b> é é é"),
        ("&nosuch; & AT&T; &#99999999;", "&nosuch; & AT&T; &#99999999;"),
        ("&#128512;", "😀"),
        ("plain", "plain"),
    ],
)
def test_unescape(spark, value, want):
    assert one(spark, value, text.unescape_html) == want


def test_search_tokens(spark):
    assert one(spark, "Élan_vital, x2!", text.search_tokens) == ["elan", "vital", "x2"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("https://example.com/a", True),
        ("ftp://files.example.com", True),
        ("https://example.com:8080/a b", True),
        ("example.com/a", False),
        ("https://", False),
        ("mailto:someone@example.com", False),
        ("", False),
        (None, False),
    ],
)
def test_valid_url(spark, value, want):
    assert one(spark, value, urls.is_valid_url) is want


def test_split_url(spark):
    row = spark.createDataFrame([("HTTPS://Host:80/p/q;v=1?x#y",)], "v string")
    parts = urls.split_url("v")
    assert tuple(row.select(*parts).first()) == ("https", "Host:80", "/p/q")


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Tue, 04 Aug 2026 10:00:00 GMT", dt.datetime(2026, 8, 4, 10)),
        ("04 Aug 2026 10:00:00 +0200", dt.datetime(2026, 8, 4, 8)),
        ("Tue, 4 Aug 2026 10:00:00 EST", dt.datetime(2026, 8, 4, 15)),
        ("2026-08-04T10:00:00Z", dt.datetime(2026, 8, 4, 10)),
        ("soon", None),
    ],
)
def test_feed_timestamp(spark, value, want):
    def shown(c):
        return F.date_format(dates.feed_timestamp(c), "yyyy-MM-dd HH:mm:ss")

    assert one(spark, value, shown) == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize(
    ("value", "want"),
    [("2026-01-02", "2026-01-02"), ("2026-01-02T23:00:00-02:00", "2026-01-03"), ("2026-01-02 about", "2026-01-02"), ("x", None)],
)
def test_coerce_date(spark, value, want):
    assert one(spark, value, lambda c: dates.coerce_date(c).cast("string")) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("arXiv:2401.00001v2.pdf", "2401.00001v2"),
        ("2604.09554v1 Announce Type: new", "2604.09554v1"),
        ("cs.AI/0101001", "cs.AI/0101001"),
        (" other. ", "other"),
    ],
)
def test_clean_arxiv_id(spark, value, want):
    assert one(spark, value, identifiers.clean_arxiv_id) == want


def test_clean_doi(spark):
    assert one(spark, "https://doi.org/10.1/ABC.", identifiers.clean_doi) == "10.1/abc"
    assert one(spark, "doi:10.1/x;", identifiers.clean_doi) == "10.1/x"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("github.com/o/n.git", "github.com/o/n"),
        ("'https://GitLab.com/o/n/tree/x').", "gitlab.com/o/n"),
        ("o/n", "o/n"),
        ("just words", "just words"),
    ],
)
def test_repository_text(spark, value, want):
    assert one(spark, value, lambda c: identifiers.shortened_repository(identifiers.trimmed_repository(c))) == want


def fields_of(spark, title, summary, *labels):
    rows = spark.createDataFrame([(title, summary)], "title string, summary string")
    rows = rows.withColumn("f", labelled_fields("title", "summary"))
    return rows.select(field("f", *labels)).first()[0]


def test_labelled_fields_end_at_the_next_label(spark):
    text = "Benchmark: MMLU. Metric name: accuracy. Metric value: 92.5. Dataset = big set;"
    assert fields_of(spark, "t", text, "Benchmark", "Benchmark name") == "MMLU"
    assert fields_of(spark, "t", text, "Metric", "Metric name", "Score") == "accuracy"
    assert fields_of(spark, "t", text, "Metric value", "Score") == "92.5"
    assert fields_of(spark, "t", text, "dataset") == "big set"
    assert fields_of(spark, "t", text, "DOI") == ""


def test_unknown_labels_do_not_end_a_field(spark):
    text = "DOI: 10.1/x. Publication date: 2026-01-01. Other ID: W1"
    assert fields_of(spark, "t", text, "DOI") == "10.1/x. Publication date: 2026-01-01. Other ID: W1"


def test_first_present_label_wins_even_when_empty(spark):
    assert fields_of(spark, "t", "Repo: a/b Repository: DOI: 1", "Repository", "Repo") == ""
    assert fields_of(spark, "t", "GitHub repository: o/n.", "Repository", "Repo", "GitHub repository") == "o/n"
    assert fields_of(spark, "t", "xDOI: 1", "DOI") == ""


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Tue, 04 Aug 26 10:00:00 GMT", dt.datetime(2026, 8, 4, 10)),
        ("4 Aug 68 10:00 GMT", dt.datetime(2068, 8, 4, 10)),
        ("4 Aug 69 10:00:00 +0200", dt.datetime(1969, 8, 4, 8)),
        ("Tue, 04 Aug 2026 10:00:00 GMT", dt.datetime(2026, 8, 4, 10)),
        ("4 Aug", None),
    ],
)
def test_mail_dates_with_short_years(spark, value, want):
    assert one(spark, value, dates.mail_date) == want


@pytest.mark.parametrize("value", ["Tiếng Việt", "Tiếng Việt", "TIẾNG VIỆT"])
def test_accents_of_all_ranges_and_forms(spark, value):
    assert one(spark, value, text.search_tokens) == ["tieng", "viet"]
