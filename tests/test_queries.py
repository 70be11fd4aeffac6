"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import os

import pytest

from gazette.registry import ORACLES, QUERIES

from oracle import compare, connect

FOLDER = os.environ.get("GAZETTE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert problem == ""


def test_all_invalid_rows_are_errors(spark):
    want = QUERIES["validate_split"](spark, FOLDER).where("not valid").collect()
    got = QUERIES["validation_errors_all"](spark, FOLDER).collect()
    assert sorted(r.message.split(": ", 1)[1] for r in got if r.link) == sorted(r.messages for r in want)
    assert {len(r.messages.split(", ")) for r in want} >= {1, 2}


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
