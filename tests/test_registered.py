"""Every registered query against its SQL twin on the smallest tables, and the registration itself."""

import re

import pytest

import __spark_entry__ as registration
from keepwell.catalog import load_all
from tests.oracle import connect, difference

# Those of other packages have tests of their own.
QUERIES = {name: q.run for name, q in load_all().items()}
TWINS = {name: q.sql for name, q in load_all().items() if q.sql is not None}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_without_twin(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_all_are_registered():
    assert set(TWINS) == set(QUERIES) <= set(registration.queries())
    assert set(TWINS) <= set(registration.oracle_sql()) <= set(registration.queries())


def test_others_are_named_by_number():
    others = set(registration.queries()) - set(QUERIES)
    assert not [n for n in others if not re.fullmatch(r"pipeline|op\d+_\w+", n)]


def test_entry(spark):
    assert registration.entry(spark).count() == 30
