"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "triage_decisions", "escalation_policy", "clean_text", "top_bigrams", "build_threads", "signal_rates",
    "compare_systems", "calibrate", "cohens_kappa", "knn_blocked", "stratified_backfill", "reply_guard",
    "tfidf_terms", "silhouette_squared", "triage_records", "thread_length_stream",
    "triage_batches", "knn_cells_recall", "restricted_messages",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["intent", "decision", "n", "signals"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
