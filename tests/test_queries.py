"""Registered queries against their SQL at the smallest scale, and the plans they run."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, _rows
from hamsieve.operators import features as V

# The rest is compared by check.py; these few cover every module in the time of a test run.
COMPARED = (
    "scan_mail_csv", "split_csv_round_trip", "mail_parts", "mail_body", "clean_pages", "valid_content",
    "reject_report", "split_summary", "tfidf_apply", "encode_ids", "nb_score", "roc_events",
    "early_stop", "resolve_model", "lime_weights", "top_features", "stream_scores", "mail_charsets", "reject_parsed",
    "noise_rules", "prepared_corpus", "score_files", "stream_file_scores", "run_params", "token_vocab",
)
NARROW = ("clean_corpus", "clean_serve", "clean_pages", "html_pages", "mail_body", "mail_parts", "noise_rules")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, sf, db, name):
    df = queries()[name](spark, sf)
    cur = db.execute(oracle_sql()[name])
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == want


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_text_work_stays_in_the_jvm_and_moves_no_rows(spark, sf, name):
    text = plan(queries()[name](spark, sf))
    assert "Python" not in text and "ArrowEval" not in text
    assert "Exchange" not in text


def test_language_is_judged_without_moving_text(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("lang_id", "accepted_mails"):
            assert "Exchange" not in plan(queries()[name](spark, sf))
        assert "body" not in "".join(x for x in plan(queries()["reject_report"](spark, sf)).splitlines() if "Exchange" in x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ids_are_looked_up_in_the_row(spark, sf):
    assert "Exchange" not in plan(queries()["encode_ids"](spark, sf))


def test_the_vocabulary_is_cut_without_the_driver(spark):
    rows = [(i, ["t%03d" % (j % 50) for j in range(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    cut = V.fit_vocabulary(df, max_features=20, max_df=1.0)
    assert "TakeOrdered" not in plan(cut)
    every = sorted(V.fit_vocabulary(df, max_features=None, max_df=1.0).collect(), key=lambda r: (-r["total"], r["term"]))
    assert {r["term"] for r in cut.collect()} == {r["term"] for r in every[:20]}


@pytest.mark.parametrize("name", ("exact_split", "tf", "vocab", "nb_contributions", "roc_events", "shuffle_order"))
def test_no_cartesian_product(spark, sf, name):
    text = plan(queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_entry(spark):
    assert entry(spark).count() == 1


def test_registered_names_agree():
    assert set(oracle_sql()) <= set(queries())
