"""Committed batches and numbered versions: what crashes, replays and races leave behind."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from hamsieve.sources import artifacts, log
from hamsieve.sources.scratch import scratch_path


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def ids(spark, path):
    return sorted(r["id"] for r in log.read_committed(spark, path).collect())


def test_a_file_is_made_once(spark):
    path = scratch_path(spark, "t-once") + "/a b"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: log.create_if_absent(spark, path, f'{{"k": {k}}}'), range(16)))
    assert sum(won) == 1
    assert spark.read.json(path).collect()[0]["k"] == won.index(True)


def test_batches_count_once(spark):
    path = scratch_path(spark, "t-batches")
    assert log.commit_batch(rows(spark, 1, 2), path, "stream:x", 0)
    assert not log.commit_batch(rows(spark, 1, 2), path, "stream:x", 0)
    # The same number of another writer, and names that differ in odd characters, are other batches.
    assert log.commit_batch(rows(spark, 3), path, "stream:y", 0)
    assert log.commit_batch(rows(spark, 4), path, "stream_3a_x", 0)
    assert log.commit_batch(rows(spark), path, "empty", 0)
    assert ids(spark, path) == [1, 2, 3, 4]


def test_what_was_not_committed_is_not_read(spark):
    path = scratch_path(spark, "t-crash")
    log.commit_batch(rows(spark, 1), path, "w", 0)
    rows(spark, 99).write.parquet(f"{path}/data/attempt=0123")  # a writer that died before its commit
    assert ids(spark, path) == [1]
    log.commit_batch(rows(spark, 2), path, "w", 1)
    assert ids(spark, path) == [1, 2]


def test_two_attempts_at_once(spark):
    path = scratch_path(spark, "t-race")
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda _: log.commit_batch(rows(spark, 7, 8), path, "w", 5), range(4)))
    assert sum(won) == 1 and ids(spark, path) == [7, 8]


def test_versions_have_no_gap_and_no_double(spark):
    path = scratch_path(spark, "t-versions")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: artifacts.publish_model(spark, path, f"run{k}", k / 10), range(12)))
    assert sorted(got) == list(range(1, 13))
    versions = {r["version"]: r["run_id"] for r in artifacts.model_versions(spark, path).collect()}
    assert versions == {v: f"run{k}" for k, v in enumerate(got)}
    assert artifacts.require_model(artifacts.registered_models(spark, path)) == ("run11", "best")


def test_the_newest_version_serves_where_none_is_best(spark):
    path = scratch_path(spark, "t-latest")
    assert log.last_entry(spark, path) == 0
    for run in ("a", "b"):
        artifacts.publish_model(spark, path, run, 0.0, seen=0)
    assert artifacts.require_model(artifacts.registered_models(spark, path)) == ("b", "latest")
    for f1 in (0.5, 0.5):
        artifacts.publish_model(spark, path, f"c{log.last_entry(spark, path)}", f1)
    assert artifacts.require_model(artifacts.registered_models(spark, path)) == ("c2", "best")


def test_streams_and_batches_share_a_history(spark):
    path = scratch_path(spark, "t-shared")
    artifacts.append_predictions(rows(spark, 1), path)
    artifacts.append_predictions(rows(spark, 1), path)  # no name: another batch
    with pytest.raises(Exception):  # a batch that fails leaves nothing to read
        artifacts.append_predictions(rows(spark, 1).selectExpr("raise_error('no') AS id"), path, "w", 1)
    assert artifacts.append_predictions(rows(spark, 5), path, "w", 1)
    assert sorted(r["id"] for r in artifacts.read_predictions(spark, path).collect()) == [1, 1, 5]
