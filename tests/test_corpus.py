import hashlib

import pytest
from pyspark.sql import functions as F

from hamsieve.operators import corpus as C
from hamsieve.sources import artifacts, corpus as S


def digest(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 5, 9, 10, 87, 1000])
def test_exact_split(spark, n):
    df = spark.range(n)
    got = {r["id"]: r["split"] for r in C.exact_split(df).collect()}
    order = sorted(range(n), key=digest)
    train, val = int(n * 0.8), int(n * 0.1)
    want = {i: "train" if k < train else "validate" if k < train + val else "test" for k, i in enumerate(order)}
    assert got == want


def test_global_rank(spark):
    got = {r["id"]: r["position"] for r in C.global_rank(spark.range(500), C.shuffle_key("id")).collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(500), key=digest))}


def test_sample_and_first(spark):
    df = spark.range(100)
    assert [r["id"] for r in C.first_n(df, 3, F.desc("id")).collect()] == [99, 98, 97]
    assert {r["id"] for r in C.sample_n(df, 10).collect()} == set(sorted(range(100), key=digest)[:10])


def test_summary(spark):
    df = spark.createDataFrame([("train", 0), ("train", 1), ("test", 0)], "split string, label int")
    got = {(r["split"], r["label"]): r["mails"] for r in C.split_summary(df).collect()}
    assert got == {
        ("train", 0): 1, ("train", 1): 1, ("test", 0): 1, ("train", -1): 2, ("test", -1): 1, ("all", -1): 3
    }


def test_split_csv_keeps_empty_texts(spark, tmp_path):
    rows = [("1", "", 'a "quoted", body\nwith lines', 0, "train"), ("2", "nan", None, 1, "train")]
    df = spark.createDataFrame(rows, "id string, subject string, body string, label int, split string")
    S.write_split_csv(df, str(tmp_path / "s"))
    S.write_split_csv(df, str(tmp_path / "s"))  # replaces
    got = {tuple(r) for r in S.read_split_csv(spark, str(tmp_path / "s"), "train").collect()}
    assert got == {("1", "", rows[0][2], 0), ("2", "nan", "", 1)}


def test_mail_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.eml").write_bytes("Subject: é\n\nbody".encode("latin1"))
    (tmp_path / "deep" / "b.lorien").write_bytes("Subject: é\n\nbody".encode())
    (tmp_path / "deep" / "c.txt").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: r["message"] for r in S.read_mail_files(spark, str(tmp_path)).collect()}
    assert got == {"a.eml": "Subject: é\n\nbody", "b.lorien": "Subject: é\n\nbody", "c.txt": "x"}
    served = {r["path"].rsplit("/", 1)[1]: r["message"] for r in S.read_mail_files_for_scoring(spark, str(tmp_path)).collect()}
    assert served == {"a.eml": "Subject: \n\nbody", "c.txt": "x"}


def test_registry(spark):
    schema = "run_id string, alias string, f1 double"
    df = spark.createDataFrame([("r1", "best", 0.5), ("r3", "latest", 0.1), ("r2", "best", 0.6)], schema)
    assert artifacts.require_model(df) == ("r2", "best")
    assert artifacts.require_model(df.where("alias = 'latest'")) == ("r3", "latest")
    with pytest.raises(FileNotFoundError):
        artifacts.require_model(df.limit(0))


def test_params_and_history(spark, tmp_path):
    for run in ("r1", "r2"):
        artifacts.save_params(spark, str(tmp_path / "p"), run, {"best_f1": 0.5, "best_epoch": 2})
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    cols = "epoch int, train_loss double, val_loss double, accuracy double, precision double, recall double, f1 double"
    df = spark.createDataFrame([(2, *[0.2] * 6), (1, *[0.1] * 6)], cols)
    artifacts.save_history(df, str(tmp_path / "h"))
    assert [r["epoch"] for r in spark.read.csv(str(tmp_path / "h"), header=True).collect()] == ["1", "2"]


def test_judging_stops_when_enough_are_accepted(spark):
    rows = [(i, i % 4 == 0 or i > 900) for i in range(1000)] + [(None, True)]
    mails = spark.createDataFrame(rows, "id long, good boolean").repartition(5)
    judged = []

    def judge(df):
        judged.append(df.count())
        return df.where("good")

    for n in (1, 60, 300, 2000):
        judged.clear()
        got = [r["id"] for r in C.first_accepted(mails, n, judge).collect()]
        assert got == [r["id"] for r in C.first_n(mails.where("good"), n, "id").collect()]
        assert n > 60 or sum(judged) < 8 * n + 10
    assert C.first_accepted(mails.limit(0), 5, judge).count() == 0
