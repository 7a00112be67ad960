"""H1-H7, A4-A6 and J1 (= batch H1)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scorewell.operators import leaderboard as L
from scorewell.sources import submissions as S
from scorewell.streaming.leaderboard import run_leaderboard_stream


def _subs(spark, rows):
    data = [
        (ts, user, "ds-1", "0", "spearman", {"spearman": score, "mse": 1.0}, name, None)
        for (user, score, ts, name) in rows
    ]
    schema = "timestamp string, user string, dataset string, fold string, primary_metric string, metrics map<string,double>, name string, description string"
    return spark.createDataFrame(data, schema)


ROWS = [
    ("x", 0.5, "2024-01-01T00:00:01.000000", "a"),
    ("x", 0.7, "2024-01-01T00:00:02.000000", "b"),
    ("y", 0.6, "2024-01-01T00:00:03.000000", "c"),
    ("y", 0.6, "2024-01-01T00:00:04.000000", "d"),
]


def test_best_per_user_earliest_wins(spark):
    got = {r["user"]: (r["score"], r["name"]) for r in L.best_per_user(_subs(spark, ROWS)).collect()}
    assert got == {"x": (0.7, "b"), "y": (0.6, "c")}


def test_leaderboard_ranks_and_ties(spark):
    rows = ROWS + [("z", 0.6, "2024-01-01T00:00:00.500000", "e")]
    board = {r["user"]: r["rank"] for r in L.leaderboard(_subs(spark, rows)).collect()}
    # z and y tie at .6; z submitted first, so it ranks ahead
    assert board == {"x": 1, "z": 2, "y": 3}


def test_user_history_change(spark):
    rows = [("u", s, f"2024-01-01T00:00:0{i}.000000", f"n{i}") for i, s in enumerate([0.5, 0.5, 0.7])]
    h = L.user_history(_subs(spark, rows)).orderBy("idx").collect()
    assert [r["idx"] for r in h] == [1, 2, 3]
    assert h[0]["change"] is None and h[1]["change"] is None
    assert h[2]["change"] == pytest.approx(0.2)
    assert h[0]["other_metrics"] == "mse=1.0000"


def test_history_summary(spark):
    rows = [("u", s, f"2024-01-01T00:00:0{i}.000000", f"n{i}") for i, s in enumerate([0.5, 0.9, 0.7])]
    r = L.history_summary(_subs(spark, rows)).first()
    assert (r["first_score"], r["best_score"], r["latest_score"]) == (0.5, 0.9, 0.7)
    assert r["total_improvement"] == pytest.approx(0.2)


def test_append_load_export_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="subs-")
    S.append_submissions(_subs(spark, ROWS), base)
    S.append_submissions(_subs(spark, ROWS), base, dummy=True)  # not logged
    loaded = S.load_submissions(spark, base, dataset="ds-1", fold="0")
    assert loaded.count() == 4
    assert loaded.first()["dataset"] == "ds_1"  # normalized on both sides
    assert {r["name"] for r in loaded.collect()} == {"a", "b", "c", "d"}
    assert S.load_submissions(spark, base, dataset="ds_1", fold="0", user="x").count() == 2
    assert S.load_submissions(spark, os.path.join(base, "missing")).count() == 0
    out = S.export_submissions(loaded, os.path.join(base, "export"))
    flat = spark.read.option("header", "true").csv(out)
    assert set(flat.columns) >= {"metric_primary_metric", "metric_spearman", "metric_mse", "description"}


def test_reference_file_layout(spark):
    base = tempfile.mkdtemp(prefix="ref-subs-")
    d = os.path.join(base, "ds_1", "0", "x")
    os.makedirs(d)
    rec = {"timestamp": "2024-01-01T00:00:01", "user": "x", "dataset": "ds_1", "fold": "0",
           "metrics": {"primary_metric": "spearman", "spearman": 0.5, "mse": 2.0}, "name": "n", "description": "d"}
    with open(os.path.join(d, "2024-01-01T00-00-01.json"), "w") as f:
        json.dump(rec, f, indent=2)
    r = S.load_submissions(spark, base, layout="reference").first()
    assert r["primary_metric"] == "spearman" and r["metrics"] == {"spearman": 0.5, "mse": 2.0}


def test_streaming_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    src = os.path.join(base, "src")
    S.append_submissions(_subs(spark, ROWS[:2]), src)
    S.append_submissions(_subs(spark, ROWS[2:]), src)
    board = run_leaderboard_stream(spark, src, os.path.join(base, "board"), files_per_trigger=1)
    got = {r["user"]: (r["score"], r["name"]) for r in board.collect()}
    batch = {r["user"]: (r["score"], r["name"]) for r in L.best_per_user(S.load_submissions(spark, src)).collect()}
    assert got == batch == {"x": (0.7, "b"), "y": (0.6, "c")}


def test_history_and_board_with_hot_user(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n = 900
    users = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c", "d", "e"], size=n))
    scores = np.round(rng.integers(0, 20, size=n) / 20.0, 2)  # many exact ties
    ts = [f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.000000" for i in range(n)]
    rows = [(u, float(s), t, f"n{i:04d}") for i, (u, s, t) in enumerate(zip(users, scores, ts))]
    subs = _subs(spark, rows)
    hist = L.user_history(subs).toPandas()  # eight ranges: the hot user spans several
    board = L.leaderboard(subs).toPandas()
    pdf = pd.DataFrame(rows, columns=["user", "score", "timestamp", "name"]).sort_values(["user", "timestamp", "name"])
    pdf["idx"] = pdf.groupby("user").cumcount() + 1
    pdf["chg"] = pdf.groupby("user")["score"].diff()
    m = hist.merge(pdf, on=["user", "idx"], suffixes=("", "_e"))
    assert len(m) == n and (m["score"] == m["score_e"]).all()
    exp_chg = m["chg"].where(m["chg"] != 0)
    assert ((m["change"].isna() & exp_chg.isna()) | (np.isclose(m["change"], exp_chg))).all()
    best = pdf.sort_values(["score", "timestamp"], ascending=[False, True]).groupby("user").head(1)
    first = pdf.groupby("user")["timestamp"].min()
    best = best.assign(first=best["user"].map(first)).sort_values(["score", "first", "user"], ascending=[False, True, True])
    assert list(board.sort_values("rank")["user"]) == list(best["user"])


def test_ordering_independent_of_session_time_zone(spark):
    rows = [
        ("u", 0.5, "2024-11-03T01:30:00.000000", "a"),  # inside a US fall-back hour
        ("u", 0.7, "2024-11-03T01:10:00.000000", "b"),
        ("u", 0.6, "2024-11-03T00:59:00.000000", "c"),
        ("v", 0.7, "2024-11-03T01:20:00.000000", "d"),
    ]
    def run():
        h = [(r["user"], r["idx"], r["name"]) for r in L.user_history(_subs(spark, rows)).orderBy("user", "idx").collect()]
        b = [(r["rank"], r["user"]) for r in L.leaderboard(_subs(spark, rows)).orderBy("rank").collect()]
        return h, b

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        utc = run()
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        la = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == la
    assert utc[0] == [("u", 1, "c"), ("u", 2, "b"), ("u", 3, "a"), ("v", 1, "d")]
    # u and v tie at .7; u submitted first (00:59), so u ranks first
    assert utc[1] == [(1, "u"), (2, "v")]
