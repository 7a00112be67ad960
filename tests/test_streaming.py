"""J1 over several runs of the stream: equal to the batch board, small writes, nothing without files."""

import json
import os
import random

from scorewell.operators import leaderboard as L
from scorewell.sources import submissions as S
from scorewell.streaming import leaderboard as ST

SCHEMA = (
    "timestamp string, user string, dataset string, fold string, primary_metric string, "
    "metrics map<string,double>, name string, description string"
)


def _records(rng, n, start):
    return [
        (f"2024-01-{1 + (start + i) // 24 % 28:02d}T{(start + i) % 24:02d}:00:00", f"u{rng.randint(0, 30) if rng.random() > 0.3 else 0}",
         f"d{rng.randint(0, 1)}", "0", rng.choice(["spearman", "mse"]),
         {m: rng.choice([0.1, 0.5, rng.random()]) for m in rng.sample(["spearman", "mse"], rng.randint(0, 2))}, f"n{start + i:05d}", None)
        for i in range(n)
    ]


def _board(df):
    return sorted(tuple(r) for r in df.select("dataset", "fold", "user", "timestamp", "name", "score", "primary_metric", "n_submissions").collect())


def test_boards_follow_the_files(spark, tmp_path):
    rng = random.Random(2)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    assert ST.run_leaderboard_stream(spark, src, out).count() == 0
    sizes = []
    for k, n in enumerate([120, 8, 8, 8]):
        S.append_submissions(spark.createDataFrame(_records(rng, n, 1000 * k), SCHEMA), src)
        board = ST.run_leaderboard_stream(spark, src, out, files_per_trigger=1000)
        assert _board(board) == _board(L.best_per_user(S.load_submissions(spark, src)))
        runs = ST._manifest(spark, out)
        sizes.append([r["rows"] for r in runs])
    # later runs hold what changed, not the whole state
    assert len(sizes[1]) == 2 and sizes[1][1] < sizes[1][0] / 2
    named = {r["path"].rsplit("/", 1)[-1] for r in ST._manifest(spark, out)}
    assert named <= set(os.listdir(f"{out}/runs")) and len(os.listdir(f"{out}/runs")) <= len(named) + 3
    assert json.dumps(runs)


def test_a_folder_gets_as_many_files_as_its_records_need(spark, tmp_path, monkeypatch):
    """Twelve tasks wrote twelve files a folder, and a stream that takes four at a time needed as many more batches."""
    records = spark.createDataFrame(_records(random.Random(3), 400, 0), SCHEMA).repartition(12)
    files = lambda at: {d: sum(f.endswith(".json") for f in os.listdir(f"{at}/dataset={d}/fold=0")) for d in ("d0", "d1")}
    S.append_submissions(records, str(tmp_path / "one"))
    assert files(tmp_path / "one") == {"d0": 1, "d1": 1}
    monkeypatch.setattr(S, "RECORDS_PER_FILE", 80)
    S.append_submissions(records, str(tmp_path / "more"))
    assert all(2 <= n <= 4 for n in files(tmp_path / "more").values())
    for at in ("one", "more"):
        kept = {r["name"] for r in S.load_submissions(spark, str(tmp_path / at)).collect()}
        assert kept == {f"n{i:05d}" for i in range(400)}
