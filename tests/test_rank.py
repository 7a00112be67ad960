"""P1 distributed average rank and the distributed row_number / lag primitive."""

import numpy as np
import pandas as pd
import pytest

from scorewell.operators.rank import avg_rank, laid_out, ordered_positions


def _data(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 200, size=n).astype(float)
    v[: n // 3] = 7.0  # one hot value holds a third of all rows
    g = rng.integers(0, 3, size=n)
    g[: n // 3] = 1  # ... and the hot value sits in one hot group
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v})


@pytest.fixture(params=[1, 3, 64])
def parts(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_avg_rank_matches_pandas(spark, parts):
    pdf = _data()
    df = spark.createDataFrame(pdf)
    got = avg_rank(df, "v", ["g"], "r").toPandas()
    exp = pdf.assign(r=pdf.groupby("g")["v"].rank(method="average")).groupby(["g", "v"])["r"].first().reset_index()
    m = got.merge(exp, on=["g", "v"], suffixes=("", "_exp"))
    assert len(m) == len(exp) == len(got)
    assert np.allclose(m["r"], m["r_exp"])


def test_avg_rank_independent_of_partitioning(spark):
    pdf = _data(seed=3)
    a = avg_rank(spark.createDataFrame(pdf).repartition(1), "v", (), "r").toPandas().sort_values("v")
    b = avg_rank(spark.createDataFrame(pdf).repartition(16), "v", (), "r").toPandas().sort_values("v")
    assert np.allclose(a["r"].to_numpy(), b["r"].to_numpy())


def test_ordered_positions_row_number_and_lag(spark, parts):
    pdf = _data(seed=5)
    pdf["key"] = pdf["v"]
    df = spark.createDataFrame(pdf)
    got = ordered_positions(df, ["key", "id"], ["g"], "pos", lag_cols=["id"]).toPandas()
    exp = pdf.sort_values(["g", "key", "id"]).copy()
    exp["pos"] = exp.groupby("g").cumcount() + 1
    exp["prev_id"] = exp.groupby("g")["id"].shift(1)
    m = got.merge(exp, on="id", suffixes=("", "_e"))
    assert (m["pos"] == m["pos_e"]).all()
    assert ((m["prev_id"].isna() & m["prev_id_e"].isna()) | (m["prev_id"] == m["prev_id_e"])).all()


def test_ties_one_second_and_long_prefixes_spread(spark):
    """One tied score, one busy second, names with one prefix: no partition holds more than a share."""
    df = spark.range(8000).selectExpr(
        "id", "1.0 as score", "'2024-01-01T00:00:00' as ts", "concat('ENSG00000', lpad(id, 8, '0')) as gene"
    )
    for keys in (["score", "id"], ["ts", "id"], ["gene"]):
        sizes = [r["count"] for r in laid_out(df, [], keys, "test-layout").groupBy("_part").count().collect()]
        assert len(sizes) >= 6 and max(sizes) < 8000 / 3
    pos = ordered_positions(df, ["gene"], (), "pos")
    assert pos.where("pos <> id + 1").count() == 0 and pos.count() == 8000


def test_null_groups_and_values_are_ranked(spark):
    rows = [(None, 1.0), (None, None), ("a", 2.0), ("a", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v): (r.cnt, r["rank"]) for r in avg_rank(df, "v", ["g"]).collect()}
    assert got == {(None, None): (1, 1.0), (None, 1.0): (1, 2.0), ("a", None): (1, 1.0), ("a", 2.0): (2, 2.5)}
    assert ordered_positions(df.where("false"), ["v"], ["g"]).count() == 0


def test_scratch_tables_can_be_dropped(spark):
    from scorewell.session import drop_scratch

    df = ordered_positions(spark.range(50), ["id"])
    assert df.count() == 50 and drop_scratch(spark) >= 1 and drop_scratch(spark) == 0
