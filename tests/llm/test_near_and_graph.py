"""MinHash classes, components and the URL filter against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.llm import minhash, urls
from scorewell.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def plain_components(sets, percent):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


def family(rng, words, size, changes):
    base = [rng.choice(words) for _ in range(size)]
    out = [base]
    for _ in range(12):
        new = list(rng.choice(out))
        for _ in range(changes):
            new[rng.randrange(size)] = rng.choice(words) + "!"
        out.append(new)
    return [" ".join(x) for x in out]


def test_words_that_polynomial_hashes_confuse(spark, tmp_path):
    """Thue-Morse words and their swaps: equal under any polynomial hash modulo 2^64."""
    rows = []
    for n in (1024, 2048, 4096, 8192):
        for letters in ("ab", "ba"):
            word = "".join(letters[i.bit_count() & 1] for i in range(n))
            rows += [word, f"{word} and more", f"{word} {word}"]
    sets = minhash.shingle_sets([r.encode() for r in rows], 2)
    plain = [plain_set(r, 2) for r in rows]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(a, b)) == len(plain[i] & plain[j])
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").write.parquet(path)
    df = spark.read.parquet(path)
    assert all(r.id == r.component for r in minhash.classes(df, k=2).collect())
    assert minhash.drop_near_duplicates(df).count() == len(rows)


@pytest.mark.parametrize("k", [2, 5])
def test_classes_equal_all_pairs(spark, awkward, tmp_path, k):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for _, t, *_ in awkward[1] if t is None or len(t) < 5000]
    # chains of near copies at the edge of the threshold, of short and long texts
    for size, changes in [(4, 1), (9, 1), (30, 1), (120, 3), (400, 9), (400, 20), (1500, 30)]:
        for _ in range(3):
            texts += family(rng, words, size, changes)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = {r.id: r for r in minhash.classes(spark.read.parquet(path), k=k).collect()}
    rows.sort()
    sets = [plain_set(t, k) for _, t in rows]
    roots = plain_components(sets, 80)
    for (i, _), s, root in zip(rows, sets, roots):
        assert got[i].n == len(s)
        assert got[i].component == rows[root][0], (i, rows[root][0])


def test_classes_of_awkward_rows(awkward, empty):
    df, rows = awkward
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    sets = [plain_set(t, 5) for _, t, *_ in rows]
    assert kept.count() == len(set(plain_components(sets, 80)))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {1, 2, 3, 4, 14} <= ids and not {5, 6, 9} & ids
    assert minhash.classes(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_a_large_group_of_copies(spark, tmp_path):
    path = str(tmp_path / "docs")
    body = " ".join(f"w{i}" for i in range(80))
    spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, body).when(F.col("id") % 3 == 1, F.concat(F.lit(body + " end"), F.col("id")))
        .otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"v{i}-"), F.col("id")) for i in range(12)])).alias("text"),
    ).repartition(8).write.parquet(path)
    got = minhash.classes(spark.read.parquet(path), k=2)
    assert got.where("component = 0").count() == 2000
    assert got.where("component = id and id % 3 = 2").count() == 1000


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 4000).astype(np.uint64)
        b = a.copy()
        n = int(4000 * (1 - share) / (1 + share))
        b[:n] = rng.integers(0, 2**63, n).astype(np.uint64)
        x, y = minhash.registers([np.sort(a), np.sort(b)])
        assert abs((x == y).mean() - share) < 0.11


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(7, 8), (8, 9), (9, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.vertex: r.component for r in components(df, "a", "b").collect()}
    want = {i: 100 for i in range(100, 161)} | {x: 5 for x in [5, *range(200, 260)]} | {7: 7, 8: 7, 9: 7}
    assert got == want
    assert components(df.where("false"), "a", "b").count() == 0


PAGES = [
    (1, "http://a.net", ""), (2, "http://a.net/x", None), (3, "https://M.Example.NET/en/1?x#y", "<a href='//b.org/x'>"),
    (4, "http://b.org/q#z", '<a HREF="http://c.info/1"> <a href=http://bad.net/2>'), (5, None, "x"), (6, "no scheme", "x"),
    (7, "ftp://c.info", '<a href="https://d.info">'), (8, "http://x.example.com/de/", ""), (9, "http://example.com/fr/", ""),
    (10, "http://d.info/\nx?y", '<a href="http://bad.net/">'), (11, "http://b.org/fr/", '<a href="http://c.info/2">'),
    (12, "http://d.info/2", '<a href="http://bad.net/"> <a href="http://evil.net/">'), (12, "http://d.info/2", ""), (13, "http://", None),
    (14, "http://notnet/en", None), (15, "http://net/", None), (16, "a://b://c.net/", None),
    (17, "http://bad.net/1", ""), (18, "http://shady.io/1", '<a href="http://bad.net/1">'),
]


def test_url_filter_equals_sql(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = sorted(tuple(r) for r in urls.judged(df).select("id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    pages = df.toPandas()  # noqa: F841
    want = sorted(con.execute(
        f"SELECT page_id, host, path, rule, verdict FROM ({urls.SQL})"
    ).fetchall())
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]
    by_id = {x[0]: x for x in got}
    assert by_id[1][3:] == (None, "allow") or by_id[1][3] is None  # an empty path doesn't start with "/"
    assert by_id[2][3:] == ("net/", "block") and by_id[3][1:4] == ("m.example.net", "/en/1", "example.net/en/")
    assert by_id[5][1:] == ("", "", None, "allow") and by_id[14][3] is None and by_id[15][3] == "net/"
    assert by_id[18][3:] == (None, "block")  # links to a blocked host


def test_distrust_follows_a_long_chain(spark):
    """Each host links to the next, the last one to a blocked host: all are suspect, and SQL says so too."""
    n = 24
    rows = [(i, f"http://h{i:02d}/", f'<a href="http://{f"h{i + 1:02d}" if i < n - 1 else "bad.net"}/">') for i in range(n)]
    rows += [(100, "http://bad.net/x", None), (101, "http://clean/", '<a href="http://h00/">'), (102, "http://alone/", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.id: r.verdict for r in urls.judged(df).collect()}
    assert all(got[i] == "block" for i in range(n)) and got[101] == "block" and got[102] == "allow"
    pages = df.toPandas()  # noqa: F841
    want = dict(duckdb.connect().execute(f"SELECT page_id, verdict FROM ({urls.SQL})").fetchall())
    assert got == want


def test_hubs_in_blocks_give_the_same_ranks(spark, monkeypatch):
    rng = random.Random(3)
    hosts = [f"s{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(60)]
    rows = [(i, f"http://{h}/{rng.choice(['fr', 'x'])}/", " ".join(f'<a href="//{rng.choice(hosts)}/">' for _ in range(4)))
            for i, h in enumerate(hosts)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    read = lambda: {r.id: (r.verdict, round(r.trust or 0, 12), round(r.distrust or 0, 12)) for r in urls.judged(df).collect()}
    whole = read()
    monkeypatch.setattr(urls, "HUB_EDGES", 3)
    assert read() == whole and len({v[0] for v in whole.values()}) == 2


def test_url_filter_of_an_empty_table(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").where("page_id < 0")
    assert urls.judged(df).count() == 0


def test_cells_count_what_sets_share():
    rng = np.random.default_rng(4)
    make = lambda: np.unique(rng.integers(0, 6000, rng.integers(1, 3000)).astype(np.uint64))
    q, t = [make() for _ in range(7)], [make() for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in t] for a in q]
    assert minhash._common(q, t).tolist() == want


def test_large_open_buckets_lose_no_link(spark, tmp_path, monkeypatch):
    """A family of which many members are far from the hub: cells of several blocks must find every link."""
    monkeypatch.setattr(minhash, "CELL", 3000)
    rng = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(100)]
    texts = []
    for _ in range(150):
        new = list(base)
        for _ in range(rng.choice([2, 4, 6, 9, 12, 15])):
            new[rng.randrange(100)] = rng.choice(words)
        texts.append(new)
        if rng.random() < 0.3:
            again = list(new)
            again[rng.randrange(100)] = "twin"
            texts.append(again)
    texts = [" ".join(t) for t in texts]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    got = {r.id: r.component for r in minhash.classes(spark.read.parquet(path), k=2).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components([plain_set(t, 2) for t in texts], 80)
    assert len(set(got.values())) > 3
