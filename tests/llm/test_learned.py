"""Toxicity and secret scan: held-out accuracy, exact base findings, defined results."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.llm import common, secrets, toxicity
from scorewell.llm.queries import QUERIES

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def plain_base(text):
    return sorted((m.start(), r, m.end()) for r, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text) if ok(m))


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice(["an", "er", "on", "th", "sti", "ou", "lé", "be"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]


@pytest.fixture(scope="module")
def net(words):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(300)]
    texts += [t + f' token = "{rng.getrandbits(160):040x}"' for t in texts[:60]]
    return secrets.train(texts)


def test_base_findings_equal_the_plain_patterns():
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "api_key", "apikey", "toKen", "ſecret", '"', "'", " ", "=", ":", "AKIA", "abcdef0123456789",
             "ABCDEF99", "x.y-z/+_=", "é", "\n", "deadbeef" * 3]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert secrets.base_spans(t) == plain_base(t), t
        if plain_base(t) or secrets.other_tokens(t, []):
            assert secrets.worth_reading(["plain words".encode(), t.encode()])[1]


def test_network_finds_held_out_keys(net, words):
    rng = random.Random(8)
    hits = total = wrong = 0
    for _ in range(300):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(24, 50)))
        left = " ".join(rng.choice(words) for _ in range(6)) + " "
        s = net.scores([secrets.pieces(left + key + " end", len(left), len(left) + len(key))])[0]
        hits, total = hits + (s >= net.threshold), total + 1
        word = "".join(rng.choice(words) for _ in range(7)).encode("ascii", "ignore").decode()[:30] + "7"
        wrong += net.scores([secrets.pieces(left + word, len(left), len(left) + len(word))])[0] >= net.threshold
    assert hits / total > 0.95 and wrong / total < 0.1


def test_network_gradient(words):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 97, (64, secrets.BEFORE + secrets.BODY + secrets.AFTER))
    flag = np.zeros(x.shape, np.float32)
    flag[:, secrets.BEFORE : secrets.BEFORE + 20] = 1
    y = (rng.random(64) < 0.5).astype(np.float32)
    x[y == 1, 30] = 5  # one character tells the classes apart
    x[y == 0, 30] = 6
    learned = secrets._train(np.tile(x, (8, 1)), np.tile(flag, (8, 1)), np.tile(y, 8))
    assert ((learned.forward(x, flag)[0] > 0) == (y == 1)).mean() > 0.9


def test_secret_findings_of_awkward_rows(awkward, empty, net):
    df, rows = awkward
    got = {}
    for r in secrets.findings(df, net).collect():
        got.setdefault(r.id, []).append([(f.start, f.rank, f.end) for f in r.findings if f.rank < 3])
        assert all(0 <= f.score <= 1 and f.kind == secrets.KINDS[f.rank] for f in r.findings)
    for i in {r[0] for r in rows}:
        assert sorted(got[i]) == sorted(plain_base(x[1] or "") for x in rows if x[0] == i)
    assert len(got[16][0]) >= 3
    assert secrets.findings(empty, net).count() == 0
    assert secrets.fit(empty).threshold > 0


def test_op3_digest(spark):
    for r in QUERIES["op3_secrets"](spark, "/root/testdata/sf0.001").limit(5).collect():
        if not r.spans:
            assert r.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_op3_learns_from_every_text(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    key = lambda i: f"token={i:06d}{rng.getrandbits(80):020x}"
    rows = [(i, f"some words stand here {key(i)} and a longwordwithoutdigits{'abcdefghij'[i % 10]}") for i in range(secrets.SAMPLE_DOCS + 500)]
    rows.append((-1, " ".join(f"filler {'x' * 300} {key(900_000 + i)}" for i in range(400))))  # longer than a sample text
    rows += [rows[7], (None, rows[8][1]), (-2, None), (-3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = secrets.cases(docs, "doc_id", "text").collect()
    found = {}
    for r in got:
        if r.label and r.around[r.start : r.end].startswith("token="):
            name = r.around[r.start : r.end]
            found[name] = found.get(name, 0) + r.n
    want = {}
    for _, t in rows:
        for s, _, e in plain_base(t or ""):
            if (t or "")[s:e].startswith("token="):
                want[t[s:e]] = want.get(t[s:e], 0) + 1
    assert found == want and len(want) == secrets.SAMPLE_DOCS + 900
    # with the hexadecimal run and the long word beside each, and one planted case in every text with a word
    assert sum(r.n for r in got) == 3 * sum(want.values()) + len(rows) - 2

    def never(*_):
        raise AssertionError("a sample")

    monkeypatch.setattr(secrets, "sample", never)
    monkeypatch.setattr(secrets, "train", never)
    docs.where("doc_id between 0 and 300").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op3_secrets"](spark, str(tmp_path)).where("n_assign = 1").count() == 302


def test_secret_passes_are_as_many_for_many_cases(spark, monkeypatch):
    """No pass is left out where cases are many, and each has all training cases with their numbers."""
    docs = spark.createDataFrame([(i, f"some words stand here token={i % 40:030d}") for i in range(120)], "doc_id bigint, text string")
    monkeypatch.setattr(secrets, "FEW_CASES", 10, raising=False)
    monkeypatch.setattr(secrets, "GROUP_CASES", 500)
    seen, keep = [], secrets._pass
    monkeypatch.setattr(secrets, "_pass", lambda train, groups, *a: seen.append((train.count(), groups)) or keep(train, groups, *a))
    secrets.learn(docs)
    assert len(seen) == secrets.EPOCHS and len(set(seen)) == 1
    assert seen[0][0] > 1500 and seen[0][1] == -(-seen[0][0] // 500)


def test_a_case_counts_as_often_as_it_occurs():
    rng = np.random.default_rng(7)
    x = rng.integers(1, 97, (40, secrets.BEFORE + secrets.BODY + secrets.AFTER))
    flag = (np.arange(x.shape[1]) // 20 == 2).astype(np.float32)[None].repeat(40, 0)
    y, n = (rng.random(40) < 0.5).astype(np.float32), rng.integers(1, 6, 40)
    one, every = (secrets.Training(secrets._fresh()) for _ in range(2))
    for _ in range(2):
        one.learn(x, flag, y, n)
        every.learn(*(np.repeat(v, n, axis=0) for v in (x, flag, y)))
    assert np.allclose(one.m["conv"], every.m["conv"], atol=1e-6) and np.allclose(one.m["embed"], every.m["embed"], atol=1e-6)
    assert not np.allclose(one.m["conv"], 0, atol=1e-4)


def test_secret_curve_and_threshold_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.6).astype(int)
    z, n = np.round(rng.normal(2 * y - 1, 1.5), 2), rng.integers(1, 5, 400)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(z, y, n)], "z double, label int, n long")
    assert np.allclose(secrets._curve(df), toxicity._logistic(z, y, n), rtol=1e-6)
    every = np.sort(np.repeat(z, n))
    for share in (0.0, 0.005, 0.37, 0.999):
        assert secrets._place(df, share) == every[int(share * len(every))]
    assert secrets._place(df.where("z = z").select(F.lit(3.5).alias("z"), "n"), 0.5) == 3.5


def _corpus(words, n, seed):
    rng = random.Random(seed)
    bad = ["idiot", "vequmo", "lowei", "trash", "scumbag", "worthless"]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        if i % 4 == 0:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, int(i % 4 == 0), " ".join(w)))
    return out


def test_toxicity_on_held_out_texts(words):
    rows = _corpus(words, 1200, 1)
    texts = [[t.encode() for _, y, t in rows if y == k] for k in (1, 0)]
    m = toxicity.train(*texts, (300, 900))
    far, gains = toxicity.Distance(m.ordinary, m.toxic), np.array(m.gains)
    test = _corpus(words, 400, 2)
    z = np.array([m.slope * gains[far(t.encode())].sum() + m.shift for *_, t in test])
    y = np.array([r[1] for r in test])
    assert ((z >= 0) == (y == 1)).mean() > 0.95
    assert (z[y == 0] >= 0).mean() < 0.05


def test_toxicity_of_words_made_of_common_syllables():
    rng = random.Random(11)
    tongues = [["an", "er", "on", "th", "sti", "ou", "be", "ng"], ["ach", "lich", "keit", "sch", "ver", "ung", "heit", "zu", "ge", "be", "tz", "pf", "ein", "en", "ie", "er"]]
    bad = [["idiot", "scumbag", "moron"], ["achlichkeit", "achlichver", "achlichung", "achlichheit", "achlichsch"]]

    def text(k, toxic):  # no ordinary word begins with the syllables of a toxic one
        w = ["".join(rng.choices(tongues[k], k=rng.randint(1, 5))) for _ in range(rng.randint(60, 150))]
        w = [x if not x.startswith("achlich") else "ver" + x for x in w]
        for _ in range(rng.randint(4, 7) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad[k]))
        return " ".join(w).encode()

    # one toxic text in ten is of the second language
    toxic = [text(int(i % 10 == 0), True) for i in range(450)]
    m = toxicity.train(toxic, [text(int(i % 3 == 0), False) for i in range(1800)], (450, 1800))
    far, gains = toxicity.Distance(m.ordinary, m.toxic), np.array(m.gains)
    found = lambda k, y: np.mean([m.slope * gains[far(text(k, y))].sum() + m.shift >= 0 for _ in range(150)])
    assert found(0, True) > 0.9 and found(1, True) > 0.4  # none of the second before long grams
    assert found(0, False) < 0.05 and found(1, False) < 0.05


def test_near_copies_of_a_toxic_text_are_one_evidence():
    rng = random.Random(12)
    text = lambda: "".join(rng.choices(string.ascii_lowercase + "  ", k=900)).encode()
    one = text()
    copies = [one[:i] + b" x " + one[i:] for i in range(100, 800, 35)]
    assert len(toxicity._distinct(copies)) == 1
    assert len(toxicity._distinct(others := [text() for _ in range(20)])) == len(others)


def test_windows_cover_the_text_once(words):
    rng = random.Random(3)
    for n in (0, 1, 5, 95, 96, 97, 400, 3000):
        t = " ".join(rng.choice(words) for _ in range(n)).encode()
        assert b"".join(toxicity.windows(t)) == t
    assert b"".join(toxicity.windows(b"x" * 10_000)) == b"x" * 10_000


def test_toxicity_never_learns_from_held_out_rows(spark, awkward, empty, words):
    df, rows = awkward
    docs = spark.createDataFrame([(i, t) for i, _, t in _corpus(words, 200, 4)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in _corpus(words, 200, 4)], "doc_id bigint, toxic int")
    one = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped) == one
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    got = toxicity.scored(df, one).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in toxicity.scored(df, None).collect())
    assert toxicity.scored(empty, one).count() == 0


def test_copies_of_one_id_do_not_reach_the_driver(spark, words, monkeypatch):
    corpus = _corpus(words, 200, 4)
    rows = [(i, t) for i, _, t in corpus]
    labels = spark.createDataFrame([(i, y) for i, y, _ in corpus], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # a third of all rows has one id: copies of its text and texts with a larger hash
    _, mine, least = docs.where("doc_id = 4").select("doc_id", "text", F.xxhash64("text")).first()
    many = spark.createDataFrame([(4, mine)] * 50 + [(4, f"{mine} {i}") for i in range(50)], docs.schema)
    more = docs.union(many.where(F.xxhash64("text") >= least)).repartition(5)
    seen = []
    monkeypatch.setattr(secrets, "train", lambda texts: seen.append(texts))
    monkeypatch.setattr(toxicity, "train", lambda *parts: seen.append(parts))
    for frame in (docs, more):
        secrets.fit(frame)
        toxicity.fit(frame, labels)
    assert more.count() > 240 and len(seen[0]) == 200
    assert seen[2] == seen[0] and seen[3] == seen[1]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "é" * 100_000), (2, None), (3, "short")], "doc_id bigint, text string")
    seen = []
    monkeypatch.setattr(secrets, "train", lambda texts: seen.append(texts))
    secrets.fit(docs)
    # blocks may cut a character, whose bytes are left out
    small, word, long = sorted(len(t.encode()) for t in seen[0])
    assert (small, word) == (0, 5) and (1 << 15) - 200 < long <= 1 << 15


def test_the_sample_covers_whole_texts(spark):
    lines = [f"{i:07d}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, " ".join(lines))], "doc_id bigint, text string")
    got = common.sample(docs, docs.select("doc_id"), "doc_id", "text").first()["t"].decode()
    places = [int(w) for w in got.split() if len(w) == 7]
    assert len(got) <= common.SAMPLE_BYTES and len(places) > 3500
    assert places == sorted(set(places)) and set(map(str, places)) <= {str(i) for i in range(50_000)}
    assert all(any(a <= p < a + 10_000 for p in places) for a in range(0, 50_000, 10_000))


def test_tokens_beside_very_many_findings():
    text = " ".join(f"token={i:08d}abcd and x{i:015d}y" for i in range(20_000))
    base = secrets.base_spans(text)
    tokens = secrets.other_tokens(text, base)
    assert len(base) == len(tokens) == 20_000
    assert all(text[a] == "x" and b - a == 17 for a, b in tokens)
    for spans in ([], [(3, 0, 5), (4, 1, 9), (12, 2, 20)]):
        taken = secrets.Taken(spans)
        for a in range(22):
            for b in range(a + 1, 23):
                assert taken.overlaps(a, b) == any(s < b and a < e for s, _, e in spans)


def test_toxicity_on_the_given_labels(spark):
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = got.join(labels, "doc_id").where("held_out and toxic = 0").agg(F.avg("predicted")).first()[0]
    assert r < 0.02  # few clean texts are taken for toxic
    english = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'").select("doc_id")
    hit = got.join(labels, "doc_id").join(english, "doc_id").where("held_out and toxic = 1").agg(F.avg("predicted")).first()[0]
    assert hit > 0.7


def test_toxicity_finds_held_out_rows_of_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    hit = {r.lang: r.hit for r in got.where("held_out and toxic = 1").groupBy("lang").agg(F.avg("predicted").alias("hit")).collect()}
    assert min(hit.values()) > 0.3 and len(hit) == 4, hit
