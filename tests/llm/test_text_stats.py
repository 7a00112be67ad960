"""Native operators against brute force: sharding, exact dedup, PII, quality rules."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewell.llm import exact_dedup, pii, quality, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_sharding_is_a_shuffle_by_key(spark, awkward, tmp_path):
    df, rows = awkward
    done = sharding.write_shards(df, str(tmp_path / "s"), n_shards=5, bucket_bytes=20_000)
    assert (done.shard, done.bucket, done.place) == ("_shard", "bucket", "place")
    got = done.with_slots("doc_id", "text", "row", "shard").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(r[:2] for r in rows)
    for s in range(5):
        mine = sorted(r.slot for r in got if r["_shard"] == s)
        assert mine == list(range(len(mine)))
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r["_shard"])
    assert all(len(s) == 1 for s in by_id.values())
    files = done.records.select("_shard", "bucket").distinct().count()
    assert files > 5  # buckets, not whole shards, are held in memory


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    r = ids.select(sharding.shard_of("doc_id", 16).alias("a"), sharding.shard_of("doc_id", 17).alias("b"))
    n = {x["a"]: x["count"] for x in r.groupBy("a").count().collect()}
    assert set(n) == set(range(16)) and max(n.values()) < 1.15 * min(n.values())
    assert r.where("b <> a and b <> 16").count() == 0
    assert 900 < r.where("b = 16").count() < 1500


def test_a_hot_id_spreads_over_buckets(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.range(6000).select(F.lit(7).alias("doc_id"), F.lit("same text").alias("text")).write.parquet(path)
    done = sharding.write_shards(spark.read.parquet(path), str(tmp_path / "out"), 2, bucket_bytes=3000)
    sizes = [r["count"] for r in done.records.groupBy("bucket").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2 * 6000 / len(sizes) and len(sizes) > 5
    one = [r.place for r in done.records.where(F.col("bucket") == 0).collect()]
    assert sorted(one) == list(range(len(one)))


def test_buckets_of_a_hot_id_hold_the_bound(spark, tmp_path):
    """One id has all rows: its shard gets the buckets, the others one each."""
    path = str(tmp_path / "one")
    spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("x" * 499).alias("text")).write.parquet(path)
    done = sharding.write_shards(spark.read.parquet(path), str(tmp_path / "out"), 16, bucket_bytes=100_000)
    rows = done.records.groupBy("shard", "bucket").count().collect()
    assert len({r["shard"] for r in rows}) == 1 and len(rows) == 20
    assert sum(r["count"] for r in rows) == 4000 and max(r["count"] for r in rows) * 500 < 1.35 * 100_000


def test_sharding_query_equals_brute_force(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        want.add((r.doc_id, len(raw) + 1, zlib.crc32(raw)))
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    tried = ids.select("doc_id", *[F.xxhash64(F.lit(sharding.SEED), "doc_id", F.lit(n)).alias(f"h{n}") for n in range(17)]).collect()
    home = lambda r, n: max((k for k in range(n) if r[f"h{k}"] % (k + 1) == 0), default=0)
    homes = {r.doc_id: (home(r, 16), home(r, 17)) for r in tried}
    got = sharding.op1_sharding(spark, SF).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == want
    assert len(got) == ids.count()
    assert all((r.shard, r.grown_shard) == homes[r.doc_id] and r.law == "key" for r in got)
    for s in range(16):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))


def test_sharding_of_an_empty_table(empty, tmp_path):
    assert sharding.write_shards(empty, str(tmp_path / "e"), 3).with_slots().count() == 0


def test_exact_dedup_keeps_the_longest_then_smallest(awkward):
    df, rows = awkward
    got = exact_dedup.duplicates(df).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        g = by_sha[r.sha]
        assert r.group_size == len(g) and r.keep_id == min(g)[2]
    for sha in by_sha:
        assert sum(r.kept for r in got if r.sha == sha) == 1


def test_exact_dedup_drop_keeps_columns(awkward, empty):
    df, rows = awkward
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows})
    assert exact_dedup.drop_duplicates(empty).count() == 0 and exact_dedup.duplicates(empty).count() == 0


def test_exact_dedup_runs_of_a_hot_group(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")
    ).repartition(40).write.parquet(path)
    got = exact_dedup.duplicates(spark.read.parquet(path))
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 and keep_id = 0").count() == 1000


def _luhn(d):
    total = 0
    for i, ch in enumerate(reversed(d)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
]


def plain_spans(text):
    return sorted(
        (m.start(), r, m.end(), k) for r, (k, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m.group())
    )


TRICKY = [
    "a@b.c_d@e.f,g@h.i..j@k", "@@a@b.c", "x@y", "1.2.3.4.5.6.7.8", "1.2.3", "999.1.1.1 10.0.0.1", "00000000255.1.1.1",
    "4111111111111111 4111-1111-1111-1111 4111  1111", "+1-202-555-0143 ++4412345678901)", "+1 2", "é@é.é ü 1.1.1.1 ö+12 345 678 901",
    "a" * 30_000, "1" * 20_000, "." * 9000 + "@", "1-" * 9000, "a.b" * 8000 + "@x.y", "+" * 5000, "4111111111111111" * 2, "0000 0000 0000 00",
]


def test_pii_base_spans_equal_the_plain_patterns(spark, awkward):
    df, rows = awkward
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id bigint, text string")
    both = df.select("doc_id", "text").union(extra)
    for r in pii.scored_spans(both).collect():
        base = [(s.start, s.rank, s.end, s.kind) for s in r.pii if s.base]
        assert base == plain_spans(r.text or ""), (r.text or "")[:50]
        for s in r.pii:
            assert s.match == r.text[s.start : s.end] and 0 < s.score <= 1


def test_pii_checksums_and_context(spark):
    texts = ["iban GB82WEST12345698765432", "GB82WEST12345698765433", "ssn: 123-45-6789", "part 123-45-6789",
             "card 4111111111111111", "4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.pii] for r in pii.scored_spans(df).collect()}
    assert [k for k, _ in got[0]] == ["iban"] and got[1] == []
    assert [k for k, _ in got[2]] == ["ssn"] and got[3] == []
    assert got[4] == [("card", 1.0)] and got[5] == [("card", 0.8)]


def test_pii_redaction(spark, awkward, empty):
    df = spark.createDataFrame([(1, "to a@b.cc, call +1-202-555-0143!"), (2, None), (3, "")], "doc_id int, text string")
    assert [r.text for r in pii.redacted(df).orderBy("doc_id").collect()] == ["to <email>, call <phone>!", None, ""]
    whole, rows = awkward
    out = pii.redacted(whole)
    assert out.columns == whole.columns and out.count() == len(rows)
    assert pii.redacted(empty).count() == 0
    assert not out.where("text like '%4111 1111%' or text like '%@d-e.example%'").count()


def plain_statistics(text):
    w = WORD.findall(text)
    triples = list(zip(w, w[1:], w[2:]))
    n = collections.Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if n[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_statistics_and_verdicts(spark, awkward, empty):
    df, rows = awkward
    labels = spark.createDataFrame([(i, 1) for i in range(20, 50)] + [(17, 0), (None, 1)], "doc_id bigint, quality int")
    model, threshold = quality.fit(df, labels)
    assert len(model) == quality.BUCKETS and any(model)
    got = quality.judged(df.drop("kept"), model, threshold).collect()
    assert len(got) == len(rows)
    for r in got:
        assert plain_statistics(r.text or "") == (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        )
        assert r.kept == (not r.base_failed and r.score >= threshold)
    assert all(r.kept for r in got if r.doc_id in range(20, 50))
    assert quality.judged(empty.drop("kept"), model, threshold).count() == 0
    nothing, at = quality.fit(df, labels.where("false"))
    assert not any(nothing) and at == float("-inf")


def test_quality_score_is_the_mean_log_ratio(spark, tmp_path):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad junk"), (3, "good junk")], "doc_id bigint, text string")
    model = [0] * quality.BUCKETS
    feats = quality.with_words(docs, "text", "w").select("doc_id", quality.features("w").alias("f")).collect()
    for k, r in enumerate(feats):
        for f in r.f:
            model[f - 1] += (k + 1) * 1000
    scored = quality.with_score(quality.with_words(docs, "text", "w"), model, "w", "s").collect()
    for r, x in zip(feats, scored):
        assert abs(x.s - sum(model[f - 1] for f in r.f) / len(r.f) / 1e6) < 1e-12


def test_quantile_covers_every_row(spark, tmp_path):
    values = [float(v) for v in np.random.default_rng(5).normal(size=701)]
    path = str(tmp_path / "v.parquet")
    spark.createDataFrame([(v,) for v in values], "v double").repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    for share in (0.0, 0.002, 0.37, 1.0):
        assert quality.quantile(df, "v", share) == pytest.approx(float(np.quantile(values, share)), abs=1e-12)
    assert quality.quantile(df.where("v > 100"), "v", 0.5) is None


def test_pii_with_very_many_matches_in_one_text(spark):
    """Near-linear work: the whole text's spans and marks equal a plain walk over it."""
    import time

    text = " ".join(f"u{i}@host{i % 7}.example.com" if i % 3 else f"write ü {i}.2.3.4" for i in range(32_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = pii.scored_spans(df).collect()
    (marked,) = pii.redacted(df).collect()
    assert time.time() - began < 60
    want = [(m.start(), m.end(), "email", m.group()) for m in re.finditer(r"u\d+@host\d\.example\.com", text)]
    want += [(m.start(), m.end(), "ip", m.group()) for m in re.finditer(r"\d+\.2\.3\.4", text) if int(m.group().split(".")[0]) < 256]
    got = [(s.start, s.end, s.kind, s.match) for s in r.pii]
    assert got == sorted(want)
    out, at = [], 0
    for a, b, kind, _ in got:
        out += [text[at:a], f"<{kind}>"]
        at = b
    assert marked.text == "".join(out) + text[at:]


def test_pii_context_is_the_text_around_a_span(spark):
    rng = random.Random(12)
    parts = ["mail", "x" * 60, "a@b.cd", "1.2.3.4", "host", "é🙂", "12", "3 4", "tel", "+49 30 1234567", "no", "Contact:", "server"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts, kinds = dict(rows), {k.name: k for k in pii.KINDS}
    seen = set()
    for r in pii.scored_spans(df).collect():
        t = texts[r.doc_id]
        for s in r.pii:
            k = kinds[s.kind]
            around = t[max(0, s.start - pii.CONTEXT):s.start] + " " + t[s.end:s.end + pii.CONTEXT]
            near = re.search(f"(?i)(?<![a-z])(?:{k.words})", around) is not None
            assert s.score == pytest.approx(min(1.0, k.score + 0.3 * near)) and t[s.start:s.end] == s.match
            seen.add((s.kind, near))
    assert len(seen) >= 6
