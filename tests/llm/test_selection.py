"""Best-fit packing, importance resampling and the filter audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorewell.llm import best_fit, filter_audit, packing, resampling
from scorewell.llm.crc_table import BLOCK, span_crcs

SMALL = "/root/testdata/sf0.001"


# --- 11: minimum bin slack --------------------------------------------------


def best_fill(counts, room):
    """The largest sum up to ``room`` of a sub-multiset, by trying all."""
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 5), max_size=8), st.integers(0, 40))
def test_fullest_combination(counts, room):
    got = best_fit.fullest(counts, sorted(counts, reverse=True), room)
    assert all(k <= counts[n] for n, k in got)
    assert sum(n * k for n, k in got) == best_fill(counts, room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_bins_hold_every_piece_once(counts):
    bins = best_fit.minimum_slack(counts, 64)
    held = Counter()
    for content, times in bins:
        assert sum(n * k for n, k in content) <= 64
        for n, k in content:
            held[n] += k * times
    assert held == Counter(counts)
    slots = best_fit.Slots(bins)
    used = defaultdict(list)
    for n, c in counts.items():
        seq, off = slots.find(np.full(c, n), np.arange(c))
        for s, o in zip(seq.tolist(), off.tolist()):
            used[s].append((o, n))
    assert sorted(used) == list(range(sum(t for _, t in bins)))
    for content in used.values():
        at = 0
        for o, n in sorted(content):
            assert o == at
            at += n


def first_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        at = next((k for k, b in enumerate(bins) if b + n <= capacity), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    return len(bins)


def check_packing(rows, texts, capacity=best_fit.SEQUENCE):
    """``rows`` (id, piece, start, length, crc, seq, offset) against the tokenizers library; sequences used and least possible."""
    exact = Tokenizer.from_file(packing.default_paths()[0])
    want = Counter()
    total = 0
    for i, t in texts:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [best_fit.END_ID]
        total += len(ids)
        start = 0
        for k, n in enumerate(best_fit.piece_lengths(len(ids), capacity)):
            part = np.array(ids[start : start + n], "<u4")
            want[(i, k, start, n, zlib.crc32(part.tobytes()))] += 1
            start += n
    assert Counter(tuple(r)[:5] for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for content in seqs.values():
        at = 0
        for o, n in sorted(content):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), -(-total // capacity)


def test_packing_of_awkward_rows(awkward, empty):
    df, rows = awkward
    texts = [(r[0], r[1]) for r in rows]
    used, least = check_packing(best_fit.packed(df).collect(), texts)
    assert used <= least + 1
    out = best_fit.packed(df, capacity=256, with_ids=True).collect()
    used, _ = check_packing(out, texts, 256)
    assert used <= first_fit_decreasing([r.length for r in out], 256)
    assert all(len(r.ids) == r.length for r in out)
    assert best_fit.packed(empty).count() == 0


def test_packing_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    used, least = check_packing(best_fit.op11_best_fit(spark, SMALL).withColumnRenamed("doc_id", "id").collect(), docs)
    assert used <= least + 1


def test_a_length_that_leaves_no_fill():
    bins = best_fit.minimum_slack({1500: 4, 2048: 3}, 2048)
    assert bins == [([(2048, 1)], 3), ([(1500, 1)], 4)]
    assert best_fit.minimum_slack({}, 2048) == []


# --- 12: position-table CRC and resampling ----------------------------------


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=900), st.data())
def test_span_crcs(raw, data):
    n = data.draw(st.integers(1, 12))
    starts, ends = [], []
    for _ in range(n):
        a = data.draw(st.integers(0, len(raw) - 1))
        starts.append(a)
        ends.append(data.draw(st.integers(a + 1, len(raw))))
    got = span_crcs(np.frombuffer(raw, np.uint8), np.array(starts), np.array(ends))
    assert got.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)]


def test_span_crcs_of_long_spans():
    raw = random.Random(3).randbytes(3_000_000)
    spans = [(0, len(raw)), (5, 6), (17, 17 + BLOCK), (17, 18 + BLOCK), (1, len(raw) - 2)]
    got = span_crcs(np.frombuffer(raw, np.uint8), *map(np.array, zip(*spans)))
    assert got.tolist() == [zlib.crc32(raw[a:b]) for a, b in spans]


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resampling(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, brute_features(x)[1]))
    for x in target:
        t.update(map(bucket, brute_features(x)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, x in docs:
        words, feats = brute_features(x)
        weight = sum(gain(bucket(f)) for f in feats)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(feats), weight, score, None, len(words)])
    fit = [r for r in rows if r[5] >= least]
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_of_the_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = resampling.op12_resampling(spark, SMALL).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute_resampling(docs, target)
    assert Counter(map(tuple, got)) == want
    assert sum(r[4] is not None for r in want) > 5


def test_resampling_of_awkward_rows(awkward, empty):
    df, rows = awkward
    texts = [(r[0], r[1]) for r in rows]
    got = resampling.resampled(df, df, percent=50).collect()
    assert Counter(map(tuple, got)) == brute_resampling(texts, [t for _, t in texts], percent=50)
    got = resampling.resampled(df, empty).collect()
    assert Counter(map(tuple, got)) == brute_resampling(texts, [])
    assert resampling.resampled(empty, df).count() == 0


def test_words_in_windows(monkeypatch):
    """Small windows cut texts and features anywhere; long words make windows of their own."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "Bé", "x" * 300, "漢字", "7"]) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    texts += ["", "b" * 5000, "!?", "A", "a b"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    parts = resampling.words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [Counter(zlib.crc32(f.encode()) % 10000 for f in brute_features(t)[1]) for t in texts]
    for window in (1, 3, 1 << 14):
        monkeypatch.setattr(resampling, "SPANS_AT_ONCE", window)
        got = [Counter() for _ in texts]
        for text, bucket in resampling.features(*parts, 10000):
            for i, b in zip(text.tolist(), bucket.tolist()):
                got[i][b] += 1
        assert got == want


# --- 13: filter audit -------------------------------------------------------


def brute_audit(rows, labels):
    """``rows`` (id, text, part); ``labels`` id -> (good, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failing = []
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        failing.append((p or "", f, *labels.get(i, (0, 0))))
    out = {}
    for part in {p for p, *_ in failing}:
        mine = [x for x in failing if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                here = [x for x in left if x[1][c]]
                left = [x for x in left if not x[1][c]]
                fails = [x for x in mine if x[1][c]]
                out[part, order, step] = [
                    len(left), len(here), len(fails) - len(here), sum(sum(x[1].values()) == 1 for x in fails),
                    sum(x[2] for x in here), sum(x[3] for x in here),
                ]
        total = Counter()
        for (p, order, step), v in out.items():
            if p == part:
                total[order[step - 1]] += v[1]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def as_table(frame):
    return {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in frame.collect()}


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(
        [(20, 1, 0), (21, 0, 1), (22, 1, 1), (5, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )


def test_audit_of_awkward_rows(awkward, empty, labelled):
    df, rows = awkward
    texts = [(r[0], r[1], r[2]) for r in rows]
    want = brute_audit(texts, {20: (1, 0), 21: (0, 1), 22: (1, 1), 5: (1, 1)})
    assert as_table(filter_audit.audited(df, labelled, part_col="row")) == want
    assert len(want) == 3 * 600
    assert filter_audit.audited(empty, labelled, part_col="row").count() == 0


def test_audit_of_copies_null_parts_and_ids(spark, labelled, tmp_path):
    rng = random.Random(6)
    prose = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, n)) for _ in range(120)) for n in (5, 999)]
    texts = [None, "", "A", "a#", *prose, prose[1].upper(), prose[1] + " &"]
    rows = [(i % 30 if i % 7 else None, rng.choice(texts), rng.choice(["x", "", None])) for i in range(150)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4).write.parquet(path)
    got = as_table(filter_audit.audited(spark.read.parquet(path), labelled))
    assert got == brute_audit(rows, {20: (1, 0), 21: (0, 1), 22: (1, 1), 5: (1, 1)})
    assert {p for p, *_ in got} == {"x", ""}


def test_removal_steps_are_the_first_failing_filter():
    steps = filter_audit.removal_steps()
    for mask in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            want = [s for s, c in enumerate(order) if mask >> "ABCDE".index(c) & 1]
            assert steps[mask, k] == (want[0] if want else 5)
