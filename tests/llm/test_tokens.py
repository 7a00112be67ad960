"""SentencePiece and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scorewell.llm import packing, pieces

PIECES = pieces.model(pieces.default_model())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def check_texts(texts):
    for t, ids in zip(texts, PIECES.encode(texts)):
        want = LIBRARY.encode(t)
        assert ids.tolist() == want, t[:80]
        assert PIECES.decode(want) == LIBRARY.decode(want), t[:80]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabcdehinorst  .,▁\n0é漢🙂\x00"), max_size=60), max_size=5))
def test_pieces_equal_the_library(texts):
    check_texts(texts)


def test_pieces_on_joined_vocabulary_and_long_runs():
    rng = random.Random(2)
    some = [t for t in PIECES.texts if len(t) > 1 and t[0] != "<"]
    texts = ["".join(rng.choice(some).replace("▁", rng.choice([" ", ""])) for _ in range(50)) for _ in range(1500)]
    check_texts(texts + ["a" * 30_000, " " * 5000, "ab" * 9000, "\n" * 400, "x" * (pieces.CHUNK + 10), "", "é" * 3000])


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_pieces_of_words_that_polynomial_hashes_confuse():
    for n in (1024, 2048, 4096, 8192):
        check_texts([thue_morse(n), thue_morse(n, "ba"), thue_morse(n) + " " + thue_morse(n, "ba"), thue_morse(n, "xy")])


def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(pieces, "segment_hashes", lambda values, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    rng = random.Random(5)
    check_texts(["".join(rng.choice("abc de.") for _ in range(200)) for _ in range(20)] + ["", "a", "b", "ab", "ba"])


def test_pieces_of_awkward_rows(awkward, empty):
    df, rows = awkward
    got = {}
    for r in pieces.digests(df).collect():
        got.setdefault(r.id, []).append(tuple(r[1:]))
    for i in {r[0] for r in rows}:
        want = []
        for t in [x[1] or "" for x in rows if x[0] == i]:
            ids = LIBRARY.encode(t)
            want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
        assert sorted(got[i]) == sorted(want)
    whole = pieces.encoded(df.where("doc_id = 4")).first()
    assert whole.ids == LIBRARY.encode(whole.decoded)
    assert pieces.digests(empty).count() == 0


def test_decode_of_bytes_that_are_no_text():
    ids = [int(PIECES.byte_id[0xFF]), int(PIECES.byte_id[0xC3])]
    assert PIECES.decode(ids) == "\ufffd\ufffd"
    assert PIECES.decode([]) == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([1, 8, 64, 2048]))
def test_pack_covers_every_token_once_without_padding(lengths, capacity):
    seen = {}
    for seq in packing.pack(lengths, capacity):
        n = sum(x[2] for x in seq)
        assert n == capacity or (n < capacity and n & (n - 1) == 0)
        for d, start, part in seq:
            seen.setdefault(d, []).append((start, part))
    for d, n in enumerate(lengths):
        at = 0
        for start, part in sorted(seen[d]):
            assert start == at and part > 0
            at += part
        assert at == n


def test_tournament_finds_the_first_bin_with_room():
    rng = random.Random(3)
    tree, free = packing.Tournament(37, 100), [100] * 37
    for _ in range(60):
        need = rng.randint(1, 60)
        want = next((i for i, f in enumerate(free) if f >= need), None)
        if want is not None:
            assert tree.take(need) == want
            free[want] -= need


def test_most_documents_stay_whole():
    rng = random.Random(5)
    lengths = [rng.randint(20, 700) for _ in range(1000)]
    assert sum(map(len, packing.pack(lengths))) < 1100


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbZ 19'\n\t.,éß漢🙂\u3000\xa0slrvmtd\x00"), max_size=80))
def test_encoder_equals_tokenizers(text):
    assert ENCODE(text).tolist() == EXACT.encode(text, add_special_tokens=False).ids


ENCODE = packing.encoder(*packing.default_paths())
EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_of_awkward_rows(awkward, empty):
    df, rows = awkward
    got = packing.packed(df, group_tokens=6000, with_ids=True).collect()
    assert EXACT.encode("a<|endoftext|>b", add_special_tokens=False).ids == ENCODE("a<|endoftext|>b").tolist()
    want = sorted((str(i), tuple(EXACT.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows)
    # rows with one id: pieces are told apart by walking their starts
    loose = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        loose.setdefault((str(r.id), r.doc_tokens), []).append(r)
    total = sum(len(x[1]) for x in want)
    assert sum(r.length for r in got) == total
    for i, ids in want:
        parts = sorted(loose[(i, len(ids))], key=lambda r: r.start)
        if len({r.start for r in parts}) == len(parts):
            assert tuple(x for r in parts for x in r.ids) == ids
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rs[0].sequence_length and (at == 2048 or at & (at - 1) == 0)
    assert packing.packed(empty).count() == 0
