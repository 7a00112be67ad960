r"""Secret scan: candidates from patterns, judged by a character convolutional network in numpy.

Candidates are the base findings (assign, access, hex) and every other unbroken
run of TOKEN characters with both letters and digits.  The network reads the
candidate's characters and the text around it: character embeddings and a flag
for "inside the candidate", one convolution, maximum over all positions and mean
over the candidate's, one output.  A candidate longer than BODY is read in pieces
of BODY characters, of which the highest counts.

The query's network learns from every whole text (``learn``): the base findings are
secrets, the long words are not, and in each text PLANTED_LEAST / rows keys of random characters and
look-alikes (numbers, dates, paths, identifiers, joined words) are planted, one at least.
Equal cases are one with their number as its weight; a quarter of the cases, chosen by hash, is
held back.  Each of EPOCHS passes, however many cases there are, deals the others to groups: each group's
task takes the steps over its cases from the same weights, and the groups' weights are averaged.  A logistic curve on all cases held
back, copies counted, calibrates the score, and the threshold is the highest that keeps
RECALL of their secrets; both come from sums and counts that Spark takes.  Base findings are
always reported; other candidates (kind ``generic``) at or above the threshold,
if they don't overlap a base finding.

``fit`` is the smaller way for a driver alone: the same from the texts of SAMPLE_DOCS
documents, long ones in blocks, of which at most FINDINGS on either side.

Most texts are passed over by byte searches: only those with a keyword, the
access prefix, a long hexadecimal run or a long candidate run meet the patterns.

Defined results: null and empty texts have no findings; whole texts of any length
are searched; repeated rows are searched each for itself; an empty table gives an
empty result (the network then knows planted findings only); other columns are
not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import map_arrow, sample, stored, table
from scorewell.session import ship_package

#: Documents that ``fit`` learns from (those with the smallest hash of their id).
SAMPLE_DOCS = 3000
PLANTED = 1500
#: Most labelled findings of one side that ``fit`` trains on (an even draw).
FINDINGS = 6000
#: ``learn``: planted cases over all texts at least; cases of each label on either side of the holding
#: back below which the cases of ``fit`` without texts are added.
PLANTED_LEAST, CASES_LEAST = 2 * PLANTED, 100
#: ``learn``: cases of a group's steps, unless that makes more than MOST_GROUPS.
GROUP_CASES, MOST_GROUPS = 8192, 256
RECALL = 0.995
BEFORE, BODY, AFTER = 24, 48, 12
EMBED, FILTERS, WIDTH = 8, 24, 5
EPOCHS, BATCH, RATE = 8, 128, 0.004

# the base patterns and keywords (fixed values)
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
KINDS = ["assign", "access", "hex", "generic"]

TOKEN_RUN = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_RUN)
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
_CLASS = np.zeros(256, np.uint8)  # bit 0: candidate character, bit 1: hexadecimal digit
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] |= 1
_CLASS[[ord(c) for c in "0123456789abcdef"]] |= 2
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True


# -- candidates
def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is a whole match of [0-9a-f]+, and the other way round
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


class Taken:
    """The places that base findings take, as ordered intervals that don't meet."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in spans:
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)  # the intervals before it begin ahead of ``end``
        return at > 0 and self.ends[at - 1] > start


def other_tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidate runs with letters and digits that overlap no base finding."""
    out, base = [], Taken(taken)
    for m in TOKEN.finditer(text):
        if _LETTER.search(m[0]) and _DIGIT.search(m[0]) and not base.overlaps(*m.span()):
            out.append(m.span())
    return out


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def worth_reading(texts: list[bytes]) -> np.ndarray:
    """Whether each text may have a finding (no finding is missed)."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    out = np.zeros(len(texts), bool)
    kind = _CLASS[flat]
    starts, ends = _runs((kind & 1).astype(bool), TOKEN_RUN)
    digits = np.r_[0, np.cumsum(_IS_DIGIT[flat])]
    hit = starts[digits[ends] > digits[starts]]  # a hexadecimal run of letters alone is found next
    out[np.searchsorted(begins, hit, side="right") - 1] = True
    starts, _ = _runs((kind & 2).astype(bool), 24)
    out[np.searchsorted(begins, starts, side="right") - 1] = True
    for i, t in enumerate(texts):
        if not out[i]:
            low = t.lower()
            out[i] = b"AKIA" in t or any(k in low for k in KEYWORDS)
    return out


# -- network
def codes(text: str) -> list[int]:
    return [c - 31 if 32 <= c < 127 else 96 if c in (9, 10, 13) else 97 for c in map(ord, text)]


def pieces(text: str, start: int, end: int) -> list[tuple[list[int], list[int]]]:
    """(character codes, inside flags) of each BODY piece of a candidate with its surroundings."""
    out = []
    for a in range(start, max(end, start + 1), BODY):
        b = min(end, a + BODY)
        left, right = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        x = [0] * (BEFORE - len(left)) + codes(left) + codes(text[a:b]) + codes(right)
        flag = [0] * BEFORE + [1] * (b - a)
        n = BEFORE + BODY + AFTER
        out.append((x + [0] * (n - len(x)), flag + [0] * (n - len(flag))))
    return out


@dataclass
class Net:
    """Embeddings, convolution and output weights; calibration and threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    curve: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def forward(self, x: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, tuple]:
        seen = np.concatenate([self.embed[x], flag[..., None]], 2)
        cols = np.lib.stride_tricks.sliding_window_view(seen, WIDTH, 1).transpose(0, 1, 3, 2)
        cols = cols.reshape(len(x), -1, WIDTH * (EMBED + 1))
        act = np.maximum(cols @ self.conv + self.bias, 0)
        inside = flag[:, WIDTH // 2 : WIDTH // 2 + act.shape[1]]
        inside = inside / np.maximum(inside.sum(1, keepdims=True), 1)
        top = act.argmax(1)
        high = np.take_along_axis(act, top[:, None], 1)[:, 0]
        mean = np.einsum("nl,nlf->nf", inside, act)
        pooled = np.concatenate([high, mean], 1)
        return pooled @ self.out + self.shift, (cols, act, inside, top, pooled)

    def logits(self, cases: list[list[tuple[list[int], list[int]]]]) -> np.ndarray:
        """One number for each candidate: the highest of its pieces."""
        owner = np.repeat(np.arange(len(cases)), [len(c) for c in cases])
        flat = [p for c in cases for p in c]
        out = np.full(len(cases), -np.inf)
        for i in range(0, len(flat), 1024):
            x, flag = (np.array(z) for z in zip(*flat[i : i + 1024]))
            np.maximum.at(out, owner[i : i + 1024], self.forward(x, flag.astype(np.float32))[0])
        return out

    def scores(self, cases) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.logits(cases) + b, -40, 40)))


def _fresh() -> Net:
    rng = np.random.default_rng(5)
    net = Net(
        rng.normal(0, 0.5, (98, EMBED)).astype(np.float32),
        rng.normal(0, 0.2, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0,
    )
    net.embed[0] = 0
    return net


_WEIGHTS = ["embed", "conv", "bias", "out", "shift"]


class Training:
    """A network on its way: the weights and the moments of their gradients (Adam)."""

    def __init__(self, net: Net):
        self.net, self.step = net, 0
        self.m = {k: getattr(net, k) * 0 for k in _WEIGHTS}
        self.v = {k: getattr(net, k) * 0 for k in _WEIGHTS}

    def learn(self, x: np.ndarray, flag: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
        """One step; ``n`` is how often each case counts."""
        net = self.net
        of = len(y) if n is None else (n.sum() / n)[:, None]
        z, (cols, act, inside, top, pooled) = net.forward(x, flag)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)[:, None] / of).astype(np.float32)
        grad = {"out": (pooled * d).sum(0), "shift": float(d.sum())}
        d_pool = d * net.out
        d_act = inside[:, :, None] * d_pool[:, None, FILTERS:]
        np.put_along_axis(
            d_act, top[:, None], np.take_along_axis(d_act, top[:, None], 1) + d_pool[:, None, :FILTERS], 1
        )
        d_act = d_act * (act > 0)
        grad["conv"] = np.tensordot(cols, d_act, ([0, 1], [0, 1]))
        grad["bias"] = d_act.sum((0, 1))
        d_cols = (d_act @ net.conv.T).reshape(len(y), -1, WIDTH, EMBED + 1)[..., :EMBED]
        grad["embed"] = np.zeros_like(net.embed)
        for w in range(WIDTH):
            np.add.at(grad["embed"], x[:, w : w + d_cols.shape[1]], d_cols[:, :, w])
        grad["embed"][0] = 0
        self.step += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            move = RATE * (self.m[k] / (1 - 0.9**self.step)) / (self.v[k] ** 0.5 / (1 - 0.999**self.step) ** 0.5 + 1e-8)
            setattr(net, k, getattr(net, k) - move)

    def flat(self) -> np.ndarray:
        parts = [np.ravel(of(k)) for of in (lambda k: getattr(self.net, k), self.m.get, self.v.get) for k in _WEIGHTS]
        return np.concatenate([*parts, [self.step]]).astype(np.float64)

    @classmethod
    def of(cls, flat: np.ndarray) -> Training:
        out, at = cls(_fresh()), 0
        shapes = {k: np.shape(getattr(out.net, k)) for k in _WEIGHTS}
        for put in (lambda k, x: setattr(out.net, k, x), out.m.__setitem__, out.v.__setitem__):
            for k, shape in shapes.items():
                size = int(np.prod(shape))
                some = flat[at : at + size].reshape(shape)
                put(k, some.astype(np.float32) if shape else float(some))
                at += size
        out.step = int(flat[at])
        return out


def _train(x: np.ndarray, flag: np.ndarray, y: np.ndarray) -> Net:
    going, rng = Training(_fresh()), np.random.default_rng(6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            going.learn(x[at], flag[at], y[at])
    return going.net


# -- labelled findings
def _planted_key(rng: random.Random) -> str:
    alphabet = rng.choice(["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
                           "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
                           "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "0123456789ABCDEF",
                           "abcdefghijklmnopqrstuvwxyz0123456789"])
    while True:
        body = "".join(rng.choice(alphabet) for _ in range(rng.randint(18, 64)))
        if _DIGIT.search(body) and _LETTER.search(body):
            return rng.choice(["", "", "", "key_", "sk_live_", "tok-"]) + body


def _look_alike(rng: random.Random, words: list[str]) -> str:
    word = lambda: re.sub("[^A-Za-z]", "", rng.choice(words)) or "item"
    kind = rng.randrange(5)
    if kind == 0:
        return "-".join([word().lower() for _ in range(rng.randint(3, 6))] + [str(rng.randint(1, 99))])
    if kind == 1:
        return "/".join([word().lower() for _ in range(rng.randint(2, 5))] + [str(rng.randint(1990, 2030))]).rjust(16, "/")
    if kind == 2:
        return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(100000, 235959)}Z"
    if kind == 3:
        return "_".join(word() for _ in range(rng.randint(3, 5))) + f"_v{rng.randint(1, 20)}"
    return "".join(word().title() for _ in range(rng.randint(3, 7))) + str(rng.randint(0, 2030))


def labelled_findings(texts: list[str]) -> list[tuple[str, int, int, int]]:
    """(text around, start, end, 1 for a secret) from sample texts."""
    rng = random.Random(11)
    out: list[tuple[str, int, int, int]] = []

    def add(text: str, start: int, end: int, label: int) -> None:
        first = max(0, start - BEFORE)
        out.append((text[first : end + AFTER], start - first, end - first, label))

    places: list[tuple[str, int, int]] = []
    for t in texts:
        spans = base_spans(t)
        taken = Taken(spans)
        for s, _, e in spans:
            add(t, s, e, 1)
        for m in TOKEN.finditer(t):
            if not _DIGIT.search(m[0]) and not taken.overlaps(*m.span()):
                add(t, m.start(), m.end(), 0)
        spots = [m.span() for m in re.finditer(r"(?<!\S)\S{3,}", t)]
        if spots:
            places.append((t, *rng.choice(spots)))
    places = places or [("the word here", 4, 8)]
    words = [t[a:b] for t, a, b in places]
    for i in range(2 * PLANTED):
        t, a, b = rng.choice(places)
        new = _planted_key(rng) if i % 2 else _look_alike(rng, words)
        left = t[max(0, a - BEFORE) : a]
        if i % 2 and rng.random() < 0.3:
            left += rng.choice(["key: ", "key = ", "auth=", "bearer "])
        add(left + new + t[b : b + AFTER], len(left), len(left) + len(new), i % 2)
    secrets, others = [x for x in out if x[3]], [x for x in out if not x[3]]
    out = rng.sample(secrets, min(FINDINGS, len(secrets))) + rng.sample(others, min(FINDINGS, len(others)))
    rng.shuffle(out)
    return out


def train(texts: list[str]) -> Net:
    from scorewell.llm.toxicity import _logistic

    cases = labelled_findings(texts)
    inputs = [pieces(t, s, e) for t, s, e, _ in cases]
    y = np.array([c[3] for c in cases], float)
    held = np.arange(len(cases)) % 4 == 3
    flat = [(p, y[i]) for i, c in enumerate(inputs) if not held[i] for p in c]
    x = np.array([p[0] for p, _ in flat])
    flag = np.array([p[1] for p, _ in flat], np.float32)
    net = _train(x, flag, np.array([label for _, label in flat], np.float32))
    back = [c for c, h in zip(inputs, held) if h]
    z = net.logits(back)
    net.curve = _logistic(z, y[held], np.ones(int(held.sum())))
    found = np.sort(net.scores(back)[y[held] == 1])
    net.threshold = float(found[int((1 - RECALL) * len(found))])
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Net:
    chosen = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS)
    rows = sample(docs, chosen, id_col, text_col).select(F.xxhash64("i").alias("h"), "t").collect()
    return train([bytes(r["t"]).decode(errors="ignore") for r in sorted(rows, key=lambda r: (r["h"], r["t"]))])


# -- learning from every text
_SPOT = re.compile(r"(?<!\S)\S{3,}")


def _spot(text: str, rng: random.Random) -> tuple[int, int] | None:
    """A word of three characters or more, drawn by a place in the text."""
    found = _SPOT.search(text, rng.randrange(len(text) + 1)) or _SPOT.search(text)
    return found and found.span()


def text_cases(text: str, base: list[tuple[int, int, int]], seed: int, planted: int) -> list[tuple[str, int, int, int]]:
    """(text around, start, end, 1 for a secret): a whole text's findings and its planted ones."""
    spans = [(s, e, 1) for s, _, e in base]
    taken = Taken(base)
    for m in TOKEN.finditer(text):
        if not _DIGIT.search(m[0]) and not taken.overlaps(*m.span()):
            spans.append((*m.span(), 0))
    out = []
    for s, e, label in spans:
        first = max(0, s - BEFORE)
        out.append((text[first : e + AFTER], s - first, e - first, label))
    rng = random.Random(seed)
    turn = rng.randrange(2)
    for i in range(turn, turn + planted):
        spot = _spot(text, rng)
        if spot is None:
            break
        a, b = spot
        left = text[max(0, a - BEFORE) : a]
        if i % 2:
            new = _planted_key(rng)
            if rng.random() < 0.3:
                left += rng.choice(["key: ", "key = ", "auth=", "bearer "])
        else:
            new = _look_alike(rng, [text[slice(*_spot(text, rng))] for _ in range(6)])
        out.append((left + new + text[b : b + AFTER], len(left), len(left) + len(new), i % 2))
    return out


_CASE = "around string, start int, end int, label int"


def cases(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every different labelled case of all texts: text around, start, end, label, n (how often), h (its hash)."""
    rows = docs.where(F.length(text_col) > 0)
    planted = -(-PLANTED_LEAST // max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [t.as_buffer().to_pybytes() for t in part.column(0)]
                out = []
                for t, worth, seed in zip(raw, worth_reading(raw), part.column(1).to_pylist()):
                    text = t.decode()
                    out += text_cases(text, base_spans(text) if worth else [], seed, planted)
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:]]],
                    ["around", "start", "end", "label"],
                )

    found = map_arrow(rows.select(F.col(text_col), F.xxhash64(id_col, text_col).alias("seed")), run, _CASE)
    case = ["around", "start", "end", "label"]
    return found.groupBy(*case).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64(*case))


def _pass(train: DataFrame, groups: int, turn: int, state: np.ndarray) -> np.ndarray:
    """The state after each group's steps over its cases, averaged by the groups' numbers of cases."""

    def run(table: pa.Table) -> pa.Table:
        from scorewell.llm.secrets import BATCH, Training, pieces

        table = table.sort_by("h")
        order = np.random.default_rng([turn, int(table.column("h")[0].as_py()) & 0xFFFFFFFF]).permutation(table.num_rows)
        going = Training.of(state)
        for i in range(0, len(order), BATCH):
            some = table.take(order[i : i + BATCH]).to_pylist()
            ready = [(p, r["label"], r["n"]) for r in some for p in pieces(r["around"], r["start"], r["end"])]
            for k in range(0, len(ready), 2 * BATCH):  # a long case has many pieces
                part = ready[k : k + 2 * BATCH]
                x, flag = (np.array([p[j] for p, _, _ in part]) for j in (0, 1))
                y, n = (np.array([c[j] for c in part], t) for j, t in ((1, np.float32), (2, np.float64)))
                going.learn(x, flag.astype(np.float32), y, n)
        return pa.table({"n": pa.array([table.num_rows], pa.int64()), "state": pa.array([going.flat().tobytes()], pa.binary())})

    dealt = train.select("around", "start", "end", "label", "n", "h", F.pmod("h", F.lit(groups)).alias("g"))
    got = dealt.groupBy("g").applyInArrow(run, "n long, state binary").collect()
    states = np.stack([np.frombuffer(r["state"]) for r in sorted(got, key=lambda r: (r["n"], bytes(r["state"])))])
    return np.average(states, axis=0, weights=sorted(r["n"] for r in got))


def _curve(scored: DataFrame) -> tuple[float, float]:
    """``toxicity._logistic`` of (z, label, n), each step from sums over the table."""
    a, b = 1.0, 0.0
    z, n = F.col("z"), F.col("n")
    for _ in range(60):
        t = F.lit(a) * z + F.lit(b)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), t))))
        off, v = n * (F.col("label") - p), n * p * (1 - p)
        s = scored.agg(*[F.sum(x) for x in (off * z, off, v * z * z, v * z, v)]).first()
        g = np.array([s[0] - 1e-2 * (a - 1), s[1] - 1e-3 * b])
        step = np.linalg.solve(np.array([[s[2] + 1e-2, s[3]], [s[3], s[4] + 1e-3]]), g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-6), b


def _place(values: DataFrame, share: float) -> float:
    """The z at place int(share * n) (from 0) of (z, n) in order, each z n times; exact, by ever narrower bins."""
    total, lo, hi = values.agg(F.sum("n"), F.min("z"), F.max("z")).first()
    left = int(share * total)
    while lo < hi:
        width = (hi - lo) / 1024
        at = F.least(F.floor((F.col("z") - F.lit(lo)) / F.lit(width)), F.lit(1023))
        bins = (
            values.where(F.col("z").between(lo, hi)).groupBy(at.alias("at"))
            .agg(F.sum("n").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi")).collect()
        )
        for r in sorted(bins, key=lambda r: r["at"]):
            if left < r["n"]:
                break
            left -= r["n"]
        lo, hi = r["lo"], r["hi"]
    return lo


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Net:
    """The network, its curve and its threshold from every labelled case of all whole texts."""
    spark = docs.sparkSession
    ship_package(spark)
    every = stored(cases(docs, id_col, text_col), "secret-cases")
    held = F.pmod(F.shiftrightunsigned("h", 32), F.lit(4)) == 3
    sides = {(r["label"], r["held"]): r["n"] for r in every.groupBy("label", held.alias("held")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sides.get((y, h), 0) for y in (0, 1) for h in (True, False)) < CASES_LEAST:
        plain = spark.createDataFrame(labelled_findings([]), _CASE).groupBy("around", "start", "end", "label").agg(F.count(F.lit(1)).alias("n"))
        every = stored(every.unionByName(plain.withColumn("h", F.xxhash64("around", "start", "end", "label"))), "secret-cases")
    train = every.where(~held)
    n = train.count()
    groups = min(MOST_GROUPS, -(-n // GROUP_CASES))
    state = Training(_fresh()).flat()
    for turn in range(EPOCHS):
        state = _pass(train, groups, turn, state)
    net = Training.of(state).net

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                around, start, end = (part.column(c).to_pylist() for c in range(3))
                z = net.logits([pieces(*c) for c in zip(around, start, end)])
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), part.column(3), part.column(4)], ["z", "label", "n"])

    back = map_arrow(every.where(held).select("around", "start", "end", "label", "n"), run, "z double, label int, n long")
    scored = stored(back, "secret-scores")
    net.curve = _curve(scored)
    a, b = net.curve
    net.threshold = float(1 / (1 + np.exp(-np.clip(a * _place(scored.where("label = 1"), 1 - RECALL) + b, -40, 40))))
    return net


def findings(df: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, findings as array of (start, rank, end, kind, score), sorted."""
    entry = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
                out: list[list[dict]] = [[] for _ in raw]
                spans, cases = [], []
                for k in np.flatnonzero(worth_reading(raw)):
                    text = raw[k].decode()
                    base = base_spans(text)
                    for s, r, e in base + [(s, 3, e) for s, e in other_tokens(text, base)]:
                        spans.append((k, s, r, e))
                        cases.append(pieces(text, s, e))
                if cases:
                    for (k, s, r, e), score in zip(spans, net.scores(cases)):
                        if r < 3 or score >= net.threshold:
                            out[k].append({"start": s, "rank": r, "end": e, "kind": KINDS[r], "score": float(score)})
                for x in out:
                    x.sort(key=lambda f: (f["start"], f["rank"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(entry))], ["id", "findings"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(
        df.select(id_col, text_col), run,
        f"id {kind}, findings array<struct<start:int,rank:int,end:int,kind:string,score:double>>",
    )


def op3_secrets(spark, sf_dir):
    from scorewell.llm.pii import span_string

    docs = table(spark, sf_dir, "documents")
    found = findings(docs, learn(docs))
    count = lambda name: F.size(F.filter("findings", lambda f: f["kind"] == name)).cast("long")
    base = F.filter("findings", lambda f: f["rank"] < 3)
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"),
        span_string(F.col("findings")).alias("spans"),
    )
