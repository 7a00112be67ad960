r"""Personal data: regular expressions propose spans, checksums confirm, context adjusts the score.

Everything is a column expression.  Spark's regular expressions return matches
without positions, so a kind's matches (``regexp_extract_all``) are laid beside
the gaps between them (``split`` by the same pattern): a match starts after all
earlier gaps and matches.  Positions are code points.

The patterns match what the plain contract forms match.  ``\G`` or a look-behind
lets a run of allowed characters be tried once, from its start, and possessive
repeats keep no way back; so a text of one very long run costs linear time and no
stack.

Kinds of the base (always kept): email, ip (each part at most 255), card (14 to
19 digits, Luhn) and phone (10 to 15 digits).  The method adds: iban (two
letters, two check digits, 11 to 30 letters or digits, mod-97 remainder 1) and
ssn (3-2-4 digits), which has no checksum and so needs a context word nearby to
reach the threshold.

Defined results: null text counts as empty (no spans); an empty table gives an empty
one; the result has one row per input row, repeated rows too; columns besides id and
text are not read.  n matches in one text cost n^1.5 small steps, not n^2 copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import private, table, text_or_empty

THRESHOLD = 0.5
#: Code points on either side in which a context word counts.
CONTEXT = 48
#: Code points a block of a text to be marked holds.
BLOCK = 1024


@dataclass
class Kind:
    name: str
    pattern: str
    hint: str  # a plain test that texts without a match mostly fail
    valid: object  # Column -> Column
    score: float  # of a confirmed span
    words: str  # context words, as a pattern
    base: bool = True


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return m.rlike(f"^{part}(?:\\.{part}){{3}}$")


def _iban_ok(m: Column) -> Column:
    turned = F.concat(F.substr(m, F.lit(5)), F.substr(m, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda acc, c: F.when(c == "", acc).otherwise(
            F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))
        ),
    )
    return rest == 1


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip_ok, 0.7, "ip|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9 -]{12}",
         lambda m: F.char_length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)), 0.8, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+",
         lambda m: F.char_length(_digits(m)).between(10, 15), 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",
         _iban_ok, 0.8, "iban|account|bank", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"), 0.3, "ssn|social|security|tax", base=False),
]


def _hinted(k: Kind, text: Column) -> Column:
    return text.contains(k.hint) if len(k.hint) == 1 else text.rlike(k.hint)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once for a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op) -> Column:
    """Running results of ``op`` (adding or the larger of two) over an array of counts.

    Runs of about the square root of its length are done apart, so n values cost n^1.5
    small steps: growing one array value by value would copy it n times.
    """
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))")

    def inside(v):
        run = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        first = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, run)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(first, lambda i: F.aggregate(
            F.slice(v, i + 1, run), start,
            lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out")),
        ))

    def joined(runs):
        before = F.aggregate(
            runs, start,
            lambda acc, p: F.struct(op(acc["at"], p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(runs, before, lambda p, at: F.transform(p["out"], lambda x: op(x, at))))

    return _let(_let(values, inside), joined)


def _short(piece: Column) -> Column:
    """What a context can show of a piece of text: all of it, or its two ends."""
    long = F.char_length(piece) > 2 * CONTEXT
    return F.when(long, F.concat(F.substr(piece, F.lit(1), F.lit(CONTEXT)), F.right(piece, F.lit(CONTEXT)))).otherwise(piece)


#: Pieces (gaps and matches of two code points or more) that surely fill a context.
AROUND = CONTEXT + 2


def scored_spans(df: DataFrame, text_col: str = "text", out: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``out``: array of (start, rank, end, kind, base, score, match), sorted.

    A base span is always there; a span of the method's own kinds needs a score of
    ``threshold``.  Score: the kind's, plus 0.3 with a context word within CONTEXT
    code points, at most 1.
    """
    kinds = [k.name for k in KINDS]
    txt, *names = private(df, "pii_text", *[f"pii_{a}_{k}" for a in ("m", "g") for k in kinds])
    m, g = dict(zip(kinds, names)), dict(zip(kinds, names[len(kinds):]))
    none = F.expr("array()").cast("array<string>")
    work = df.withColumn(txt, text_or_empty(text_col))
    work = work.withColumns({
        m[k.name]: F.when(_hinted(k, F.col(txt)), F.regexp_extract_all(txt, F.lit(k.pattern), F.lit(0))).otherwise(none)
        for k in KINDS
    })
    work = work.withColumns({
        g[k.name]: F.when(F.size(m[k.name]) > 0, F.split(txt, k.pattern, -1)).otherwise(none) for k in KINDS
    })


    def of(rank: int, k: Kind) -> Column:
        mk, gk = F.col(m[k.name]), F.col(g[k.name])
        lengths = F.zip_with(F.slice(gk, F.lit(1), F.size(mk)), mk, lambda a, b: F.char_length(a) + F.char_length(b))
        # gap, match, gap, match, ...: a kind's i-th match is piece 2 i + 1
        pieces = F.flatten(F.zip_with(gk, mk, lambda a, b: F.array(_short(a), _short(F.coalesce(b, F.lit(""))))))
        matched = F.transform(
            F.zip_with(mk, _running(lengths, lambda a, b: a + b), lambda t, end: F.struct(t.alias("match"), end.alias("end"))),
            lambda s, i: F.struct(
                i.alias("i"), (s["end"] - F.char_length(s["match"])).alias("start"), s["end"].alias("end"), s["match"].alias("match")
            ),
        )
        return _let(pieces, lambda around: scored(rank, k, matched, around))

    def scored(rank: int, k: Kind, matched: Column, pieces: Column) -> Column:
        def near(s: Column) -> Column:
            at = s["i"] * 2 + 1
            join = lambda first, n: F.array_join(F.slice(pieces, first, n), "")
            around = F.concat(
                F.right(join(F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND))), F.lit(CONTEXT)), F.lit(" "),
                F.substr(join(at + 2, F.lit(AROUND)), F.lit(1), F.lit(CONTEXT)),
            )
            return around.rlike(f"(?i)(?<![a-z])(?:{k.words})")

        made = F.transform(
            F.filter(matched, lambda s: k.valid(s["match"])),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                F.lit(k.name).alias("kind"), F.lit(k.base).alias("base"),
                F.least(F.lit(k.score) + F.when(near(s), 0.3).otherwise(0.0), F.lit(1.0)).alias("score"),
                s["match"].alias("match"),
            ),
        )
        return made if k.base else F.filter(made, lambda s: s["score"] >= threshold)

    every = F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))
    return work.withColumn(out, every).drop(txt, *names)


def redacted(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with every span's text replaced by its kind in angle brackets.

    Spans that overlap an earlier one are covered by the earlier one's mark: the
    text continues where the furthest span so far ends.
    """
    (pii,) = private(df, "pii")
    found = scored_spans(df, text_col, pii, threshold)
    text = F.col(text_col)

    def masked(spans: Column, until: Column, blocks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            whole = F.array_join(F.slice(blocks, first + 1, F.floor(b / BLOCK).cast("int") - first + 1), "")
            return F.substr(whole, a - first * BLOCK + 1, b - a)

        marked = F.zip_with(
            spans, F.concat(F.array(F.lit(0)), F.slice(until, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0)))),
            lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(
                F.concat(cut(at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))
            ),
        )
        return F.concat(F.array_join(marked, ""), F.substr(text, F.get(until, F.size(spans) - 1) + 1))

    # blocks of code points, so that a piece is cut without a walk from the text's start
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = _let(F.col(pii), lambda spans: _let(
        _running(F.transform(spans, lambda s: s["end"]), F.greatest),
        lambda until: _let(blocks, lambda b: masked(spans, until, b)),
    ))
    return found.withColumn(text_col, F.when(F.size(pii) > 0, whole).otherwise(text)).drop(pii)


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark, sf_dir):
    found = scored_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"),
        span_string(F.col("pii")).alias("spans"),
    )
