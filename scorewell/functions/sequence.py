"""C1-C3 as Column expressions (JVM-side, no Python per row).

k-mers follow the character n-gram rule of the reference's vectorizer:
lowercase, collapse runs of 2+ whitespace characters into one space, then
every substring of length n for n in [lo, hi] (n capped by the text length).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: "two or more whitespace characters" (Unicode whitespace plus the
# \x1c-\x1f separators, which the reference's regex engine also treats as space).
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gc_content(seq) -> Column:
    """Share of G and C after uppercasing; empty -> 0."""
    s = F.upper(_col(seq))
    n = F.length(s)
    gc = 2 * n - F.length(F.replace(s, F.lit("G"), F.lit(""))) - F.length(F.replace(s, F.lit("C"), F.lit("")))
    return (gc / F.greatest(n, F.lit(1))).cast("double")


def seq_length(seq) -> Column:
    """Number of characters."""
    return F.length(_col(seq)).cast("double")


def normalize_text(seq) -> Column:
    """Lowercase + whitespace-run collapse (the vectorizer's preprocessing)."""
    return F.regexp_replace(F.lower(_col(seq)), WHITESPACE_RUN, " ")


def kmers_of_size(chars: Column, n: int) -> Column:
    """All substrings of length ``n`` from a character array (empty when too short)."""
    count = F.size(chars) - F.lit(n) + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))


def char_array(seq, normalized: bool = False) -> Column:
    """Normalized text as an array of characters (empty text -> empty array).

    Pass ``normalized=True`` with a column that already holds ``normalize_text``
    output (computed in an earlier projection) so the regex runs once per row.
    """
    t = _col(seq) if normalized else normalize_text(seq)
    # split('') of an empty string yields [""]; treat it as no characters
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, ""))


def kmer_array(chars, lo: int, hi: int) -> Column:
    """C3 per row: array of every k-mer (with repeats) for k in [lo, hi].

    ``chars`` must be a *column reference* to ``char_array(...)`` computed in a
    previous projection: an expression inside the lambda would be evaluated
    again for every start position (quadratic in the text length).
    """
    if lo < 1 or hi < lo:
        raise ValueError(f"bad k-mer range {lo}..{hi}")
    chars = _col(chars)
    parts = [kmers_of_size(chars, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def sequence_sql(seq_col: str, lo: int, hi: int) -> dict[str, str]:
    """C1-C3 as SQL text, for pipeline stages that are saved (the same rules as the columns above).

    ``kmers`` reads a column ``_chars`` made from ``chars`` in an earlier projection.
    """
    if lo < 1 or hi < lo:
        raise ValueError(f"bad k-mer range {lo}..{hi}")
    run = WHITESPACE_RUN.replace("\\", "\\\\")
    text = f"regexp_replace(lower({seq_col}), '{run}', ' ')"
    none = "CAST(array() AS array<string>)"
    parts = [
        f"CASE WHEN size(_chars) >= {n} THEN transform(sequence(1, size(_chars) - {n - 1}), "
        f"i -> array_join(slice(_chars, i, {n}), '')) ELSE {none} END"
        for n in range(lo, hi + 1)
    ]
    up = f"upper({seq_col})"
    return {
        "chars": f"CASE WHEN length({text}) = 0 THEN {none} ELSE split({text}, '') END",
        "kmers": parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})",
        "gc": f"CAST((2 * length({up}) - length(replace({up}, 'G', '')) - length(replace({up}, 'C', ''))) "
              f"/ greatest(length({up}), 1) AS DOUBLE)",
        "length": f"CAST(length({seq_col}) AS DOUBLE)",
    }
