r"""Filter interaction audit: what each filter removes in each order of all filters.

A row fails some of the filters; in an order it is removed by the first one it
fails.  Rows of one part with the same failures behave alike, so they are counted
first, and orders only meet the table of (part, failures) counts:

* mask matrix M (failures x filters): 0 where the filter fails, else infinity;
* position matrix P (filters x orders): the inverse permutations, a filter's place;
* the min-plus product of M and P is the step at which each kind of row is removed.

Counts are then scattered to (part, order, step) with the rows' weights.  Five
filters give 32 kinds and 120 orders; a part's answer needs its 32 counts only.

Failure conditions (words are runs of ``[^\x20\x09-\x0D]``, case-sensitive):
A fewer than 100 words; B distinct words below 80 % of words; C capitals A-Z above
10 % of code points; D holds one of ``#$%&*|``; E the text equals that of a smaller id,
wherever that row is.

For E, texts become SHA-256 digests.  The smallest id of each digest comes from an
aggregate, and rows meet it on (id, digest), not on the digest alone: a group of
copies that holds a third of all rows is spread by its ids, and a repeated id is
counted into few rows before each join.

Defined results: null text counts as empty (so all of these are equal) and fails A
only, and E; a null lang is the empty string; a null id never fails E and is smaller
than no other; repeated rows count each, and the same id twice is not a copy of
itself; several labels of one id count as one that is good (toxic) if any is; a row
without a label is neither; an empty table has no parts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import SPACE_PATTERN, map_arrow, stored, table, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts whose answers are made at once.
PARTS_AT_ONCE = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def text_counts(text):
    """What conditions A to D ask of a text column (no nulls)."""
    words = F.filter(F.split(text, SPACE_PATTERN), lambda w: w != "")
    return F.struct(
        F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("different"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"), F.char_length(text).alias("points"),
        text.rlike(r"[#$%&*|]").alias("symbol"),
    )


def kinds(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many rows fail just the filters of ``mask`` (bit 0 is A)."""
    text = text_or_empty(text_col)
    read = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_counts(text).alias("f"),
    )
    f = lambda c: F.col(f"f.{c}")
    conditions = [f("n") < 100, 100 * f("different") < 80 * f("n"), 100 * f("capitals") > 10 * f("points"), f("symbol")]
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions)), F.lit(0))
    rows = stored(
        read.select("id", "part", "digest", mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")),
        "audit-rows",
    )
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).select("id", "digest", F.lit(0).alias("copy"))
    rows = rows.join(first, ["id", "digest"], "left")
    copy = F.col("id").isNotNull() & F.col("copy").isNull()
    named = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    per_id = rows.groupBy("id", "part", (F.col("mask") + copy.cast("int") * 16).alias("mask")).agg(F.sum("n").alias("n"))
    return (
        per_id.join(named, "id", "left").groupBy("part", "mask").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
        )
    )


def removal_steps(filters: str = FILTERS) -> np.ndarray:
    """[mask, order] -> the step (from 0) that removes rows with these failures; len(filters) if none does."""
    n = len(filters)
    bits = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    masks = np.where(bits == 1, 0, n)  # n stands for infinity
    places = np.argsort([[filters.index(c) for c in o] for o in map("".join, permutations(filters))], axis=1).T
    return np.minimum(np.min(masks[:, :, None] + places[None], axis=1), n)


def audit_table(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of [part, order, step] from counts [part, mask, (n, good, toxic)]."""
    n = len(FILTERS)
    steps, parts, orders = removal_steps(), len(counts), len(ORDERS)
    removed = np.zeros((3, parts, orders, n + 1), np.int64)
    for mask in range(1 << n):  # scatter every kind of row to its step of each order
        removed[:, :, np.arange(orders), steps[mask]] += counts[:, mask].T[:, :, None]
    letter = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    failing = counts[:, :, 0] @ fails  # [part, filter]
    alone = counts[:, 1 << np.arange(n), 0]
    gone = removed[0, :, :, :n]
    shapley = np.zeros((parts, n), np.int64)
    for f in range(n):
        shapley[:, f] = (gone * (letter == f)).sum(axis=(1, 2))
    return {
        "kept": counts[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(gone, axis=2),
        "removed": gone,
        "redundant": failing[:, letter] - gone,
        "unique_fails": alone[:, letter],
        "good_lost": removed[1, :, :, :n],
        "toxic_lost": removed[2, :, :, :n],
        "shapley": shapley[:, letter],
    }


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step, zeros included."""
    cell = F.struct("mask", "n", "good", "toxic")
    parts = kinds(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(FILTERS)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                counts = np.zeros((some.num_rows, 1 << n, 3), np.int64)
                for i, cells in enumerate(some.column(1).to_pylist()):
                    for c in cells:
                        counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                each = len(ORDERS) * n
                cols = [
                    some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), each))),
                    pa.array(np.tile(np.repeat(ORDERS, n), some.num_rows).tolist(), pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), some.num_rows * len(ORDERS))),
                ]
                made = audit_table(counts)
                cols += [pa.array(made[c].reshape(-1)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(cols, ["part", "filter_order", "step", *COUNTS])

    return map_arrow(parts, run, SCHEMA)


def op13_filter_audit(spark, sf_dir):
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
with words as (
  select doc_id as id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)
, lab as (select doc_id as id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
          from labels group by doc_id)
, fails as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         len(w) < 100 as fa, 100 * len(list_distinct(w)) < 80 * len(w) as fb,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as fc, regexp_matches(t, '[#$%&*|]') as fd,
         coalesce(words.id > min(words.id) over (partition by t), false) as fe
  from words left join lab on words.id = lab.id)
, kinds as (select part, fa, fb, fc, fd, fe, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by all)
, letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c)
, orders as (select a.c || b.c || d.c || e.c || f.c as o from letters a, letters b, letters d, letters e, letters f
             where len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5)
, steps as (select o, s, substr(o, s, 1) as c from orders, (select unnest(range(1, 6)) as s))
, rows as (
  select part, o, s, c, n, good, toxic,
         case c when 'A' then fa when 'B' then fb when 'C' then fc when 'D' then fd else fe end as failing,
         (fa and strpos(o, 'A') < s) or (fb and strpos(o, 'B') < s) or (fc and strpos(o, 'C') < s)
         or (fd and strpos(o, 'D') < s) or (fe and strpos(o, 'E') < s) as gone,
         cast(fa as int) + cast(fb as int) + cast(fc as int) + cast(fd as int) + cast(fe as int) as failures
  from kinds, steps)
, made as (
  select part, o, s, c, coalesce(sum(n) filter (where not gone and not failing), 0) as kept,
         coalesce(sum(n) filter (where failing and not gone), 0) as removed,
         coalesce(sum(n) filter (where failing and gone), 0) as redundant,
         coalesce(sum(n) filter (where failing and failures = 1), 0) as unique_fails,
         coalesce(sum(good) filter (where failing and not gone), 0) as good_lost,
         coalesce(sum(toxic) filter (where failing and not gone), 0) as toxic_lost
  from rows group by part, o, s, c)
select part, o as filter_order, cast(s as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, c) as bigint) as shapley
from made
"""
