r"""URL filter: rules first, else trust and distrust spread over the host graph.

A url fits a rule if its host is the rule's or a subdomain of it and its path
starts with the rule's; the longest fitting rule decides.

Hosts that no rule settles are judged by propagation.  Edges run between hosts:
from a page's host to the hosts its html links to (links of many pages between two
hosts are one edge, weighted by their number), and between a host and its parent
domain both ways with weight PARENT_WEIGHT, which is all there is where pages only
link inside their own host.  Trust is a personalised PageRank from the hosts that
have allowed pages; distrust runs from the hosts that have blocked pages against
the edges (who links to a bad host is suspect).  A seed host's mass is the share of
its pages that the rules allow or block; the masses are scaled to a sum of 1.
A host is blocked if its distrust exceeds its trust by more than the share SLACK of it.

The ranks are the sums of what arrives after 0, 1, 2... steps.  Each step keeps at most
DAMPING of the mass, so what all steps from the k-th on would still bring is at most
DAMPING^k of it: propagation ends at the first k where that is below TOLERANCE, or
before, when so little arrived (hosts without edges let mass out) that the rest is.

Each step is one join of the edges with the ranks and one grouped sum, for both
directions at once; edges are aggregated before they move, and every STORE_EVERY-th step
is written to the shared folder.  A host of more than HUB_EDGES edges (a top-level
domain) has them in blocks, and its mass is sent to each block, so no task meets
all of them.  What comes to the driver is the sum of the ranks, one number.

Defined results: a null url or one without ``://`` has an empty host and path, no
rule, and is allowed (no mass reaches the empty host); null html has no links;
repeated rows are judged alike and count as pages each; without seeds all is
allowed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewell.llm.common import stored, table

#: (verdict, host, path) (fixed values)
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DAMPING, PARENT_WEIGHT, SLACK = 0.85, 1, 1e-6
#: Share of the mass that may be left out of the ranks, and the steps that suffice for it.
TOLERANCE = 1e-4
STEPS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
STORE_EVERY = 6
#: Edges of one host that meet in a task.  Hosts with more are at most edges / HUB_EDGES.
HUB_EDGES = 1 << 18
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null without one."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, w): links between hosts, and hosts with their parent domains."""
    links = (
        pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("dst"))
        .select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
        .where("src <> '' and src <> dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    )
    links = stored(links, "host-links")
    hosts = pages.select(F.col(host).alias("h")).union(links.select("dst")).where("h <> ''").distinct()
    # a.b.c gives a.b.c -> b.c -> c
    parts = F.split("h", "\\.")
    up = hosts.select(
        F.explode(F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
        )).alias("src")
    ).where("instr(src, '.') > 0").distinct()
    up = up.select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst"), F.lit(PARENT_WEIGHT).cast("long").alias("w"))
    both = links.union(up).union(up.select("dst", "src", "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust); ``pages`` has host and verdict (null where no rule fits)."""
    per_host = pages.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("bad"),
    )
    seeds = per_host.select("host", F.expr("stack(2, 't', good, 'd', bad) as (way, mass)")).where("mass > 0")
    total = seeds.groupBy("way").agg(F.sum("mass").alias("total"))
    first = stored(
        seeds.join(total, "way").select("way", "host", (F.col("mass") / F.col("total") * (1 - DAMPING)).alias("p")), "host-seeds"
    )
    ways = edges.select(F.lit("t").alias("way"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").union(
        edges.select(F.lit("d"), "dst", "src", "w")
    )
    nodes = stored(
        ways.groupBy("way", "host").agg(
            F.sum("w").alias("all_w"), F.ceil(F.count(F.lit(1)) / HUB_EDGES).cast("int").alias("blocks")
        ), "host-nodes",
    )
    hubs = F.broadcast(nodes.where("blocks > 1").select("way", "host", "blocks"))
    ways = stored(
        ways.join(hubs, ["way", "host"], "left").select(
            "way", "host", "to", "w", F.pmod(F.xxhash64("to"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
        ), "host-edges",
    )
    ranks, before = first, 0.0
    for k in range(1, STEPS + 1):
        sent = ranks.join(nodes, ["way", "host"]).select(
            "way", "host", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            (F.col("p") / F.col("all_w") * DAMPING).alias("p"),
        )
        moved = sent.join(ways, ["way", "host", "block"]).select("way", F.col("to").alias("host"), (F.col("p") * F.col("w")).alias("p"))
        ranks = moved.union(first).groupBy("way", "host").agg(F.sum("p").alias("p"))
        if k % STORE_EVERY == 0:
            ranks = stored(ranks, f"host-ranks-{k}")
            mass = ranks.agg(F.sum("p")).first()[0] or 0.0
            # later steps bring at most DAMPING / (1 - DAMPING) times what the last one brought
            if (mass - before) * DAMPING / (1 - DAMPING) < TOLERANCE:
                break
            before = mass
    part = lambda way: F.sum(F.when(F.col("way") == way, F.col("p")).otherwise(0.0))
    return ranks.groupBy("host").agg(part("t").alias("trust"), part("d").alias("distrust"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """One row per row: id, host, path, rule, verdict, trust, distrust."""
    read = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
        F.col(html_col).alias("html"),
    )
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = read.select("id", "host", "path", name.alias("rule"), verdict.alias("verdict"))
    ranks = propagate(ruled, host_edges(read, "host", "html"))
    bad = F.coalesce(F.col("distrust") > F.col("trust") * (1 + SLACK), F.lit(False))
    return ruled.join(ranks, "host", "left").select(
        "id", "host", "path", "rule",
        F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust",
    )


def op8_url_filter(spark, sf_dir):
    done = judged(table(spark, sf_dir, "pages"))
    return done.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql() -> str:
    cases = lambda take: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{take(v, h, p)}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " END"
    return rf"""
WITH RECURSIVE read AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path, html FROM pages),
ruled AS (SELECT page_id, host, path, {cases(lambda v, h, p: h + p)} AS rule, {cases(lambda v, h, p: v)} AS verdict FROM read),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS dst FROM read),
links AS (SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst, count(*) AS w FROM found
          WHERE src <> '' AND src <> translate(dst, '{UPPER}', '{LOWER}') GROUP BY 1, 2),
hosts AS (SELECT host AS h FROM read WHERE host <> '' UNION SELECT dst FROM links WHERE dst <> ''),
chain AS (SELECT DISTINCT array_to_string(list_slice(string_split(h, '.'), i, len(string_split(h, '.'))), '.') AS src
          FROM hosts, LATERAL (SELECT unnest(range(1, len(string_split(h, '.')) + 1)) AS i)),
up AS (SELECT src, substr(src, instr(src, '.') + 1) AS dst, {PARENT_WEIGHT} AS w FROM chain WHERE instr(src, '.') > 0),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT * FROM up
          UNION ALL SELECT dst, src, w FROM up) GROUP BY src, dst),
per_host AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS good,
             avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM ruled WHERE host <> '' GROUP BY host),
mass AS (SELECT 't' AS way, host, good AS mass FROM per_host WHERE good > 0
         UNION ALL SELECT 'd', host, bad FROM per_host WHERE bad > 0),
seeds AS (SELECT way, host, mass / sum(mass) OVER (PARTITION BY way) AS p FROM mass),
both_ways AS (SELECT 't' AS way, src AS host, dst, w FROM edges UNION ALL SELECT 'd', dst, src, w FROM edges),
ways AS (SELECT way, host, dst, w::DOUBLE / sum(w) OVER (PARTITION BY way, host) AS share FROM both_ways),
steps AS (
  SELECT way, host, p * {1 - DAMPING} AS p, 0 AS k FROM seeds
  UNION ALL
  SELECT way, w.dst, sum(s.p * w.share * {DAMPING}), any_value(s.k) + 1
  FROM steps s JOIN ways w USING (way, host) WHERE s.k < {STEPS} GROUP BY way, w.dst),
ranks AS (SELECT host, sum(CASE WHEN way = 't' THEN p ELSE 0 END) AS trust,
          sum(CASE WHEN way = 'd' THEN p ELSE 0 END) AS distrust FROM steps GROUP BY host)
SELECT page_id, ruled.host AS host, path, rule,
       coalesce(verdict, CASE WHEN distrust > trust * (1 + {SLACK}) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN ranks USING (host)
"""


SQL = _sql()
