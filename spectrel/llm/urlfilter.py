"""URL filters by link-graph propagation, in DataFrame functions only.

Rules (host and path prefix, allow or block) judge the URLs they fit. For the others the hosts' link graph decides: trust flows from hosts
in proportion to their allowed pages along links (personalised PageRank), distrust from hosts in proportion to their blocked pages
against the links, and a host whose distrust exceeds its trust by a threshold is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm.common import LOWER_AZ, UPPER_AZ, Shelf, free_name, lower_az, read


@dataclass(frozen=True)
class UrlRule:
    """host: the rule fits it and its subdomains. path: what the URL's path must start with. allow: or else block."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("com", "/", True), UrlRule("example.com", "/en/", False), UrlRule("www.example.com", "/en/", True), UrlRule("net", "/es/", False), UrlRule("net", "/fr/", False))
#: Share of a host's rank that comes by links; and how far distrust must exceed trust, as a share of what a host has whose pages are all blocked.
DAMPING, LIMIT = 0.85, 0.5
#: Propagation goes on until no host gets more than this in a round. A seed is at most 1 - DAMPING, so a path of 70 links is followed to its end.
TOLERANCE = 1e-6
#: Rounds of the SQL, which can't stop by itself: what is left after them is below TOLERANCE on a path.
SQL_ROUNDS = 75
#: Hosts of links with an authority, of any scheme or none.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def rest_of(url: Column) -> Column:
    """What follows the first ://, empty if there is none."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_az(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The name of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def propagate(seed: DataFrame, edges: DataFrame, shelf: Shelf, damping: float, tolerance: float) -> DataFrame:
    """(host, rank): (1 - damping) * seed + damping * sum of rank * weight over the edges that lead to the host.

    seed: host, seed. edges: src, dst, weight (the weights that leave a host add up to 1). A round passes on what arrived in the round before,
    and the rank is the sum of what arrived in all rounds; they end when no host gets more than the tolerance. Seeds aren't normalised, so that a
    host's rank doesn't depend on how many others there are, and what reaches a host without edges is not passed on."""
    arrived = [shelf.put(seed.where("seed > 0").select("host", (F.col("seed") * (1 - damping)).alias("rank")))]
    while True:
        flow = edges.join(arrived[-1], F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("weight") * damping).alias("rank"))
        now = shelf.put(flow.select(F.col("dst").alias("host"), "rank"))
        most = now.agg(F.max("rank")).first()[0]
        arrived.append(now)
        if not most or most <= tolerance:
            break
        if len(arrived) == 16:  # the tables before become one
            one = shelf.put(sum_of(arrived[:-1]))
            for old in arrived[:-1]:
                shelf.drop(old)
            arrived = [one, now]
    out = shelf.put(sum_of(arrived))
    for old in arrived:
        shelf.drop(old)
    return out


def sum_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("host").agg(F.sum("rank").alias("rank"))


def link_edges(pages: DataFrame, host: Column, html: str) -> DataFrame:
    """(src, dst, n): on how many pages a host links to another. A page counts once for each host it links to."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(LINK), F.lit(1)), lower_az))
    return pages.select(host.alias("src"), F.explode(found).alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", html: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, limit: float = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """pages (or the columns keep), host, path, rule, verdict (allow or block) and by (rule or graph).

    A url that is null or has no :// has empty host and path and no rule; its verdict is the graph's for a host without links: allow. A
    null html has no links. Repeated rows are judged each and count each. Columns of pages with the names of new ones are replaced; an empty table gives
    an empty table.
    """
    shelf = Shelf(pages.sparkSession, "urlfilter")
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("host", "path", "rule", "verdict", "by")]
    (row,) = free_name(pages, "row")
    u = F.col(f"`{url}`").cast("string")
    host, path = host_of(u), path_of(u)
    allowed = [r.name for r in rules if r.allow]
    edges = shelf.put(link_edges(pages, host, html))
    rule = rule_of(host, path, rules)
    per_host = pages.select(host.alias("host"), rule.alias("rule")).where("host != ''")
    good = F.avg(F.when(F.col("rule").isin(allowed), 1.0).otherwise(0.0))
    bad = F.avg(F.when(F.col("rule").isNotNull() & ~F.col("rule").isin(allowed), 1.0).otherwise(0.0))
    seeds = shelf.put(per_host.groupBy("host").agg(good.alias("good"), bad.alias("bad")))
    leaving = edges.groupBy("src").agg(F.sum("n").alias("total"))
    arriving = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    forth = shelf.put(edges.join(leaving, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight")))
    back = shelf.put(edges.join(arriving, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("weight")))
    trust = propagate(seeds.select("host", F.col("good").alias("seed")), forth, shelf, damping, tolerance)
    distrust = propagate(seeds.select("host", F.col("bad").alias("seed")), back, shelf, damping, tolerance)
    gap = F.round(F.col("bad_rank") - F.coalesce(F.col("rank"), F.lit(0.0)), 9)
    blocked = distrust.select("host", F.col("rank").alias("bad_rank")).join(trust, "host", "left").where(gap > limit * (1 - damping))
    blocked = shelf.put(blocked.select(F.col("host").alias("bad_host")))
    shelf.keep(blocked)
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(row), host.alias("host"), path.alias("path"), rule.alias("rule"))
    out = out.join(blocked, (F.col("host") == F.col("bad_host")) & F.col("rule").isNull(), "left")
    verdict = F.when(F.col("rule").isin(allowed), "allow").when(F.col("rule").isNotNull() | F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return out.select(f"{row}.*", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").otherwise("graph").alias("by"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_urls() over all pages with the fixed rules; edge cases as defined there."""
    return judge_urls(read(spark, sf_dir, "pages"), keep=["page_id"]).drop("by")


def op2_sql() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered) + " END"
    allowed = "(" + ", ".join(f"'{r.name}'" for r in RULES if r.allow) + ")"
    link = LINK.replace("'", "''")
    lower = f"'{UPPER_AZ}', '{LOWER_AZ}'"
    parts = [
        "u AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)",
        f"p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), {lower}) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS MATERIALIZED (SELECT page_id, host, path, {case} AS rule, list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: translate(x, {lower}))) AS links FROM p)",
        "e0 AS (SELECT host AS src, unnest(links) AS dst FROM r WHERE host <> '')",
        "e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM e0 WHERE dst <> '' AND src <> dst GROUP BY src, dst)",
        "forth AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM e)",
        "back AS MATERIALIZED (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS weight FROM e)",
        f"s AS MATERIALIZED (SELECT host, avg(CASE WHEN rule IN {allowed} THEN 1.0::DOUBLE ELSE 0.0 END) AS good, avg(CASE WHEN rule IS NOT NULL AND rule NOT IN {allowed} THEN 1.0::DOUBLE ELSE 0.0 END) AS bad FROM r WHERE host <> '' GROUP BY host)",
    ]
    for name, seed, edges in (("t", "good", "forth"), ("d", "bad", "back")):
        parts.append(f"{name}0 AS MATERIALIZED (SELECT host, {seed} * (1 - {DAMPING}::DOUBLE) AS rank FROM s WHERE {seed} > 0)")
        for i in range(SQL_ROUNDS):
            parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT dst AS host, sum(rank * weight * {DAMPING}::DOUBLE) AS rank FROM {edges} JOIN {name}{i} ON src = host GROUP BY dst)")
        every = " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(SQL_ROUNDS + 1))
        parts.append(f"{name} AS (SELECT host, sum(rank) AS rank FROM ({every}) GROUP BY host)")
    parts.append(f"b AS (SELECT d.host FROM d LEFT JOIN t ON d.host = t.host WHERE round(d.rank - coalesce(t.rank, 0), 9) > {LIMIT * (1 - DAMPING)})")
    verdict = f"CASE WHEN rule IN {allowed} THEN 'allow' WHEN rule IS NOT NULL OR host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END"
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, host, path, rule, {verdict} AS verdict FROM r"
