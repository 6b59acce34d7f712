"""URL filters: rules, and link-graph propagation for what no rule covers.

Every page is judged by the longest rule that fits its URL.  Hosts become the
nodes of a link graph whose edges are the absolute links of their pages (links
without a host of their own stay on the host).  A host's trust seed is the
share of its pages that a rule allows, its distrust seed the share that a rule
blocks.

* trust flows along links: a personalised PageRank from the trusted seeds,
  ``t = (1 - c) s + c sum_g p(g, h) t(g)``
* distrust flows against them: ``d = (1 - c) b + c sum_g p(h, g) d(g)``, the
  share of blocked pages that a surfer who starts on the host runs into

with p the share of a host's links.  A host whose distrust exceeds its trust by
``THRESHOLD`` is blocked; pages without a rule take their host's verdict.

Mass is held in integer units, so the result does not depend on the order of
tasks; both propagations run as one join and one pre-aggregated sum per round,
over the distinct host edges.  Rounds are cut through written tables.

Hosts are what follows the first ``://`` up to ``/ ? #`` or the end, with A-Z
lower-cased; without ``://`` host and path are empty and only the propagation
(of the empty host) judges.  Null HTML has no links.  Repeated pages count
each.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut

#: Share that follows a link, rounds (what is left beyond is below 0.85 ** 20), units of mass, and the verdict's threshold.
FOLLOW, ROUNDS, UNIT, THRESHOLD = 85, 20, 10 ** 9, 0.5
LINK = r"(?i)href\s*=\s*[\"']([^\"'<>]*)[\"']"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def link_host(link: Column, own: Column) -> Column:
    """Host that a link leads to; null for what is no link to a page."""
    full = F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link)
    return F.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(full)).when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), own)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path prefix) that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, of_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(of_host + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` in units, from seeds of the same columns and edges ``src, dst, n``.

    A round is one join of the present mass with the edges and one sum.  Both
    directions share it: an edge carries trust from ``src`` to ``dst`` and
    distrust from ``dst`` to ``src``, by the same share of ``src``'s links."""
    totals = edges.groupBy("src").agg(F.sum("n").alias("of"))
    shares = edges.join(totals, "src").select("src", "dst", F.expr(f"(n * {UNIT}) div of").alias("share"))
    both = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), "share", F.lit(True).alias("forward"))
    both = cut(both.union(shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), "share", F.lit(False).alias("forward"))), "url-edges")
    mass = seeds
    for k in range(rounds):
        sent = F.expr(f"((CASE WHEN forward THEN trust ELSE distrust END) * share) div {UNIT}")
        moved = both.join(mass, "host").select(
            F.col("to").alias("host"), F.when(F.col("forward"), sent).otherwise(0).alias("t"), F.when(F.col("forward"), 0).otherwise(sent).alias("d"))
        moved = moved.groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        step = lambda seed, got: F.expr(f"({seed} * {100 - FOLLOW} + coalesce({got}, 0) * {FOLLOW}) div 100")
        mass = seeds.withColumnsRenamed({"trust": "s", "distrust": "b"}).join(moved, "host", "left").select(
            "host", step("s", "t").alias("trust"), step("b", "d").alias("distrust"))
        if k % 5 == 4 or k == rounds - 1:
            mass = cut(mass, "url-mass")
    return mass


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``__host, __path, __rule, __verdict, __trust, __distrust`` (mass of the host, 0 to 1)."""
    host = host_of(F.col(url))
    known = pages.select("*", host.alias("__host"), path_of(F.col(url)).alias("__path"))
    name, kind = rule_for(F.col("__host"), F.col("__path"), rules)
    known = known.select("*", name.alias("__rule"), kind.alias("__kind"))
    links = known.select(F.col("__host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("link"))
    edges = links.select("src", link_host(F.col("link"), F.col("src")).alias("dst")).filter("dst is not null and dst <> ''")
    edges = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "url-links")
    share = lambda k: F.expr(f"(sum(CASE WHEN __kind = '{k}' THEN 1 ELSE 0 END) * {UNIT}) div count(1)")
    of_pages = known.groupBy(F.col("__host").alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust"))
    linked = edges.select(F.col("dst").alias("host")).distinct().join(of_pages, "host", "left_anti").select("host", F.lit(0).cast("long").alias("trust"), F.lit(0).cast("long").alias("distrust"))
    seeds = cut(of_pages.union(linked), "url-seeds")
    lone = seeds.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1).cast("long").alias("n"))
    edges = edges.union(lone.join(edges.select("src"), "src", "left_anti"))
    mass = propagate(seeds, edges).withColumnsRenamed({"host": "__host", "trust": "__t", "distrust": "__d"})
    by_host = F.when(F.col("__d") - F.col("__t") >= int(THRESHOLD * UNIT), F.lit("block")).otherwise(F.lit("allow"))
    return known.join(mass, "__host", "left").select(
        *pages.columns, "__host", "__path", "__rule", F.coalesce("__kind", by_host).alias("__verdict"),
        (F.col("__t") / UNIT).alias("__trust"), (F.col("__d") / UNIT).alias("__distrust"))
