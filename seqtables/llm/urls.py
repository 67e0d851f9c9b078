"""URL filter: rules for hosts and paths, and trust that flows along links between hosts.

Personalised PageRank carries trust from hosts with allowed pages along links, and distrust from
hosts with blocked pages against them: who links to a blocked host is suspect. Pages without a
rule follow their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.llm.common import UPPER, LOWER, settled, whole

#: Fixed by the contract: rule and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
ROUNDS = 12
CUT_EVERY = 4
RATIO = 1.0  # a host is blocked when its distrust is more than RATIO times its trust
TIE = 1e-9  # masses that differ by less than this part are equal; sums of doubles depend on their order
HOST = "(?:://|www\\.)([a-z0-9-]+(?:\\.[a-z0-9-]+)+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without a ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text) and its verdict; null without one."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        of, _, below = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + below)
        found, verdict = F.when(fits, F.lit(text)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def _node(host: Column) -> Column:
    """A host in the graph: without a leading www."""
    return F.regexp_replace(host, "^www\\.", "")


def host_links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(a, b, n): links and mentions from the pages of host a to another host b."""
    low = F.translate(whole(html), UPPER, LOWER)
    named = pages.select(_node(F.col(host)).alias("a"), F.explode(F.regexp_extract_all(low, F.lit(HOST), F.lit(1))).alias("b"))
    links = named.select("a", _node(F.col("b")).alias("b")).where("a <> '' and a <> b")
    return links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    seeds: (host, way, mass), way being trust or distrust, the masses of a way summing to 1. Trust
    follows the links, distrust goes against them; a host divides what it passes on by the numbers
    of links. What a host without such links would pass on is lost. After ``rounds`` rounds the
    part still on its way is damping to that power.
    """
    ways = links.select("a", "b", "n", F.lit("trust").alias("way")).union(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", F.lit("distrust").alias("way"))
    )
    totals = ways.groupBy("way", "a").agg(F.sum("n").alias("all"))
    shares = settled(ways.join(totals, ["way", "a"]).select("way", "a", "b", (F.col("n") / F.col("all")).alias("share")))
    start = settled(seeds.select("way", "host", F.col("mass").cast("double").alias("mass")))
    rank = start
    for turn in range(1, rounds + 1):
        passed = rank.withColumnRenamed("host", "a").join(shares, ["way", "a"]).select(
            "way", F.col("b").alias("host"), (F.lit(damping) * F.col("share") * F.col("mass")).alias("mass")
        )
        given = start.select("way", "host", (F.lit(1 - damping) * F.col("mass")).alias("mass"))
        rank = passed.union(given).groupBy("way", "host").agg(F.sum("mass").alias("mass"))
        if turn % CUT_EVERY == 0:
            rank = settled(rank)
    way = lambda name: F.sum(F.when(F.col("way") == name, F.col("mass")).otherwise(0.0))
    return rank.groupBy("host").agg(way("trust").alias("trust"), way("distrust").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A page's verdict is its rule's; without a rule it is block if the host's distrust exceeds
    RATIO times its trust, however small both are, else allow, also for hosts that neither reaches and for pages without a
    host. Missing urls have an empty host, missing html has no links, repeated pages count again.
    """
    host, path = split_url(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = settled(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")))
    links = settled(host_links(parsed))
    counted = judged.where("ruled is not null and host <> ''").groupBy(_node(F.col("host")).alias("host"), "ruled").agg(F.count(F.lit(1)).alias("n"))
    ways = counted.select("host", F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("way"), "n")
    sums = ways.groupBy("way").agg(F.sum("n").alias("all"))
    seeds = ways.join(F.broadcast(sums), "way").select("host", "way", (F.col("n") / F.col("all")).alias("mass"))
    scores = propagate(links, seeds).withColumnRenamed("host", "node")
    joined = judged.join(scores, _node(F.col("host")) == F.col("node"), "left")
    trust, distrust = (F.coalesce(F.col(name), F.lit(0.0)) for name in ("trust", "distrust"))
    by_host = F.when(distrust > F.lit(RATIO * (1 + TIE)) * trust, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust")
    )


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(spark.read.parquet(f"{folder}/pages.parquet"))


def _rounds_sql() -> str:
    steps = []
    for turn in range(1, ROUNDS + 1):
        before = "seeds" if turn == 1 else f"r{turn - 1}"
        steps.append(
            f"r{turn} as (select way, host, sum(mass) as mass from ("
            f"select s.way, s.b as host, {DAMPING} * share * mass as mass from {before} r join shares s on s.way = r.way and s.a = r.host "
            f"union all select way, host, {1 - DAMPING} * mass from seeds) group by way, host)"
        )
    return ",\n".join(steps)


_FITS = " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then {{{'r' + str(i)}}}"
    for i, (h, p) in enumerate((t.partition("/")[0], t.partition("/")[2]) for t, _ in sorted(RULES, key=lambda r: -len(r[0])))
)
_SORTED = sorted(RULES, key=lambda r: -len(r[0]))
OP3_SQL = f"""
with rests as (select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, html, regexp_extract(rest, '^[^/?#]*') as raw, rest from rests),
parsed as (
  select page_id, html, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from parts),
judged as (
  select page_id, host, path, html, regexp_replace(host, '^www\\.', '') as node,
         case {_FITS.format(**{f'r{i}': f"'{t}'" for i, (t, _) in enumerate(_SORTED)})} end as rule,
         case {_FITS.format(**{f'r{i}': f"'{v}'" for i, (_, v) in enumerate(_SORTED)})} end as ruled from parsed),
named as (
  select node as a, regexp_replace(unnest(regexp_extract_all(translate(coalesce(html, ''), '{UPPER}', '{LOWER}'), '{HOST}', 1)), '^www\\.', '') as b from judged),
links as (select a, b, count(*) as n from named where a <> '' and a <> b group by a, b),
ways as (select a, b, n, 'trust' as way from links union all select b, a, n, 'distrust' from links),
shares as (select way, a, b, n / sum(n) over (partition by way, a) as share from ways),
counted as (select node as host, case ruled when 'allow' then 'trust' else 'distrust' end as way, count(*) as n from judged where ruled is not null and host <> '' group by all),
seeds as (select host, way, n / sum(n) over (partition by way) as mass from counted),
{_rounds_sql()},
scores as (select host as node, sum(case way when 'trust' then mass else 0 end) as t, sum(case way when 'distrust' then mass else 0 end) as d from r{ROUNDS} group by host),
rounded as (select page_id, host, path, rule, ruled, coalesce(round(t, 9), 0) as trust, coalesce(round(d, 9), 0) as distrust from judged left join scores using (node))
select page_id, host, path, rule, coalesce(ruled, case when distrust > {RATIO} * trust then 'block' else 'allow' end) as verdict, trust, distrust from rounded"""
