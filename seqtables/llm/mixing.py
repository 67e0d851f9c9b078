"""Mix overlapping sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources are one pattern. A pattern can send its words
to any of its sources, the first time at no cost, each repetition at one unit more; a source
takes up to its target. The cheapest largest flow says how many words of each pattern the mix
takes; these are then filled with the pattern's documents in a seeded order.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.llm.common import documents, fresh, word_count, whole
from seqtables.session import cut

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
REPEATS = 2
SEED = 20240917


class MinCostFlow:
    """Successive cheapest paths with potentials on a small directed graph with integer capacities."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def run(self, source: int, sink: int) -> None:
        potential = [0] * len(self.out)
        while True:
            far = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.head[e]
                    step = d + self.cost[e] + potential[x] - potential[y]
                    if self.room[e] and (far[y] is None or step < far[y]):
                        far[y], via[y] = step, e
                        heapq.heappush(heap, (step, y))
            if far[sink] is None:
                return
            potential = [p + (far[sink] if d is None else min(d, far[sink])) for p, d in zip(potential, far)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.head[via[at] ^ 1]
            pushed = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= pushed
                self.room[e ^ 1] += pushed


@dataclass
class Plan:
    """targets: of each source. taken: words to take of each pattern. routed: of them, by (pattern, source)."""

    targets: dict
    taken: list[int]
    routed: dict[tuple[int, object], int]


def share_out(sizes: list[tuple[object, int]], weights=WEIGHTS, percent: int = SHARE_PERCENT, cap: int = REPEATS) -> dict:
    """Targets: percent of all sizes by weight, none above cap times its size, the excess reshared by weight.

    sizes lists the sources in the order in which the weights repeat.
    """
    weight = {key: weights[i % len(weights)] for i, (key, _) in enumerate(sizes)}
    most = {key: float(cap * size) for key, size in sizes}
    targets = {key: 0.0 for key in most}
    left, open_ = sum(size for _, size in sizes) * percent / 100, set(most)
    while open_:
        by = left / sum(weight[key] for key in open_)
        over = [key for key in open_ if by * weight[key] > most[key]]
        if not over:
            targets |= {key: by * weight[key] for key in open_}
            break
        for key in over:
            targets[key] = most[key]
        open_ -= set(over)
        left -= sum(most[key] for key in over)
    return targets


def route(patterns: list[tuple[tuple, int]], targets: dict, repeats: int = REPEATS) -> Plan:
    """Words that each pattern (its sources, its words) sends to each source."""
    keys = list(targets)
    place = {key: 1 + len(patterns) + i for i, key in enumerate(keys)}
    sink = 1 + len(patterns) + len(keys)
    flow = MinCostFlow(sink + 1)
    links = {}
    for i, (members, size) in enumerate(patterns):
        for turn in range(repeats):
            flow.edge(0, 1 + i, size, turn)  # convex: the next pass over the same words costs more
        for key in members:
            links[i, key] = flow.edge(1 + i, place[key], repeats * size, 0)
    for key in keys:
        flow.edge(place[key], sink, int(targets[key] + 0.5), 0)
    flow.run(0, sink)
    routed = {at: flow.room[e ^ 1] for at, e in links.items() if flow.room[e ^ 1]}
    taken = [sum(routed.get((i, key), 0) for key in members) for i, (members, _) in enumerate(patterns)]
    return Plan(dict(targets), taken, routed)


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    order: Column,
    weights=WEIGHTS,
    percent: int = SHARE_PERCENT,
    repeats: int = REPEATS,
    max_patterns: int = 200_000,
) -> DataFrame:
    """docs with three more columns: words (its size), target (of its sources) and taken (words the mix takes).

    sources: an array of the sources a document belongs to, where null is a source of its own; a
    document with an empty array gives nothing. order: a seeded number of up to 60 bits; a pattern's
    words are filled along it, and the document at the end gives only the words still missing.
    Rows with equal order numbers (repeated ids) share what falls on them by their sizes. Sources
    count by code point, null last. Column names get a trailing underscore if docs has them.

    One row per pattern goes to the driver, where the flow is solved, and back in a broadcast: at
    most ``max_patterns`` rows, more is an error.
    """
    s, target, taken = (fresh(docs, name) for name in ("words", "target", "taken"))
    o, tag = fresh(docs, "__order"), fresh(docs, "__pattern")
    sized = docs.withColumns({s: size.cast("long"), o: order.cast("long"), tag: _tag(sources)})
    slim = cut(sized.select(F.col(tag).alias("tag"), F.array_distinct(sources).alias("sources"), F.col(s).alias("s"), F.col(o).alias("o")))
    ranges = cut(
        slim.groupBy("tag", F.shiftright("o", 48).alias("range")).agg(F.first("sources").alias("sources"), F.sum("s").alias("s"))
    )
    sums = ranges.groupBy("tag").agg(F.first("sources").alias("sources"), F.sum("s").alias("s")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns: merge rare sources or raise max_patterns")
    patterns = [(tuple(row.sources), row.s) for row in sums]
    totals: dict = {}
    for members, words in patterns:
        for key in members:
            totals[key] = totals.get(key, 0) + words
    ordered = sorted(totals.items(), key=lambda x: (x[0] is None, x[0] or ""))
    plan = route(patterns, share_out(ordered, weights, percent, repeats), repeats)
    rows = [
        (row.tag, float(sum(plan.targets[k] for k in members)), *(divmod(t, words) if words else (0, 0)))
        for row, (members, words), t in zip(sums, patterns, plan.taken)
    ]
    goals = F.broadcast(docs.sparkSession.createDataFrame(rows, "tag string, target double, passes long, rest long"))
    ends = _ends(slim, ranges, goals)
    at = {name: fresh(docs, f"__at_{name}") for name in ends.columns}
    ends = F.broadcast(ends.toDF(*at.values()))
    kept = [F.col(f"`{name}`") for name in docs.columns]
    last = F.when(F.col(o) < F.col(at["end"]), F.col(s)).when(
        F.col(o) == F.col(at["end"]), F.floor(F.col(at["missing"]) * F.col(s) / F.greatest(at["shared"], F.lit(1)))
    )
    return sized.join(ends, F.col(tag) == F.col(at["tag"])).select(
        *kept,
        F.col(s),
        F.col(at["target"]).alias(target),
        (F.col(at["passes"]) * F.col(s) + F.coalesce(last, F.lit(0))).cast("long").alias(taken),
    )


def _tag(sources: Column) -> Column:
    """One text per set of sources; a mark and the length in front tell any two sets apart."""
    named = F.transform(
        F.array_sort(F.array_distinct(sources)),
        lambda x: F.when(x.isNull(), F.lit("null,")).otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x, F.lit(","))),
    )
    return F.array_join(named, "")


def _ends(slim: DataFrame, ranges: DataFrame, goals: DataFrame) -> DataFrame:
    """Per pattern its target, its full passes, and where in the seeded order the rest ends.

    Sums of ranges of the order tell in which range that is; only its rows are put in order.
    """
    along = Window.partitionBy("tag").orderBy("range")
    cut_in = (
        ranges.select("tag", "range", "s")
        .join(goals, "tag")
        .withColumn("upto", F.sum("s").over(along))
        .where((F.col("rest") > F.col("upto") - F.col("s")) & (F.col("rest") <= F.col("upto")))
        .select("tag", "range", (F.col("rest") - F.col("upto") + F.col("s")).alias("room"))
    )
    inside = (
        slim.join(F.broadcast(cut_in), (slim.tag == cut_in.tag) & (F.shiftright("o", 48) == F.col("range")))
        .groupBy(slim.tag, "o", "room")
        .agg(F.sum("s").alias("s"))
    )
    upto = F.sum("s").over(Window.partitionBy("tag").orderBy("o"))
    at = (
        inside.withColumn("upto", upto)
        .where((F.col("room") > F.col("upto") - F.col("s")) & (F.col("room") <= F.col("upto")))
        .select("tag", F.col("o").alias("end"), (F.col("room") - F.col("upto") + F.col("s")).alias("missing"), F.col("s").alias("shared"))
    )
    return goals.join(at, "tag", "left")


def seeded_order(key: Column, seed: int = SEED) -> Column:
    """60 random-looking bits of a key, the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def op9_mixing(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source", word_count(whole("text")).alias("size"))
    docs = cut(docs)
    mixed = mix(docs, F.array("source"), F.col("size"), seeded_order(F.col("doc_id")))
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumnRenamed("source", "of")
    return mixed.join(totals, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


#: With one source per document the flow is the target; the largest share below all caps follows from sorted caps.
OP9_SQL = f"""
with docs as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         cast(('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) as o from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, 2.0 * sum(size) as most,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from docs group by source),
steps as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by most / weight, source rows between current row and unbounded following) as share from sources),
level as (select arg_min(share, most / weight) as share from steps where share * weight <= most),
targets as (
  select source, source_size, round(least(most, coalesce(share, 1e300) * weight), 6) as target, least(most, coalesce(share, 1e300) * weight) as exact
  from sources, level),
goals as (select *, cast(floor(exact + 0.5) as bigint) as goal from targets),
along as (
  select doc_id, size, source_size, target, goal // greatest(source_size, 1) as passes, goal % greatest(source_size, 1) as rest,
         sum(size) over (partition by d.source order by o, doc_id) as upto
  from docs d join goals g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, cast(passes * size + greatest(0, least(size, rest - (upto - size))) as bigint) as taken from along"""


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the mix takes, with their words, their source's target and the words taken."""
    mixed = mix(docs, F.array("source"), word_count(whole("text")), seeded_order(F.col("doc_id")))
    return mixed.where(F.col(mixed.columns[-1]) > 0)
