"""Links among the members of hash buckets, without writing out all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtables.llm.common import settled
from seqtables.llm.graph import components

GROWTH = 4
Step = Callable[[DataFrame], DataFrame]


def link_buckets(members: DataFrame, verify: Step, elements: Step, percent: int, blocks: Step | None = None, confirmed: bool = False) -> DataFrame:
    """Components (id, component) of the ids that true links inside buckets connect.

    members: (bucket, id, size), each bucket and id once; size is that of the set behind an id.
    verify: takes distinct pairs (a, b), a < b, and returns (a, b, linked). elements: takes ids
    and returns (id, element), the sets themselves. Two sets are linked only if at least
    ``percent`` of their union is common.

    Members are ranked in their bucket, those first that meet most others in all their buckets:
    in a family of edited copies these are the least edited. First all are compared with the
    first one; then, in rounds over ranks 2 to 7, 8 to 31 and so on, with those of other
    components than their own. A pair is left out only if its ends are known to be in one
    component, or if too few elements of one of them occur in any other open component at all, so
    no link between components is lost. Copies of one text, however many, drop out after a round or
    two; so do texts that have a passage in common but also enough of their own.

    blocks, if given, takes what is open after the first round, dealt into blocks (see
    ``_dealt``), and returns the pairs (a, b) that may be linked; it replaces the further rounds.
    confirmed: these pairs are links and need not be verified.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    central = members.join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("met"))
    order = Window.partitionBy("bucket").orderBy(F.desc("met"), "id")
    state = settled(
        members.join(central, "id")
        .withColumn("rank", F.row_number().over(order))
        .select("bucket", "id", "size", F.col("size").alias("common"), "rank", F.col("id").alias("component"))
    )
    links: DataFrame | None = None
    tested: DataFrame | None = None
    low, high = 1, 2
    while True:
        x = state.alias("x")
        y = state.where((F.col("rank") >= low) & (F.col("rank") < high)).alias("y")
        met = x.join(y, F.col("x.bucket") == F.col("y.bucket")).where(
            (F.col("x.component") != F.col("y.component"))
            & (F.lit(100 + percent) * F.least("x.common", "y.common") >= F.lit(percent) * (F.col("x.size") + F.col("y.size")))
        )
        pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        if blocks is not None and tested is not None:
            pairs = blocks(_dealt(state)).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if confirmed and blocks is not None and tested is not None:
            checked = settled(pairs.withColumn("linked", F.lit(True)))
        else:
            checked = settled(verify(settled(pairs)))
        tested = checked.select("a", "b") if tested is None else tested.union(checked.select("a", "b"))
        found = checked.where("linked").select("a", "b")
        first = links is None
        if first or not found.isEmpty():
            links = found if first else links.union(found)
            joined = components(links)
        labelled = settled(
            state.drop("component")
            .join(joined.withColumnRenamed("id", "key"), F.col("id") == F.col("key"), "left")
            .select("bucket", "id", "size", "common", "rank", F.coalesce("component", "id").alias("component"))
        )
        if blocks is not None and not first:
            return joined
        state = settled(_open(labelled, high))
        if not state.isEmpty():
            state = settled(_open(_with_common(state, elements, percent), high))
        if state.isEmpty():
            return joined
        low, high = high, high * GROWTH


BLOCK = 512


def _dealt(state: DataFrame) -> DataFrame:
    """(bucket, left, right, mine, id, component): members in blocks, and blocks in pairs to be compared.

    Blocks hold at most BLOCK members of a bucket, those of its lowest component apart from the
    others. Two blocks of that component are not compared. A member comes once for every pair
    that its block is in; mine tells which of the two it belongs to.
    """
    bucket = Window.partitionBy("bucket")
    marked = state.withColumn("other", F.col("component") != F.min("component").over(bucket))
    turn = F.row_number().over(Window.partitionBy("bucket", "other").orderBy("rank"))
    placed = marked.withColumn("block", F.floor((turn - 1) / BLOCK).cast("int"))
    count = lambda side: F.max(F.when(F.col("other") == side, F.col("block") + 1)).over(bucket)
    sized = placed.withColumns({"others": count(True), "mains": count(False)})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda left, right: F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"))
    own = F.col("block")
    among = F.transform(upto("others"), lambda j: pair(F.least(own, j), F.greatest(own, j)))
    with_main = F.transform(upto("mains"), lambda j: pair(own, -1 - j))
    of_main = F.transform(upto("others"), lambda i: pair(i, -1 - own))
    mine = F.when(F.col("other"), own).otherwise(-1 - own)
    tasks = F.when(F.col("other"), F.concat(among, with_main)).otherwise(of_main)
    return sized.select("bucket", "id", "component", mine.alias("mine"), F.inline(tasks))


def _open(labelled: DataFrame, high: int) -> DataFrame:
    """Members whose rank is still to come, of buckets where these are of several components.

    Every pair with a member of a lower rank has been compared or ruled out.
    """
    rest = labelled.where(F.col("rank") >= high)
    spans = rest.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    return rest.join(spans.where("first <> last").select("bucket"), "bucket")


def _with_common(state: DataFrame, elements: Step, percent: int) -> DataFrame:
    """common: how many elements of each set also occur in another open component.

    Sets that can have no link outside their component are left out; of a component that is
    left with members, all that can have one stay.
    """
    ids = settled(state.select("id", "size", F.col("component").alias("of")).distinct())
    held = elements(ids.select("id")).join(ids, "id")
    of_element = Window.partitionBy("element")
    spread = held.withColumns({"low": F.min("of").over(of_element), "high": F.max("of").over(of_element)}).where("low <> high")
    counts = spread.groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    able = counts.join(ids, "id").where(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("size"))
    able = settled(able.select(F.col("id").alias("key"), F.col("shared").alias("common")))
    return state.drop("common").join(able, F.col("id") == F.col("key")).select("bucket", "id", "size", "common", "rank", "component")
