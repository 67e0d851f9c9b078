"""Links inside buckets: every pair meets, and pairs that blocks have compared are not compared again."""

from pyspark.sql import functions as F

from seqtables.llm import buckets

MEMBERS = "bucket long, id long, size long"


def test_lowest_member_meets_the_first_ranked_one(spark):
    # 2 meets more than 1 does, so it is first in their bucket, where 1 is the lowest
    members = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (2, 2, 10), (2, 3, 10), (2, 4, 10)], MEMBERS)
    verify = lambda pairs: pairs.withColumn("linked", F.expr("a = 1 and b = 2"))
    elements = lambda ids: ids.select("id", F.col("id").alias("element"))
    got = {r.id: r.component for r in buckets.link_buckets(members, verify, elements, 80).collect()}
    assert got == {1: 1, 2: 1}


def test_confirmed_pairs_of_blocks_are_not_verified_again(spark):
    members = spark.createDataFrame([(1, i, 10) for i in range(1, 5)], MEMBERS)
    seen = []

    def verify(pairs):
        seen.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.withColumn("linked", F.lit(False))

    elements = lambda ids: ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("element"))
    blocks = lambda dealt: spark.createDataFrame([(2, 3)], "a long, b long")
    found = buckets.link_buckets(members, verify, elements, 80, blocks, confirmed=True)
    assert {r.id: r.component for r in found.collect()} == {2: 2, 3: 2}
    assert seen == [{(1, 2), (1, 3), (1, 4)}]
