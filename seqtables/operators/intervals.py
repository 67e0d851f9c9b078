"""Match predicted genes to annotated features by their place on a contig.

No pair of overlapping intervals is ever built. Overlap counts come from running counts
of starts and stops; valid matches share a start or a stop, so the best one is found by
looking up and down within that shared end. Genes and features of a contig are brought
together once, in narrow rows, and all windows run where they then are; what a task holds of a contig is
sorted and spilled by Spark, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.session import release, stack, written

RNA_FEATURES = ("tRNA", "ncRNA", "rRNA", "misc_RNA")  # fixed values
MISC_FEATURES = ("misc_feature", "mobile_element", "repeat_region")  # fixed values
PLACE = ("contig_id", "start", "stop")
SPOT = (*PLACE, "strand")


def _upto(order: Column, *within: str, last: int = 0) -> Window:
    """Rows of the same ``within`` from the first one in ``order`` to those ``last`` behind the current value."""
    return Window.partitionBy("contig_id", *within).orderBy(order).rangeBetween(Window.unboundedPreceding, last)


def _with_overlaps(rows: DataFrame) -> DataFrame:
    """Add n_hits: features that share a position with the interval.

    These are the features that start at or before the stop, less those that stop before the start.
    """
    asked, is_ref = F.col("asked"), (~F.col("asked")).cast("long")
    opens = F.when(asked, F.col("stop")).otherwise(F.col("start"))
    closes = F.when(asked, F.col("start")).otherwise(F.col("stop") + 1)
    opened = F.sum(is_ref).over(_upto(F.col("opens")))
    closed = F.sum(is_ref).over(_upto(F.col("closes")))
    counted = rows.withColumn("opens", opens).withColumn("n_hits", opened).drop("opens")
    return counted.withColumn("closes", closes).withColumn("n_hits", F.col("n_hits") - closed).drop("closes")


def _with_valid(rows: DataFrame) -> DataFrame:
    """Add n_valid_hits and hit: the features of the same strand that share the start or the stop, and the best of them.

    ``hit`` is the one with the widest overlap, ties to the smallest (locus_tag, feature, pseudo).
    """
    is_ref = (~F.col("asked")).cast("long")
    ref = F.when(~F.col("asked"), F.struct("locus_tag", "feature", "pseudo", "start", "stop"))
    at = lambda place: F.when(~F.col("asked"), F.struct(place.alias("at"), ref.alias("ref")))
    same_start, same_stop = ("strand", "start"), ("strand", "stop")
    start, stop = F.col("start"), F.col("stop")
    shorter_a = _upto(stop.asc(), *same_start, last=-1)
    covers_a = _upto(stop.desc(), *same_start)  # features that stop at or after the query's stop
    covers_b = _upto(start.asc(), *same_stop, last=-1)  # those of the same start are in covers_a
    shorter_b = _upto(start.desc(), *same_stop, last=-1)
    n = F.sum(is_ref)
    seen = (
        rows.withColumns({"shorter_a": F.min(at(-stop)).over(shorter_a), "n_1": n.over(shorter_a)})
        .withColumns({"covers_a": F.min(ref).over(covers_a), "n_2": n.over(covers_a)})
        .withColumns({"covers_b": F.min(ref).over(covers_b), "n_3": n.over(covers_b)})
        .withColumns({"shorter_b": F.min(at(start)).over(shorter_b), "n_4": n.over(shorter_b)})
    )

    def option(overlap: Column, ref: Column) -> Column:
        # Negated overlap first: the smallest option is the widest, then the smallest name.
        return F.when(ref.isNotNull(), F.struct((-overlap).alias("less"), ref.alias("ref")))

    width = stop - start
    best = F.least(
        option(width, F.col("covers_a")),
        option(width, F.col("covers_b")),
        option(-F.col("shorter_a.at") - start, F.col("shorter_a.ref")),
        option(stop - F.col("shorter_b.at"), F.col("shorter_b.ref")),
    )
    counts = sum((F.coalesce(F.col(f"n_{i}"), F.lit(0)) for i in (1, 2, 3, 4)), F.lit(0))
    stranded = F.col("strand").isNotNull()
    found = {"n_valid_hits": F.when(stranded, counts).otherwise(0), "hit": F.when(stranded, best["ref"])}
    return seen.where("asked").select(*rows.columns, *[column.alias(name) for name, column in found.items()])


def _together(queries: DataFrame, refs: DataFrame, carried: Sequence[str | Column]) -> DataFrame:
    """Placed queries and features by contig, after the one shuffle: ``carried``, asked, locus_tag, feature, pseudo.

    What is shuffled has one column for both kinds of names, where they are of one type, and one for both flags.
    """
    placed = " and ".join(f"{name} is not null" for name in PLACE)
    kind = F.when(F.col("pseudo"), 1).when(~F.col("pseudo"), 0).otherwise(3).cast("byte")
    both = refs.schema["locus_tag"].dataType == queries.schema["id"].dataType
    tag = "id" if both else "locus_tag"
    rows = stack(
        refs.where(placed).select(*SPOT, kind.alias("kind"), F.col("locus_tag").alias(tag), "feature"),
        queries.where(placed).select(*carried, F.lit(2).cast("byte").alias("kind")),
        allow_missing=True,
    ).repartition("contig_id")
    asked = F.col("kind") == 2
    own = ["id", *[c for c in rows.columns if c not in ("id", "kind", "locus_tag", "feature")]]
    names = [F.when(asked, F.col("id")).alias("id") if both and c == "id" else F.col(c) for c in own]
    pseudo = F.when(F.col("kind") == 1, True).when(F.col("kind") == 0, False)
    return rows.select(*names, asked.alias("asked"), F.when(~asked, F.col(tag)).alias("locus_tag"), "feature", pseudo.alias("pseudo"))


def interval_match(queries: DataFrame, refs: DataFrame, keep: Sequence[str] = (), places: bool = False) -> DataFrame:
    """One row per query: id, n_hits, n_valid_hits and feature, locus_tag, pseudo of the best hit.

    ``queries`` needs (id, contig_id, start, stop, strand); ``refs`` (locus_tag, contig_id,
    start, stop, strand, feature, pseudo). Intervals are 1-based and inclusive, start <= stop.
    A query without contig, start or stop has no hits, one without strand no valid ones.
    ``keep`` names further columns of the queries that follow the id, which saves a join with them.
    ``places`` adds hit_start and hit_stop, the place of the best hit.
    """
    placed = " and ".join(f"{name} is not null" for name in PLACE)
    carried = ["id", *SPOT, *[F.col(c).alias(f"__{c}") for c in keep if c not in SPOT]]
    rows = _together(queries, refs, carried)
    found = _with_valid(_with_overlaps(rows))
    beside = queries.where(f"not ({placed})").select(*carried)
    return stack(found, beside, allow_missing=True).select(
        "id",
        *[F.col(c if c in SPOT else f"__{c}").alias(c) for c in keep],
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce("n_valid_hits", F.lit(0)).cast("long").alias("n_valid_hits"),
        F.col("hit.feature").alias("feature"),
        F.col("hit.locus_tag").alias("locus_tag"),
        F.col("hit.pseudo").alias("pseudo"),
        *([F.col(f"hit.{c}").alias(f"hit_{c}") for c in ("start", "stop")] if places else []),
    )


def label_genes(matches: DataFrame) -> DataFrame:
    """Add ``label``: misc, rna, cds, pseudo, error (hits, none valid) or inter (no hits)."""
    feature, pseudo = F.col("feature"), F.coalesce(F.col("pseudo"), F.lit(False))
    return matches.withColumn(
        "label",
        F.when(feature.isin(*MISC_FEATURES), "misc")
        .when(feature.isin(*RNA_FEATURES), "rna")
        .when((feature == "CDS") & ~pseudo, "cds")
        .when(pseudo, "pseudo")
        .when((F.col("n_hits") > 0) & (F.col("n_valid_hits") == 0), "error")
        .when(F.col("n_hits") == 0, "inter"),
    )


def _first_rows(refs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The first row by place of each (locus_tag, feature), and the names of its further columns."""
    others = [c for c in refs.columns if c not in ("locus_tag", "feature")]
    by_place = F.struct("contig_id", "start", "stop", *[c for c in others if c not in ("contig_id", "start", "stop")])
    return refs.groupBy("locus_tag", "feature").agg(F.min(by_place).alias("row")), others


def match_with_ref(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """Matches of genes (see ``interval_match``) with the matched feature's columns under a ``ref_`` prefix.

    Locus tags repeat across features, so the key is (locus_tag, feature); of several
    reference rows under one key the first by place is kept. Matches with the places of their hits, their own
    place and strand have all columns of a feature that is alone under its key, if it has no others: then only the
    features under the other keys are joined, which hashes of all keys tell.
    """
    placed = {"hit_start", "hit_stop", "contig_id", "strand", "pseudo"} <= set(matches.columns)
    if placed and set(refs.columns) == {"locus_tag", "feature", "pseudo", *SPOT}:
        return _match_by_place(matches, refs)
    first, others = _first_rows(refs)
    single = (
        first.select("locus_tag", "feature", *[F.col(f"row.{c}").alias(f"ref_{c}") for c in others])
        .withColumn("ref_locus_tag", F.col("locus_tag"))
        .withColumn("ref_feature", F.col("feature"))
        .withColumnRenamed("locus_tag", "__tag")
    )
    return _with_tag(matches).join(single, ["__tag", "feature"], "left").drop("__tag")


def _with_tag(matches: DataFrame) -> DataFrame:
    # genes without a match would all go to one task; they have no feature, which no row equals
    return matches.withColumn("__tag", F.coalesce("locus_tag", F.concat(F.lit("\0"), F.col("id").cast("string"))))


def _match_by_place(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """``match_with_ref`` of matches that know the place of their hit."""
    spark = refs.sparkSession
    key = F.xxhash64("locus_tag", "feature")
    hashes = refs.where("locus_tag is not null and feature is not null").select(key.alias("__key"))
    # dealt before they are counted: as nearly all are of one row, counting earlier would only take room
    counts = hashes.repartition("__key").groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    several, _ = written(counts.where("n > 1").select("__key"), "repeated-keys")
    release(spark, 0.0)
    first, others = _first_rows(refs.join(several, key == F.col("__key"), "left_semi"))
    known, _ = written(first.withColumnRenamed("locus_tag", "__tag"), "repeated-rows")
    release(spark, 0.0)
    joined = _with_tag(matches).join(known, ["__tag", "feature"], "left").drop("__tag")
    own = {"start": "hit_start", "stop": "hit_stop", "pseudo": "pseudo", "contig_id": "contig_id", "strand": "strand"}
    named = F.col("locus_tag").isNotNull() & F.col("feature").isNotNull()
    of = lambda c: F.when(F.col("row").isNotNull(), F.col(f"row.{c}")).when(named, F.col(own[c]))
    kept = ["feature", *[c for c in matches.columns if c not in ("feature", "hit_start", "hit_stop")]]
    refers = [F.when(named, F.col(c)).alias(f"ref_{c}") for c in ("locus_tag", "feature")]
    return joined.select(*kept, *[of(c).alias(f"ref_{c}") for c in others], *refers)


def boundary_alignment(genes: DataFrame) -> DataFrame:
    """Add which ends agree with the reference and the category of the agreement."""
    forward = F.col("strand") == 1
    backward = F.col("strand") == -1
    return (
        genes.withColumn("start_aligned", F.col("start") == F.col("ref_start"))
        .withColumn("stop_aligned", F.col("stop") == F.col("ref_stop"))
        .withColumn(
            "c_terminus_aligned",
            (F.col("stop_aligned") & forward) | (F.col("start_aligned") & backward),
        )
        .withColumn(
            "n_terminus_aligned",
            (F.col("start_aligned") & forward) | (F.col("stop_aligned") & backward),
        )
        .withColumn(
            "alignment",
            F.when(F.col("n_terminus_aligned") & F.col("c_terminus_aligned"), "both")
            .when(F.col("n_terminus_aligned"), "n_terminus")
            .when(F.col("c_terminus_aligned"), "c_terminus"),
        )
    )
