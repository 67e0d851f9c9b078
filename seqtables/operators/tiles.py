"""Contigs cut into tiles, so that a slice costs its own length and a long contig is spread over tasks.

A tile holds ``width`` nucleotides and the two after them: every codon that starts in a tile can be
read from it. ``width`` is a multiple of three, so a reading frame is the same in all tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.functions.sequence import STOP_CODONS, reverse_complement

WIDTH = 8190
NEAR = 300
NEXT_STOP = f"^(?:.{{3}})*?(?:{'|'.join(STOP_CODONS)})"


def contig_tiles(contigs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(contig_id, tile, text): one pass over each contig; tile t starts at place t * width + 1."""
    if width < 3 or width % 3:
        raise ValueError("the width of tiles must be a multiple of three")
    parts = F.regexp_extract_all("nt", F.lit(f"(?s)(?=(.{{1,{width + 2}}})).{{1,{width}}}"), F.lit(1))
    return contigs.select("contig_id", F.posexplode(parts).alias("tile", "text"))


def tiled(contigs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(contig_id, __size, __tiles): a contig's length and its tiles, here without the two letters after them."""
    parts = F.regexp_extract_all("nt", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return contigs.select("contig_id", F.length("nt").cast("long").alias("__size"), parts.alias("__tiles"))


def tile_slice(tiles: Column, first: Column, last: Column, width: int = WIDTH) -> Column:
    """Forward nucleotides of an interval inside its contig, read from the tiles it touches; empty if it ends before it starts.

    Only expressions that Spark compiles: others would copy the whole contig for each interval.
    """
    place = lambda c: F.floor((c - 1) / width).cast("int")
    begin, end = place(first), place(last)
    low = (first - begin.cast("long") * width).cast("int")
    within = F.substring(F.get(tiles, begin), low, (last - first + 1).cast("int"))
    between = F.array_join(F.slice(tiles, begin + 2, F.greatest(end - begin - 1, F.lit(0))), "")
    tail = F.substring(F.get(tiles, end), F.lit(1), (last - end.cast("long") * width).cast("int"))
    across = F.concat(F.substring(F.get(tiles, begin), low, F.lit(width)), between, tail)
    return F.when(first > last, "").when(begin == end, within).otherwise(across)


def _stop_length(text: Column) -> Column:
    """Letters up to and with the first stop codon in frame, null without one."""
    found = F.length(F.regexp_extract(text, NEXT_STOP, 0))
    return F.when(found > 0, found)


def stop_index(tiles: DataFrame, width: int = WIDTH) -> DataFrame:
    """(contig_id, tile, after, before): per frame, where the nearest stop codon outside the tile starts.

    ``after[f]`` is the first one on the forward strand in later tiles, ``before[f]`` the last one
    of the reverse strand in earlier tiles, among codons whose first place is f modulo three.
    The windows hold one narrow row per tile of a contig; a contig is one string, so these are few.
    """
    begin, size = F.col("tile").cast("long") * width, F.length("text")
    other = reverse_complement(F.col("text"))
    firsts, lasts = [], []
    for frame in range(3):
        lead = (frame + 2) % 3  # letters before the first codon of the frame
        firsts.append((begin + lead + _stop_length(F.substring("text", lead + 1, width + 2)) - 2).alias(f"first{frame}"))
        tail = F.pmod(size - 2 - frame, F.lit(3))
        found = _stop_length(F.substring(other, (tail + 1).cast("int"), F.lit(width + 2)))
        lasts.append((begin + size - tail - found + 1).alias(f"last{frame}"))
    ends = tiles.select("contig_id", "tile", *firsts, *lasts)
    onward = Window.partitionBy("contig_id").orderBy(F.desc("tile")).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("contig_id").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        "contig_id",
        "tile",
        F.array(*[F.min(f"first{f}").over(onward) for f in range(3)]).alias("after"),
        F.array(*[F.max(f"last{f}").over(back) for f in range(3)]).alias("before"),
    )


def next_stops(places: DataFrame, tiles: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add ``found`` to (contig_id, codon, backward): where the next stop codon in frame starts, or null.

    ``codon`` is the first place of the first codon to look at; with ``backward`` the search goes
    down along the contig on the reverse strand. A search reads the rest of one tile; beyond it
    the index tells the answer, so a miss costs no second scan.
    """
    at = F.floor((F.col("codon") - 1) / width).cast("int")
    begin = F.col("tile").cast("long") * width
    local = (F.col("codon") - begin).cast("int")
    low = F.greatest(local + 3 - NEAR, F.lit(1))
    # most stops are near; the rest of the tile is copied only where none is
    ahead = F.coalesce(*[_stop_length(F.substring("text", local, F.lit(size))) for size in (NEAR, width + 2)])
    behind = F.coalesce(*[_stop_length(reverse_complement(F.substring("text", start, local + 3 - start))) for start in (low, F.lit(1))])
    frame = F.pmod("codon", F.lit(3)).cast("int")
    found = F.when(F.col("backward"), F.coalesce(F.col("codon") + 3 - behind, F.get("before", frame))).otherwise(
        F.coalesce(F.col("codon") + ahead - 3, F.get("after", frame))
    )
    keyed = places.withColumn("tile", at).join(tiles, ["contig_id", "tile"])
    return keyed.join(stop_index(tiles, width), ["contig_id", "tile"]).select("contig_id", "codon", "backward", found.alias("found"))
