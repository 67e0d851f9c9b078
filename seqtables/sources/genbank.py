"""GenBank flat files: annotated features and contig sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.functions.parsing import genome_id_of, parse_coordinate, parse_note
from seqtables.functions.rows import explode_words
from seqtables.functions.sequence import clean_nucleotides

# Feature keys that are read and the location pattern.
FEATURE_KEYS = ("gene", "CDS", "tRNA", "ncRNA", "rRNA", "misc_RNA", "repeat_region", "misc_feature", "mobile_element")
LOCATION = "complement\\([<\\d]+\\.\\.[>\\d]+\\)|[<\\d]+\\.\\.[>\\d]+"
RECORD_END = "\n//\n"


def read_flat_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row (value, genome_id) per contig record."""
    records = spark.read.option("lineSep", RECORD_END).text(path)
    return records.select("value", genome_id_of(F.col("_metadata.file_path")).alias("genome_id"))


def _contig_id() -> Column:
    return F.regexp_extract("value", "LOCUS\\s+(\\S+)", 1)


def _qualifier(name: str) -> Column:
    return F.nullif(F.array_join(F.regexp_extract_all("body", F.lit(f'/{name}="([^"]+)"'), F.lit(1)), ", "), F.lit(""))


def parse_features(records: DataFrame) -> DataFrame:
    """Features of contig records with a locus tag, 'gene' left out.

    Feature keys stand five columns in, qualifiers further right; so a split at those lines
    hands out whole features. Repeated qualifiers are joined by ', '.
    """
    extra = [c for c in records.columns if c != "value"]
    head = F.split("value", "\nORIGIN", 2)[0]
    chunks = F.split(F.regexp_replace(head, "\r", ""), "\n {5}(?=[A-Za-z])")
    # The first piece is the record's header; it begins with no feature key and is dropped.
    features = explode_words(records, chunks, "chunk", *extra, _contig_id().alias("contig_id"))
    keyed = features.withColumn("feature", F.regexp_extract("chunk", "^(\\S+)", 1)).where(
        F.col("feature").isin(*[key for key in FEATURE_KEYS if key != "gene"])
    )
    location = F.regexp_extract("chunk", LOCATION, 0)
    body = F.regexp_replace(F.regexp_replace("chunk", LOCATION, ""), "\\s{2,}|\n", "")
    rows = keyed.select(
        *extra, "contig_id", "feature", location.alias("coordinate"), body.alias("body"), F.col("chunk").contains("/pseudo").alias("pseudo")
    ).where("coordinate != ''")
    return (
        rows.withColumn("place", parse_coordinate(F.col("coordinate")))
        .withColumn("flags", parse_note(_qualifier("note")))
        .select(
            *extra,
            _qualifier("locus_tag").alias("locus_tag"),
            "feature",
            "contig_id",
            "place.strand",
            "place.start",
            "place.stop",
            "place.partial",
            _qualifier("product").alias("product"),
            "flags.frameshifted",
            "flags.incomplete",
            "flags.internal_stop",
            _qualifier("protein_id").alias("protein_id"),
            _qualifier("translation").alias("seq"),
            "pseudo",
        )
        .where("locus_tag is not null")
    )


def parse_contigs(records: DataFrame) -> DataFrame:
    """Contig sequences: the text after ORIGIN without numbers and white space, upper-case."""
    extra = [c for c in records.columns if c != "value"]
    origin = F.regexp_replace(F.get(F.split("value", "\nORIGIN", 2), F.lit(1)), "//\\s*$", "")
    return records.where(_contig_id() != "").select(
        *extra, _contig_id().alias("contig_id"), clean_nucleotides(origin).alias("nt")
    )


def read_features(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Annotated features of flat files."""
    return parse_features(read_flat_records(spark, path))


def read_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Contig sequences of flat files."""
    return parse_contigs(read_flat_records(spark, path))
