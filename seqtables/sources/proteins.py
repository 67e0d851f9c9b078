"""Protein entries in XML, one row per accession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINEAGE = ("domain", "kingdom", "phylum", "class", "order", "family", "genus")  # fixed values
ENTRY_SCHEMA = """
accession array<string>,
name array<string>,
organism struct<
    name: array<struct<_VALUE: string, _type: string>>,
    dbReference: array<struct<_type: string, _id: string>>,
    lineage: struct<taxon: array<string>>>,
dbReference array<struct<
    _type: string, _id: string, property: array<struct<_type: string, _value: string>>>>,
comment array<struct<_type: string, text: array<struct<_VALUE: string>>>>,
proteinExistence struct<_type: string>,
feature array<struct<
    _type: string,
    location: struct<position: struct<_position: string>>>>,
sequence array<struct<_VALUE: string, _length: string>>
"""


def _first_of(items: str, kind: str) -> Column:
    return F.get(F.filter(items, lambda item: item["_type"] == kind), F.lit(0))


def parse_entries(entries: DataFrame, load_seqs: bool = True) -> DataFrame:
    """Entries in ``ENTRY_SCHEMA`` (plus file_name) to one row per accession."""
    refseq = _first_of("dbReference", "RefSeq")
    nucleotide = F.get(
        F.filter(refseq["property"], lambda p: p["_type"] == "nucleotide sequence ID"), F.lit(0)
    )["_value"]
    ends = F.transform(
        F.filter("feature", lambda f: f["_type"] == "non-terminal residue"),
        lambda f: f["location"]["position"]["_position"],
    )
    name = F.get("name", F.lit(0))
    columns = [
        F.explode("accession").alias("id"),
        name.alias("name"),
        *[F.get("organism.lineage.taxon", F.lit(i)).alias(level) for i, level in enumerate(LINEAGE)],
        # The first name of an entry is its mnemonic; the organism's own name comes extra.
        name.alias("species"),
        F.get("organism.name", F.lit(0))["_VALUE"].alias("organism_name"),
        _first_of("organism.dbReference", "NCBI Taxonomy")["_id"].alias("ncbi_taxonomy_id"),
        refseq["_id"].alias("refseq_protein_id"),
        nucleotide.alias("refseq_nucleotide_id"),
        F.when(F.size(ends) > 0, F.array_join(ends, ",")).alias("non_terminal_residue"),
        _first_of("dbReference", "KEGG")["_id"].alias("kegg"),
        F.get(_first_of("comment", "function")["text"], F.lit(0))["_VALUE"].alias("function"),
        F.col("proteinExistence._type").alias("existence"),
        "file_name",
    ]
    if load_seqs:
        last = F.try_element_at("sequence", F.lit(-1))["_VALUE"]
        columns.append(F.regexp_replace(last, "\\s", "").alias("seq"))
    return entries.select(*columns)


def read_protein_xml(spark: SparkSession, path: str | list[str], load_seqs: bool = True) -> DataFrame:
    """XML files of protein entries. Files are split between entries."""
    reader = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true")
    entries = reader.schema(ENTRY_SCHEMA).load(path)
    named = entries.select("*", F.col("_metadata.file_name").alias("file_name"))
    return parse_entries(named, load_seqs)
