"""Genome metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtables.functions.parsing import TAXONOMY_LEVELS, strip_source_prefix, taxonomy_level
from seqtables.operators.clean import cast_declared

# Declared types of protein and genome metadata columns. The representative
# and taxonomy columns are text.
DECLARED_TYPES = dict(
    description="string",
    seq="string",
    start="long",
    stop="long",
    strand="long",
    ID="string",
    partial="string",
    start_type="string",
    rbs_motif="string",
    rbs_spacer="string",
    gc_content="double",
    genome_id="string",
    ambiguous_bases="long",
    checkm_completeness="double",
    checkm_contamination="double",
    checkm_marker_count="long",
    checkm_marker_lineage="string",
    checkm_marker_set_count="long",
    coding_bases="long",
    coding_density="double",
    contig_count="long",
    gc_count="long",
    gc_percentage="double",
    genome_size="long",
    gtdb_genome_representative="string",
    gtdb_representative="string",
    gtdb_taxonomy="string",
    gtdb_type_species_of_genus="long",
    l50_contigs="long",
    l50_scaffolds="long",
    longest_contig="long",
    longest_scaffold="long",
    mean_contig_length="long",
    mean_scaffold_length="long",
    mimag_high_quality="string",
    mimag_low_quality="string",
    mimag_medium_quality="string",
    n50_contigs="long",
    n50_scaffolds="long",
    ncbi_assembly_level="string",
    ncbi_bioproject="string",
    ncbi_biosample="string",
    ncbi_genbank_assembly_accession="string",
    ncbi_genome_category="string",
    ncbi_refseq_category="string",
    ncbi_genome_representation="string",
    ncbi_isolate="string",
    ncbi_isolation_source="string",
    ncbi_translation_table="long",
    ncbi_scaffold_count="long",
    ncbi_species_taxid="long",
    ncbi_taxid="long",
    ncbi_taxonomy_id="long",
    ncbi_taxonomy="string",
    protein_count="long",
    scaffold_count="long",
    total_gap_length="long",
    trna_aa_count="long",
    trna_count="long",
    trna_selenocysteine_count="long",
    phylum="string",
    order="string",
    genus="string",
    species="string",
    family="string",
    domain="string",
    prefix="string",
)
DECLARED_TYPES["class"] = "string"


def parse_genomes(rows: DataFrame) -> DataFrame:
    """Representative genomes with prefix, plain genome id, taxonomy levels and declared types.

    Columns without a declared type are dropped; numbers that do not parse become null.
    """
    named = rows.withColumnsRenamed({"accession": "genome_id", "ncbi_taxid": "ncbi_taxonomy_id"})
    kept = named.where(F.col("gtdb_representative") == "t").withColumns(
        {
            "prefix": F.left("genome_id", F.lit(2)),
            "genome_id": strip_source_prefix(F.col("genome_id")),
            **{level: taxonomy_level(F.col("gtdb_taxonomy"), level) for level in TAXONOMY_LEVELS},
        }
    )
    declared = kept.select(*[f"`{c}`" for c in kept.columns if c in DECLARED_TYPES])
    return cast_declared(declared, {c: t for c, t in DECLARED_TYPES.items() if t != "string"})


def read_genomes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Genome metadata tables with a header row. Everything is read as text, then cast."""
    return parse_genomes(spark.read.csv(path, sep="\t", header=True, inferSchema=False))
