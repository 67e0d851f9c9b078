"""Compare predicted genes of all organisms to their reference annotation in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtables.functions.sequence import coding_length
from seqtables.operators.intervals import boundary_alignment, interval_match, label_genes, match_with_ref
from seqtables.operators.orf import gene_nucleotides, with_codons


def annotate(genes: DataFrame, refs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Genes with codons, length, label and the matched feature's columns and end alignment."""
    own = with_codons(gene_nucleotides(genes, contigs)).withColumn("length", coding_length(F.col("start"), F.col("stop")))
    known = with_codons(gene_nucleotides(refs, contigs)).withColumn(
        "length", coding_length(F.col("start"), F.col("stop"), F.col("feature"))
    )
    labelled = label_genes(interval_match(own, known)).select("id", "locus_tag", "feature", "label")
    return boundary_alignment(own.join(match_with_ref(labelled, known), "id"))
