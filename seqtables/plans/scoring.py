"""Score feature tables of many genomes and put the results together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqtables.operators.assemble import results_star
from seqtables.operators.clean import lookup
from seqtables.operators.model import Classifier, predict_positives


def score_genomes(
    classifier: Classifier, features: DataFrame, genes: DataFrame, annotations: DataFrame, copies: DataFrame, genomes: DataFrame
) -> DataFrame:
    """Predicted positives with gene, annotation, copy-number and genome data.

    The big tables are cut down to the predicted ids before the joins.
    """
    found = predict_positives(classifier, features).drop("features")
    return results_star(
        found, lookup(genes, found, "id"), lookup(annotations, found, "id").select("id", "ko"), copies, genomes
    )
