"""Queries over encoders, pooling, resampling, training and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables.catalog.registry import query
from seqtables.operators import features, model

CLASSES, DIMS = 3, 64
# A fixed linear model by rule, the same in both engines.
WEIGHTS = [[((7 * j + 13 * c) % 11 - 5) / 10 for j in range(DIMS)] for c in range(CLASSES)]
BIASES = [c / 10 for c in range(CLASSES)]
_LOGITS = """logits as materialized (select id, label % 3 as label, list_transform(range(0, 3), lambda c: list_sum(list_transform(range(0, 64),
            lambda j: cast(features[j + 1] as double) * (((7 * j + 13 * c) % 11 - 5) / 10))) + c / 10) as z from {vectors})"""


@query()
def encode_hash(t):
    encoded = features.encode(t.seqs.select("id", "seq"), features.hash_encoder(32))
    return encoded.select("id", F.size("features").alias("dims"), "error")


_TOKENS = "(select id, pos, cast(dim - 1 as integer) as dim, cast(v[dim] as double) as value from (select *, unnest(range(1, 65)) as dim from {token_vectors}))"


@query(f"select id, dim, round(avg(value), 6) as value from {_TOKENS} group by id, dim")
def pool_mean(t):
    return features.pool_long(t.token_vectors).withColumn("value", F.round("value", 6))


@query(
    f"select id, dim, round(avg(value), 6) as value from (select * from {_TOKENS} qualify row_number() over (partition by id, dim order by pos desc) <= 3) group by id, dim"
)
def pool_last_n(t):
    return features.pool_long(t.token_vectors, 3).withColumn("value", F.round("value", 6))


@query()
def balanced_resample(t):
    return model.balanced_resample(t.preds.select("id", "label"))


@query(
    f"""with {_LOGITS}, n as (select label, count(*) as n, sum(count(*)) over () / (count(*) * count(*) over ()) as w from logits group by label)
select round(sum(w * (ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1])) / count(*), 9) as loss from logits join n using (label)"""
)
def weighted_ce(t):
    labelled = t.vectors.withColumn("label", F.col("label") % CLASSES)
    scored = labelled.withColumn("z", model.linear_logits(F.col("features"), WEIGHTS, BIASES))
    return model.weighted_cross_entropy(scored, "z").withColumn("loss", F.round("loss", 9))


@query(
    f"""with {_LOGITS}, e as (select id, z, list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) as total from logits)
select id, cast(list_position(z, list_max(z)) - 1 as integer) as prediction, round(exp(z[1] - list_max(z)) / total, 6) as probability_0,
       round(exp(z[2] - list_max(z)) / total, 6) as probability_1, round(exp(z[3] - list_max(z)) / total, 6) as probability_2 from e"""
)
def predict_linear(t):
    scored = model.predict_linear(t.vectors, WEIGHTS, BIASES)
    return scored.select("id", "prediction", *[F.round(f"probability_{c}", 6).alias(f"probability_{c}") for c in range(CLASSES)])


def _trained(t):
    rows = t.vectors.withColumn("label", F.col("label") % CLASSES)
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(10))
    return rows, model.train_classifier(rows.where(part < 7), rows.where(part >= 7), CLASSES, hidden=(32,), epochs=3, steps=10)


@query()
def train_mlp(t):
    rows, fitted = _trained(t)
    return fitted.predict(rows).select("id", "label", "prediction", *[f"probability_{c}" for c in range(CLASSES)])


@query()
def training_curve(t):
    return _trained(t)[1].training_curve(t.spark)
