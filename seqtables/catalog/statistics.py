"""Queries over grouped statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqtables.catalog.registry import query
from seqtables.functions import sequence
from seqtables.operators import dedupe, model, orf, stats

_MODELS = ("model_3c_a_prediction", "model_3c_b_prediction")
_LONG = """long as (select id, dataset, label, 'model_3c_a_prediction' as model, model_3c_a_prediction as prediction from {preds}
         union all select id, dataset, label, 'model_3c_b_prediction', model_3c_b_prediction from {preds})"""


def _rounded(frame, *columns, digits=9):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@query("select query_id, count(*) as n_hits from {hsps} where e_value < 0.05 group by query_id")
def hits_per_group(t):
    return stats.group_counts(t.hsps.where("e_value < 0.05"), "query_id", name="n_hits")


@query("select ko, count(*) as n from {annotations} where ko is not null group by ko order by n desc, ko")
def value_counts(t):
    return stats.value_counts(t.annotations, "ko")


@query(
    """
select genome_id, count(*) filter (ko = 'Brand#1') as sel_a_copy_number, count(*) filter (ko = 'Brand#2') as sel_b_copy_number,
       count(*) filter (ko = 'Brand#3') as sel_d_copy_number
from {annotations} where meets_threshold is not null and ko in ('Brand#1', 'Brand#2', 'Brand#3') group by genome_id"""
)
def copy_numbers_pivot(t):
    names = {"Brand#1": "sel_a_copy_number", "Brand#2": "sel_b_copy_number", "Brand#3": "sel_d_copy_number"}
    return stats.pivot_counts(t.annotations.where("meets_threshold is not null"), "genome_id", "ko", names)


@query(
    f"""with {_LONG} select model, case when grouping(dataset) = 1 then 'total' else dataset end as dataset,
count(*) filter (prediction = 0) as class_0, count(*) filter (prediction = 1) as class_1, count(*) filter (prediction = 2) as class_2
from long group by grouping sets ((model, dataset), (model))"""
)
def prediction_crosstab(t):
    return stats.prediction_crosstab(t.preds, "dataset", _MODELS, (0, 1, 2))


@query(f"with {_LONG} select label, model, count(*) filter (prediction = 1) as n from long group by label, model")
def label_model_counts(t):
    long = stats.unpivot_predictions(t.preds, ["label"], _MODELS)
    return long.groupBy("label", "model").agg(F.count_if(F.col("prediction") == 1).alias("n"))


@query(
    "select dataset, label, count(distinct mmseqs_representative) as n_clusters, count(*) as n from {preds} join {clusters} using (id) group by dataset, label"
)
def clusters_per_split(t):
    joined = t.preds.join(t.clusters, "id")
    return joined.groupBy("dataset", "label").agg(
        F.countDistinct("mmseqs_representative").alias("n_clusters"), F.count(F.lit(1)).alias("n")
    )


@query(
    """
select label, prediction, n, round(n / sum(n) over (partition by label), 9) as fraction
from (select l.label, p.prediction, count(c.id) as n from (select distinct label from {preds}) l cross join (values (0), (1), (2)) as p(prediction)
      left join {preds} c on c.label = l.label and c.model_3c_a_prediction = p.prediction group by 1, 2)"""
)
def confusion_matrix(t):
    return _rounded(stats.confusion_matrix(t.preds, "label", _MODELS[0], (0, 1, 2)), "fraction")


@query(
    """
select a as model_3c_a_prediction, b as model_3c_b_prediction, count(c.id) as n from (values (0), (1)) as x(a) cross join (values (0), (1), (2)) as y(b)
left join {preds} c on model_3c_a_prediction = a and model_3c_b_prediction = b group by a, b"""
)
def model_contingency(t):
    return stats.contingency(t.preds, *_MODELS, (0, 1), (0, 1, 2))


@query(
    "select round(avg(r), 9) as balanced_accuracy from (select label, avg(case when label = model_3c_a_prediction then 1.0 else 0.0 end) as r from {preds} group by label)"
)
def balanced_accuracy(t):
    return _rounded(stats.balanced_accuracy(t.preds, "label", _MODELS[0]), "balanced_accuracy")


@query(
    f"""with {_LONG}, merged as (select dataset, model, case label when 2 then 0 else label end as label, case prediction when 2 then 0 else prediction end as prediction from long)
select dataset, model, round(avg(r), 9) as balanced_accuracy from (select dataset, model, label, avg(case when label = prediction then 1.0 else 0.0 end) as r from merged group by 1, 2, 3)
group by dataset, model"""
)
def accuracy_sweep(t):
    return _rounded(stats.accuracy_sweep(t.preds, "label", _MODELS, ["dataset"], {2: 0}), "balanced_accuracy")


@query(
    """
with v as (select e_value, l_linenumber from {hsps}), grid as (select i * (0.1 / 100) as x from unnest(range(101)) as u(i)),
c as (select l_linenumber, e_value, count(*) as w from v group by 1, 2)
select l_linenumber, round(x, 9) as x, round(sum(case when e_value < x then w else 0 end) / sum(w), 9) as fraction from c cross join grid group by l_linenumber, x"""
)
def ecdf(t):
    return _rounded(stats.ecdf(t.hsps, "e_value", "l_linenumber", 0.1, 101), "x", "fraction")


@query(
    """
with v as materialized (select domain, length(seq) as length from {seqs}), s as (select min(length) as low, (max(length) - min(length)) / 25.0 as w from v),
b as (select domain, cast(least(floor((length - low) / cast(w as double)), 24) as integer) as bin, cast(low as double) as base, cast(w as double) as w from v, s)
select domain, bin, round(base + bin * w, 6) as low, count(*) as n, round(count(*) / (sum(count(*)) over (partition by domain) * w), 12) as density from b group by domain, bin, base, w"""
)
def histogram(t):
    lengths = t.seqs.select("domain", F.length("seq").alias("length"))
    return stats.histogram(lengths, "length", 25, "domain").withColumns(
        {"low": F.round("low", 6), "density": F.round("density", 12)}
    )


@query(
    f"""
with v as materialized (select domain, cast(length(seq) as double) as length from {{seqs}}),
s as (select domain, count(*) as n, min(length) as low, max(length) as high, stddev_samp(length) * pow(count(*), -0.2) as h from v group by domain),
g as (select domain, n, h, cast(i as integer) as i, low + i * ((high - low) / 49) as x from s, unnest(range(50)) as u(i))
select g.domain, g.i, round(any_value(x), 6) as x, round(sum(exp(-0.5 * pow((x - length) / h, 2))) / (any_value(n) * any_value(h) * {math.sqrt(2 * math.pi)}), 10) as density
from g join v on g.domain = v.domain group by g.domain, g.i"""
)
def kde(t):
    lengths = t.seqs.select("domain", F.length("seq").alias("length"))
    return stats.kernel_density(lengths, "length", "domain").withColumns(
        {"x": F.round("x", 6), "density": F.round("density", 10)}
    )


@query(
    "select domain, count(*) as n, round(avg(length(seq)), 6) as mean, round(stddev_samp(length(seq)), 6) as std, round(stddev_samp(length(seq)) / sqrt(count(*)), 6) as sem from {seqs} group by domain"
)
def group_mean_sem(t):
    lengths = t.seqs.select("domain", F.length("seq").alias("length"))
    return _rounded(stats.mean_sem(lengths, "length", "domain"), "mean", "std", "sem", digits=6)


def _mwu_sql(source: str, key: str = "") -> str:
    by, lead = (f"group by {key}", f"{key}, ") if key else ("", "")
    part = f"partition by {key}" if key else ""
    # Orders counted by rank sum stand for the exact distribution, Simpson's rule for the normal one.
    return f"""
with recursive v as materialized ({source}), c as (select {lead}v, sum(cast(first as bigint)) as a, sum(1 - cast(first as bigint)) as b from v group by {lead}v),
r as (select {lead}a, b, coalesce(sum(b) over ({part} order by v rows between unbounded preceding and 1 preceding), 0) as below from c),
u as (select {lead}cast(sum(a) as bigint) as n1, cast(sum(b) as bigint) as n2, cast(sum(a * (below + 0.5 * b)) as double) as u,
             sum(pow(cast(a + b as double), 3) - cast(a + b as double)) as tie_term from r {by}),
n as (select *, cast(n1 as double) as d1, cast(n2 as double) as d2, tie_term = 0 and least(n1, n2) between 1 and 8 as exact from u),
z as materialized (select *, (abs(u - d1 * d2 / 2.0) - 0.5) / nullif(sqrt(d1 * d2 / 12.0 * ((d1 + d2 + 1) - tie_term / nullif((d1 + d2) * (d1 + d2 - 1), 0))), 0) as z from n),
ways as (select 0 as i, 0 as k, 0 as s, 1.0::double as ways
         union all select i + 1, k + t, s + t * (i + 1), sum(ways) from ways, (values (0), (1)) as x(t) where i < (select max(n1 + n2) from z where exact) group by 1, 2, 3),
tails as (select i - k as n2, k as n1, s - cast(floor(k * (k + 1) / 2) as bigint) as u, sum(ways) over (partition by i, k order by s desc) / sum(ways) over (partition by i, k) as tail from ways)
select {lead}z.n1, z.n2, round(z.u, 3) as u, round(tie_term, 3) as tie_term, round(z, 9) as z,
       round(case when z is not null then least(1.0, case when exact then 2 * tail else greatest(0.0, 1 - 2 * z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001),
             lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-0.5 * pow(z * i / 2000, 2))))) end) end, 7) as p
from z left join tails on exact and tails.n1 = z.n1 and tails.n2 = z.n2 and tails.u = greatest(z.u, d1 * d2 - z.u)"""


def _tested(tests, *keys):
    rounded = {"u": 3, "tie_term": 3, "z": 9, "p": 7}
    return stats.mann_whitney_p(tests).select(*keys, "n1", "n2", *[F.round(c, digits).alias(c) for c, digits in rounded.items()])


@query(_mwu_sql("select bit_score as v, sequence_identity < 5 as first from {hsps}"))
def mann_whitney_u(t):
    return _tested(stats.mann_whitney_u(t.hsps, "bit_score", F.col("sequence_identity") < 5))


@query(
    _mwu_sql(
        "select cast(dim - 1 as integer) as dim, features[dim] as v, label < 5 as first from (select label, features, unnest(range(1, 65)) as dim from {vectors})",
        "dim",
    )
)
def mwu_by_dim(t):
    long = stats.long_vectors(t.vectors, "label")
    return _tested(stats.mann_whitney_u(long, "value", F.col("label") < 5, "dim"), "dim").orderBy("p", "dim")


@query(_mwu_sql("select o_custkey, cast(o_totalprice as double) as v, o_orderstatus = 'F' as first from {orders}", "o_custkey"))
def mann_whitney_small(t):
    return _tested(stats.mann_whitney_u(t.orders, "o_totalprice", F.col("o_orderstatus") == "F", "o_custkey"), "o_custkey")


@query(
    """
with long as materialized (select id, cast(dim - 1 as integer) as dim, cast(features[dim] as double) as v from (select id, features, unnest(range(1, 65)) as dim from {vectors})),
s as (select dim, avg(v) as m, stddev_pop(v) as s from long group by dim)
select id, dim, round((v - m) / case when s > 0 then s else 1 end, 6) as value from long join s using (dim)"""
)
def standardize(t):
    long = stats.long_vectors(model.standardize(t.vectors), "id")
    return long.withColumn("value", F.round("value", 6))


@query(
    "select label, count(*) as n, round(sum(count(*)) over () / (count(*) * count(*) over ()), 9) as weight from {preds} group by label"
)
def class_weights(t):
    return _rounded(stats.class_weights(t.preds, "label"), "weight")


@query(
    "select cast(floor(max(ln(cast(1 - 0.99 as double)) / ln(1 - 1 / n))) * count(*) as bigint) as sample_size, count(*) as classes from (select count(*) as n from {preds} group by label)"
)
def balanced_sample_size(t):
    return stats.balanced_sample_size(t.preds, "label")


_FAMILIES = {"ECONOMY": "basic", "SMALL": "basic", "PROMO": "offer"}  # fixed values


@query(
    """
select case family when 'ECONOMY' then 'basic' when 'SMALL' then 'basic' when 'PROMO' then 'offer' else family end as family, cast(sum(n) as bigint) as n
from (select trim(regexp_replace(ko_definition, '\\[EC:.*\\]', '')) as family, count(*) as n from {annotations} group by 1) group by 1 order by n desc, family"""
)
def family_rollup(t):
    counts = stats.group_counts(t.annotations, "ko_definition", name="count")
    return stats.family_rollup(counts, "ko_definition", "count", _FAMILIES)


@query(
    """
select strand, count(*) as n, round(avg(case when partial = '00' then 1.0 else 0.0 end), 9) as complete, round(avg(case when (stop - start) // 3 < 16 then 1.0 else 0.0 end), 9) as short
from {genes} group by strand"""
)
def class_rates(t):
    rates = t.genes.groupBy("strand").agg(
        F.count(F.lit(1)).alias("n"),
        stats.share(F.col("partial") == "00").alias("complete"),
        stats.share(sequence.coding_length(F.col("start"), F.col("stop")) < 16).alias("short"),
    )
    return _rounded(rates, "complete", "short")


@query(
    """
with s as (select g.translation_table as organism, g.strand as label, right(case when strand < 0 then translate(reverse(substr(d.nt, start, stop - start + 1)), 'ACGT', 'TGCA')
             else substr(d.nt, start, stop - start + 1) end, 3) as codon from {contig_genes} g join {dna} d on g.contig_id = d.id),
c as (select organism, label, case when codon in ('TAA', 'TAG', 'TGA') then codon else 'none' end as codon, count(*) as n from s group by 1, 2, 3)
select organism, label, codon, n, round(adjusted, 12) as adjusted
from (select *, n / sum(n) over (partition by organism, codon) / sum(n) over (partition by organism, label) as adjusted from c) where codon <> 'none'"""
)
def codon_adj_freq(t):
    contigs = t.dna.select(F.col("id").alias("contig_id"), "nt")
    genes = orf.with_codons(orf.gene_nucleotides(t.contig_genes, contigs))
    named = genes.select(
        F.col("translation_table").alias("organism"), F.col("strand").alias("label"), F.col("stop_codon").alias("codon")
    )
    return _rounded(stats.adjusted_codon_frequency(named, "organism", "label", "codon"), "adjusted", digits=12)


_TIES = ["bit_score", "alignment_length", "subject_id", "l_partkey", "l_linenumber", "sequence_identity"]


@query(
    f"""
with best as (select * from {{hsps}} qualify row_number() over (partition by query_id order by e_value, {', '.join(_TIES)}) = 1)
select n_name as species, count(*) as n, count(*) filter (o_orderpriority = '1-URGENT') as n_positive
from best join {{orders}} on query_id = o_orderkey join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey where e_value <= 0.02 group by n_name"""
)
def species_summary(t):
    homes = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("query_id"),
            F.col("n_name").alias("species"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("prediction"),
        )
    )
    best = dedupe.best_hit(t.hsps, _TIES).select("query_id", "e_value")
    return stats.species_summary(best.join(homes, "query_id"), "species", "prediction", 0.02)


@query("select name as genome_id, count(*) as n_contigs, count(*) = 1 as complete from {seqs} group by name")
def genome_contig_stats(t):
    return stats.contig_stats(t.seqs.select(F.col("name").alias("genome_id"), "id"))
