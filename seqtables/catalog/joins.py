"""Queries over joins, similarity search, clustering and splits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqtables.catalog.registry import query
from seqtables.operators import assemble, clean, cluster, hsps, similarity, stats
from seqtables.operators.ordered import dense_ids

K, JACCARD = 8, 0.2


@query("select c.id, c.mmseqs_representative, s.source, length(s.seq) as length from {clusters} c join {seqs} s on c.id = s.id")
def join_inner_cluster(t):
    joined = t.clusters.join(t.seqs, "id")
    return joined.select("id", "mmseqs_representative", "source", F.length("seq").cast("long").alias("length"))


@query("select v.id, v.label, p.dataset, p.model_3c_a_prediction from {vectors} v join {preds} p on v.id = p.id")
def join_features_meta(t):
    return t.vectors.join(t.preds.drop("label"), "id").select("id", "label", "dataset", "model_3c_a_prediction")


@query(
    """
select l_orderkey as id, l_linenumber, l_extendedprice, o_custkey as genome_id, o_totalprice, o_orderpriority, c_name, c_acctbal, n_name
from {lineitem} left join {orders} on l_orderkey = o_orderkey left join {customer} on o_custkey = c_custkey left join {nation} on c_nationkey = n_nationkey"""
)
def results_star_join(t):
    predictions = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_extendedprice")
    genes = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("genome_id"), "o_totalprice")
    notes = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    copies = t.customer.select(F.col("c_custkey").alias("genome_id"), "c_name", "c_acctbal")
    homes = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    genomes = homes.select(F.col("c_custkey").alias("genome_id"), "n_name")
    return assemble.results_star(predictions, genes, notes, copies, genomes)


@query(
    """
with a as (select o_custkey as genome_id, count(*) as n_open from {orders} where o_orderstatus = 'O' group by 1),
b as (select o_custkey as genome_id, count(*) as n_urgent from {orders} where o_orderpriority = '1-URGENT' group by 1)
select coalesce(a.genome_id, b.genome_id) as genome_id, coalesce(n_open, 0) as n_open, coalesce(n_urgent, 0) as n_urgent, c_acctbal
from a full outer join b on a.genome_id = b.genome_id left join {customer} on coalesce(a.genome_id, b.genome_id) = c_custkey"""
)
def outer_zero_fill(t):
    orders = t.orders.withColumnRenamed("o_custkey", "genome_id")
    still_open = stats.group_counts(orders.where("o_orderstatus = 'O'"), "genome_id", name="n_open")
    urgent = stats.group_counts(orders.where("o_orderpriority = '1-URGENT'"), "genome_id", name="n_urgent")
    sizes = t.customer.select(F.col("c_custkey").alias("genome_id"), "c_acctbal")
    return assemble.outer_zero_fill(still_open, [urgent], "genome_id", sizes)


@query("select ko, count(*) as \"count\", arg_min(ko_definition, id) as ko_definition from {annotations} group by ko")
def join_right_counts(t):
    return assemble.counts_with_first(t.annotations, "ko", "ko_definition")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from {lineitem} where l_orderkey in (select o_orderkey from {orders} where o_totalprice > 200000)")
def lookup_semi(t):
    wanted = t.orders.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return clean.lookup(t.lineitem, wanted, "l_orderkey").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )


@query("select id, source, length(seq) as length from {seqs} where id in (select mmseqs_representative from {clusters})")
def cluster_reps_semi(t):
    reps = t.clusters.select(F.col("mmseqs_representative").alias("id"))
    kept = clean.lookup(t.seqs, reps, "id")
    return kept.select("id", "source", F.length("seq").cast("long").alias("length"))


@query("select c_custkey, c_name, n_name, n_regionkey from {customer} left join {nation} on c_nationkey = n_nationkey")
def broadcast_genome_attrs(t):
    nations = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    joined = assemble.with_attributes(t.customer, nations, "c_nationkey")
    return joined.select("c_custkey", "c_name", "n_name", "n_regionkey")


@query(
    "select id, dataset, label, model_3c_a_prediction as binary_model_prediction, model_3c_b_prediction as ternary_model_prediction from {preds}"
)
def model_outputs_join(t):
    preds = t.preds
    outputs = {
        "binary": preds.withColumnRenamed("model_3c_a_prediction", "prediction"),
        "ternary": preds.withColumnRenamed("model_3c_b_prediction", "prediction"),
    }
    return assemble.model_outputs(preds.select("id", "dataset", "label"), outputs)


@query(
    """
with top as (select max(e_value) as m from {hsps}),
grid as (select i as step, 0.0001 + i * ((m - 0.0001) / 19.0) as threshold from top, unnest(range(20)) as u(i)),
queries as (select o_orderkey as query_id, o_orderstatus as grp from {orders}),
counts as (select q.query_id, q.grp, g.step, g.threshold, count(h.e_value) filter (h.e_value < g.threshold) as n
           from queries q cross join grid g left join {hsps} h on h.query_id = q.query_id group by 1, 2, 3, 4)
select grp, cast(step as integer) as step, round(any_value(threshold), 9) as threshold, round(avg(n), 9) as mean, round(stddev_samp(n) / sqrt(count(*)), 9) as sem,
       round(avg(case when n = 0 then 1.0 else 0.0 end), 9) as fraction_none from counts group by grp, step"""
)
def threshold_sweep(t):
    queries = t.orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("grp"))
    swept = stats.threshold_sweep(queries, t.hsps, "grp")
    return swept.select(
        "grp", "step", *[F.round(c, 9).alias(c) for c in ("threshold", "mean", "sem", "fraction_none")]
    )


def _words(table: str, k: int) -> str:
    word = " || ".join(f"s[i + {j}]" for j in range(k))
    return f"""(select distinct id, unnest(list_transform(range(1, len(s) - {k - 2}), lambda i: {word})) as word
                from (select id, string_split(seq, '') as s from {table}))"""


@query(
    f"""
with q as materialized {_words('{items}', 5)}, s as materialized {_words('{seqs}', 5)},
nq as (select id, count(*) as n from q group by id), ns as (select id, count(*) as n from s group by id),
shared as (select q.id as query_id, s.id as subject_id, count(*) as shared from q join s on q.word = s.word group by 1, 2)
select query_id, subject_id, row_number() over (partition by query_id order by shared desc, subject_id) as rank, shared as shared_kmers,
       round(shared / (nq.n + ns.n - shared), 9) as jaccard, round(shared / nq.n, 9) as query_coverage_per_subject
from shared join nq on query_id = nq.id join ns on subject_id = ns.id where shared >= ceil(nq.n * 0.5)
qualify row_number() over (partition by query_id order by shared desc, subject_id) <= 10"""
)
def kmer_search(t):
    found = similarity.kmer_search(t.items, t.seqs, 5, 10, 0.5)
    return found.select(
        "query_id",
        "subject_id",
        "rank",
        "shared_kmers",
        F.round("jaccard", 9).alias("jaccard"),
        F.round("query_coverage_per_subject", 9).alias("query_coverage_per_subject"),
    )


_LETTERS = hsps.Scoring(same=5, unlike=-4, letters="ABCDEFGHIJKLMNOPQRSTUVWXYZ", groups=())


@query(
    f"""with q as (select id, seq, length(seq) as n from {{items}} where seq is not null), s as (select id, seq, length(seq) as n from {{seqs}} where seq is not null),
qw as materialized (select id, i, substr(seq, i::int, 12) as word from (select id, seq, unnest(range(1, n - 10)) as i from q)),
sw as materialized (select id, i, substr(seq, i::int, 12) as word from (select id, seq, unnest(range(1, n - 10)) as i from s)),
diagonals as (select qw.id as q, sw.id as s, sw.i - qw.i as d from qw join sw using (word) group by 1, 2, 3 having count(*) >= 2),
places as (select diagonals.q, diagonals.s, d, unnest(range(greatest(0, -d), least(q.n, s.n - d))) as p from diagonals join q on q.id = diagonals.q join s on s.id = diagonals.s),
scored as (select places.q, places.s, d, p, (substr(q.seq, (p + 1)::int, 1) = substr(s.seq, (p + d + 1)::int, 1))::int as same from places join q on q.id = places.q join s on s.id = places.s),
sums as (select *, sum(9 * same - 4) over w as c, sum(9 * same - 4) over w - (9 * same - 4) as before, sum(same) over w as equal from scored window w as (partition by q, s, d order by p)),
gains as (select *, min(before) over (partition by q, s, d order by p) as low, c - min(before) over (partition by q, s, d order by p) as gain from sums),
ends as (select * from gains qualify row_number() over (partition by q, s, d order by gain desc, p) = 1),
segments as (select e.q, e.s, e.d, e.gain as score, min(g.p) as a, e.p as b, any_value(e.equal) - min_by(g.equal - g.same, g.p) as same
             from ends e join gains g on g.q = e.q and g.s = e.s and g.d = e.d and g.p <= e.p and g.before = e.low where e.gain > 0 group by e.q, e.s, e.d, e.gain, e.p),
valued as (select x.*, q.n as nq, s.n as ns, {_LETTERS.kappa} * q.n * (select sum(n) from s) * exp(score * {-_LETTERS.scale!r}) as e_value,
             (score * {_LETTERS.scale!r} - ln({_LETTERS.kappa})) / ln(2) as bits from segments x join q on q.id = x.q join s on s.id = x.s),
best as (select * from valued where e_value <= 0.001 qualify row_number() over (partition by q, s order by score desc, a, a + d) <= 3),
kept as (select q, s from best group by q, s qualify row_number() over (partition by q order by max(score) desc, s) <= 10),
covered as (select q, s, count(distinct p) as covered from (select q, s, unnest(range(a, b + 1)) as p from best) group by q, s)
select q as query_id, s as subject_id, round(100.0 * same / (b - a + 1), 6) as sequence_identity, b - a + 1 as alignment_length, (b - a + 1 - same)::bigint as mismatch,
       0::bigint as num_gap_openings, a + 1 as query_alignment_start, b + 1 as query_alignment_end, a + d + 1 as subject_alignment_start, b + d + 1 as subject_alignment_end,
       round(e_value, 12) as e_value, round(bits, 6) as bit_score, round(100.0 * covered / nq, 6) as query_coverage_per_subject,
       round(100.0 * (b - a + 1) / nq, 6) as query_coverage_per_pair, nq as query_sequence_length, ns as subject_sequence_length
from best join kept using (q, s) join covered using (q, s)"""
)
def hsp_search(t):
    found = hsps.search(t.items, t.seqs, k=12, least_words=2, max_subjects=10, max_hsps=3, max_e_value=0.001, scoring=_LETTERS)
    rounded = {c: F.round(c, 6) for c in ("sequence_identity", "bit_score", "query_coverage_per_subject", "query_coverage_per_pair")}
    return found.withColumns(rounded).withColumn("e_value", F.round("e_value", 12))


def _pairs(k: int, least: float) -> str:
    """All pairs of distinct sequences with a Jaccard index over ``least``; ``tied`` has them by length and id."""
    return f"""single as materialized (select min(id) as id, seq, length(seq) as size from {{seqs}} group by seq),
words as materialized {_words('single', k)},
sizes as (select id, count(*) as n from words group by id),
common as (select a.id, b.id as center, count(*) as shared from words a join words b on a.word = b.word and a.id <> b.id group by 1, 2),
tied as (select c.id, c.center, shared, a.n as own, b.n as other, shared / (a.n + b.n - shared) as jaccard
         from common c join sizes a on a.id = c.id join sizes b on b.id = c.center join single x on x.id = c.id join single y on y.id = c.center
         where (x.size < y.size or (x.size = y.size and x.id > y.id)) and shared / (a.n + b.n - shared) >= {least}),
pairs as materialized (select id, center, shared, jaccard from tied)"""


@query(f"with {_pairs(K, JACCARD)} select id, center, shared, round(jaccard, 9) as jaccard from pairs")
def jaccard_pairs(t):
    pairs = similarity.similar_pairs(t.seqs.select("id", "seq"), K, JACCARD)
    return pairs.withColumn("jaccard", F.round("jaccard", 9))


@query(
    f"""with recursive {_pairs(K, JACCARD)},
both_ as materialized (select id as a, center as b from pairs union select center, id from pairs),
reach as (select distinct a as id, a as component from both_ union select both_.b, reach.component from reach join both_ on both_.a = reach.id)
select id, min(component) as component from reach group by id"""
)
def cluster_components(t):
    pairs = similarity.similar_pairs(t.seqs.select("id", "seq"), K, JACCARD)
    return cluster.connected_components(pairs, "id", "center")


def _cover(k: int, identity: float) -> str:
    """The greedy cover by pairs beyond chance: ``chosen`` has each sequence's representative.

    A sequence's fate follows from its earlier centres', so each step settles one more place in the
    order by length and id: ``reps`` grows by one row at a time.
    """
    least = similarity.jaccard_for_identity(identity, k)
    return f"""recursive {_pairs(k, least)},
rate as (select sum(df * df) / (sum(df) * sum(df)) as r from (select count(*)::double as df from words group by word)),
chance as (select *, least(own, other)::double as few, least(own, other) * (1 - exp(-greatest(own, other) * r)) as mean, exp(-greatest(own, other) * r) as outside from tied, rate),
beyond as (select id, center, own, other, case when few > mean + 6 * sqrt(mean * outside)
             then greatest(0, shared - (mean + 6 * sqrt(mean * outside))) * few / (few - (mean + 6 * sqrt(mean * outside))) else 0 end as shared from chance),
edges as materialized (select id, center, shared / (own + other - shared) as jaccard from beyond where shared / (own + other - shared) >= {least}),
linked as materialized (select id, row_number() over (order by size desc, id) as place from single where id in (select id from edges)),
walk as (select 0::bigint as place, (select coalesce(list(id), []) from single where id not in (select id from edges)) as reps
         union all
         select w.place + 1, case when exists (select 1 from edges e where e.id = l.id and list_contains(w.reps, e.center)) then w.reps else list_append(w.reps, l.id) end
         from walk w join linked l on l.place = w.place + 1),
reps as materialized (select unnest(reps) as id from (select reps from walk order by place desc limit 1)),
chosen as (select id, id as representative from reps union all
           select id, center from (select e.id, center, row_number() over (partition by e.id order by jaccard desc, center) as i from edges e
                                   where center in (select id from reps) and e.id not in (select id from reps)) where i = 1)"""


@query("select min(id) as id, length(seq) as length from {seqs} group by seq")
def dereplicate_exact(t):
    kept = cluster.dereplicate_exact(t.seqs.select("id", "seq"))
    return kept.select("id", F.length("seq").cast("long").alias("length"))


@query(f"with {_cover(5, 0.95)} select id, source, length(seq) as length from {{seqs}} where id in (select id from reps)")
def dereplicate_near(t):
    kept = cluster.dereplicate(t.seqs)
    return kept.select("id", "source", F.length("seq").cast("long").alias("length"))


_IDENTITY = math.pow(0.3, 1 / 8)


@query(
    f"""with {_cover(8, _IDENTITY)}
select s.id, representative as mmseqs_representative, dense_rank() over (order by representative) - 1 as mmseqs_cluster
from {{seqs}} s join single x on x.seq = s.seq join chosen c on c.id = x.id"""
)
def cluster_identity(t):
    # Letters of prose share short words by chance, so the words are longer than for residues.
    found = cluster.cluster(t.seqs, identity=_IDENTITY, k=8)
    return found.select("id", "mmseqs_representative", "mmseqs_cluster")


@query("select id, mmseqs_representative, dense_rank() over (order by mmseqs_representative) - 1 as mmseqs_cluster from {pairs}")
def cluster_ids(t):
    pairs = t.pairs
    return pairs.join(dense_ids(pairs, "mmseqs_representative", "mmseqs_cluster"), "mmseqs_representative", "left")


_SPLIT = """groups as (select mmseqs_representative as g, row_number() over (order by md5(concat(cast(mmseqs_representative as varchar), '_42')), mmseqs_representative) as place,
                 count(*) over () as total from (select distinct mmseqs_representative from {clusters})),
split as (select c.id, c.mmseqs_representative, case when place <= floor(0.8 * floor(0.8 * total)) then 'train' when place <= floor(0.8 * total) then 'val' else 'test' end as dataset
          from {clusters} c join groups on g = c.mmseqs_representative)"""


@query(f"with {_SPLIT} select * from split")
def group_split(t):
    return cluster.group_split(t.clusters, "mmseqs_representative")


@query(
    f"""with {_SPLIT}, keys as (select distinct dataset, d.lang || d.source as taxon from split s join {{documents}} d on s.id = d.doc_id),
outside as (select distinct lang || source as taxon from {{documents}} join {{labels}} using (doc_id) where toxic = 1)
select dataset, count(*) as n_keys, count(o.taxon) as n_shared from keys k left join outside o on k.taxon = o.taxon group by dataset"""
)
def leakage_report(t):
    taxon = F.concat("lang", "source").alias("taxon")
    documents = t.documents.select(F.col("doc_id").alias("id"), taxon)
    split = cluster.group_split(t.clusters, "mmseqs_representative").join(documents, "id")
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))
    return cluster.leakage(split, clean.lookup(documents, toxic, "id"), "taxon")
