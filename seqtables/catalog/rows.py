"""Queries over filters, clean-up, picks per group, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables.catalog.registry import query
from seqtables.functions import numeric, parsing
from seqtables.operators import assemble, clean, dedupe, ordered, stats

MARKER = "Q"


def _letters(frame):
    """The sequence's length in place of the sequence."""
    return frame.withColumn("length", F.length("seq").cast("long")).drop("seq")


@query("select id, length(seq) as length from {seqs} where length(seq) >= 10 and length(seq) < 1000")
def length_filter(t):
    return _letters(clean.filter_length(t.seqs)).select("id", "length")


@query(
    """
select id, name, source, length(seq) as length from (select * from {seqs} qualify row_number() over (partition by name order by id) = 1)
where length(seq) >= 10 and length(seq) < 1000 and domain = 'en' and non_terminal_residue is null"""
)
def clean_corpus(t):
    return _letters(clean.clean_corpus(t.seqs, domain="en")).select("id", "name", "source", "length")


@query(
    f"select domain, count(*) as n, round(avg(case when contains(seq, '{MARKER}') then 1.0 else 0.0 end), 9) as fraction from {{seqs}} group by domain"
)
def marker_fraction(t):
    return clean.marker_fraction(t.seqs, "domain", MARKER).withColumn("fraction", F.round("fraction", 9))


_CLASSES = f"""(select id, length(seq) as length, cast(unnest(case when contains(seq, '{MARKER}') then [1, 3] when length(seq) < 200 then [2] else [0] end) as integer) as label from {{seqs}})"""


@query(f"select * from {_CLASSES}")
def assign_classes(t):
    return _letters(clean.assign_classes(t.seqs, 4, MARKER)).select("id", "length", "label")


@query("select id, contig_id, start, stop from {genes} where partial like '00%'")
def drop_partial(t):
    return clean.drop_partial(t.genes).select("id", "contig_id", "start", "stop")


@query("select id, length(seq) as length from {seqs} where domain <> 'de'")
def drop_null_seq(t):
    holes = t.seqs.withColumn("seq", F.when(F.col("domain") != "de", F.col("seq")))
    return _letters(clean.drop_null_seq(holes)).select("id", "length")


@query(f"select id, label as kind, {', '.join(f'features[{i + 1}] as f{i}' for i in range(64))} from {{vectors}}")
def wide_to_vector(t):
    # columns in falling order, so that only their names say where an element belongs
    wide = t.vectors.select("id", *[F.get("features", F.lit(i)).alias(str(i)) for i in reversed(range(64))], F.col("label").alias("kind"))
    return clean.wide_to_vector(wide).select("id", "kind", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(64)])


@query("select id, coalesce(lang, 'none') as lang, coalesce(quality, 'none') as quality from {labels_docs}")
def fill_none(t):
    return clean.fill_none(t.labels_docs)


@query(
    """
select id, dataset, case label when 2 then 0 else label end as label,
       case model_3c_a_prediction when 2 then 0 else model_3c_a_prediction end as model_3c_a_prediction,
       case model_3c_b_prediction when 2 then 0 else model_3c_b_prediction end as model_3c_b_prediction from {preds}"""
)
def label_remap(t):
    return clean.merge_classes(t.preds)


@query(
    """
select l.doc_id as id, quality as model_3c_a_prediction, cast(0.5 + quality as double) as model_3c_a_probability_1, label, dataset, model_3c_b_prediction
from {labels} l left join {preds} p on l.doc_id = p.id"""
)
def prediction_upsert(t):
    fresh = t.labels.select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("prediction"),
        (F.lit(0.5) + F.col("quality")).alias("probability_1"),
    )
    return clean.upsert_predictions(t.preds, fresh, "model_3c_a")


@query(
    "select id, split_part(id || '.1', '.', 1) as before_dot, regexp_replace(id, '_[^_]*$', '') as before_number from {headers}"
)
def contig_key(t):
    return t.headers.select(
        "id",
        parsing.contig_before_dot(F.concat("id", F.lit(".1"))).alias("before_dot"),
        parsing.contig_before_number(F.col("id")).alias("before_number"),
    )


@query(
    """
select c_custkey, lower(left(name, 1) || left(string_split(name, ' ')[-1], 3)) as code, left(name, 1) || '. ' || string_split(name, ' ')[-1] as short
from (select c_custkey, c_mktsegment || ' ' || replace(c_name, '#', ' ') as name from {customer})"""
)
def code_name(t):
    name = F.concat_ws(" ", "c_mktsegment", F.replace("c_name", F.lit("#"), F.lit(" ")))
    return t.customer.select("c_custkey", parsing.code_name(name).alias("code"), parsing.short_name(name).alias("short"))


_LEVELS = ", ".join(f"regexp_extract(gtdb_taxonomy, '{level[0]}__([^;]*)', 1) as \"{level}\"" for level in parsing.TAXONOMY_LEVELS)


@query(f"select accession, {_LEVELS} from {{genomes}}")
def taxonomy_parse(t):
    levels = [parsing.taxonomy_level(F.col("gtdb_taxonomy"), level).alias(level) for level in parsing.TAXONOMY_LEVELS]
    return t.genomes.select("accession", *levels)


@query("select id, genome_id, model_output, 1 as prediction from {scores} where model_output > 0.5")
def threshold_positive(t):
    return clean.positives(t.scores, "model_output")


@query(
    """
select query_id, count(*) as n from {hsps} where query_id not in (select query_id from {hsps} where e_value < 0.05 group by query_id having count(*) > 4) group by query_id"""
)
def outlier_anti(t):
    hits = t.hsps
    outliers = stats.group_counts(hits.where("e_value < 0.05"), "query_id").where("n > 4")
    return stats.group_counts(clean.without(hits, outliers, "query_id"), "query_id")


@query(
    """select id, source, domain, name, non_terminal_residue, length(seq) as length from {seqs} where length(seq) >= 10 and length(seq) < 500
       order by md5(id || '_42'), id limit 200"""
)
def sample_n(t):
    return clean.sample_rows(_letters(clean.filter_length(t.seqs, 10, 500)), 200)


@query("select id, features[1] as f0, features[6] as f1, features[64] as f2 from {vectors}")
def vector_subset(t):
    picked = numeric.subset(F.col("features"), F.array(F.lit(0), F.lit(5), F.lit(63)))
    chosen = t.vectors.select("id", picked.alias("picked"))
    return chosen.select("id", *[F.get("picked", F.lit(i)).alias(f"f{i}") for i in range(3)])


@query("select id, label from (select *, row_number() over (order by id) - 1 as place from {vectors}) where place >= 100 and place < 250")
def row_slice(t):
    return ordered.row_slice(t.vectors.select("id", "label"), ["id"], 100, 250)


@query(
    """
select o.o_orderkey as query_id, coalesce(h.e_value, cast('infinity' as double)) as e_value, h.subject_id, h.sequence_identity, h.l_linenumber
from {orders} o left join {hsps} h on o.o_orderkey = h.query_id where h.query_id is null or sequence_identity > 9.9"""
)
def missing_score_fill(t):
    asked = t.orders.select(F.col("o_orderkey").alias("query_id"))
    joined = asked.join(t.hsps.select("query_id", "e_value", "subject_id", "sequence_identity", "l_linenumber"), "query_id", "left")
    filled = clean.fill_infinity(joined, "e_value")
    return filled.where("subject_id is null or sequence_identity > 9.9").orderBy(F.desc("sequence_identity"), "query_id")


@query("select id, name, length(seq) as length from {seqs} qualify row_number() over (partition by name order by id) = 1")
def dedupe_first(t):
    return _letters(clean.dedupe_first(t.seqs, ["name"])).select("id", "name", "length")


@query(
    "select id, mmseqs_representative from {clusters} qualify row_number() over (partition by mmseqs_representative order by (id = mmseqs_representative) desc, id) = 1"
)
def cluster_reps(t):
    return dedupe.cluster_reps(t.clusters)


@query(
    """
select accession, phylum, checkm_completeness from (select accession, regexp_extract(gtdb_taxonomy, 'p__([^;]*)', 1) as phylum, checkm_completeness from {genomes})
qualify row_number() over (partition by phylum order by checkm_completeness desc, accession) = 1"""
)
def top_genome_per_taxon(t):
    taxa = t.genomes.withColumn("phylum", parsing.taxonomy_level(F.col("gtdb_taxonomy"), "phylum"))
    best = dedupe.top_per_taxon(taxa, "phylum", key="accession")
    return best.select("accession", "phylum", "checkm_completeness")


_TIES = ["bit_score", "alignment_length", "subject_id", "l_partkey", "l_linenumber", "sequence_identity"]


@query(f"select * from {{hsps}} qualify row_number() over (partition by query_id order by e_value, {', '.join(_TIES)}) = 1")
def best_hit(t):
    return dedupe.best_hit(t.hsps, _TIES)


@query(
    "select * from {hsps} qualify row_number() over (partition by query_id, subject_id order by alignment_length desc, bit_score, e_value, l_partkey, l_linenumber, sequence_identity) = 1"
)
def best_hsp(t):
    return dedupe.best_hsp(t.hsps, ties=["bit_score", "e_value", "l_partkey", "l_linenumber", "sequence_identity"])


@query(
    """
with ranked as (select contig_id, id, strand, start, row_number() over (partition by contig_id order by start, id) as rn from {genes}),
lead as (select contig_id, strand as first_strand from ranked where rn = 1),
along as (select g.contig_id, g.id, row_number() over (partition by g.contig_id order by case when first_strand = 1 then start else -start end, g.id) as rn
          from {genes} g join lead l on g.contig_id = l.contig_id)
select contig_id, max(id) filter (rn = 1) as c_terminus, max(id) filter (rn = 2) as n_terminus from along group by contig_id"""
)
def strand_ordered_pair(t):
    return dedupe.strand_ordered_pair(t.genes, "contig_id", "id")


@query("select ko, count(*) as n from {annotations} group by ko order by n desc, ko limit 10")
def topk_values(t):
    return stats.top_values(t.annotations, "ko")


@query(
    """
select dataset, round(avg(r), 9) as balanced_accuracy from (select dataset, label, avg(case when label = model_3c_a_prediction then 1.0 else 0.0 end) as r from {preds} group by 1, 2)
group by dataset order by 2 desc, 1"""
)
def sorted_metrics(t):
    scores = stats.balanced_accuracy(t.preds, "label", "model_3c_a_prediction", ["dataset"])
    rounded = scores.withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))
    return rounded.orderBy(F.desc("balanced_accuracy"), "dataset")


@query(
    """
select id, length, cast(floor((upto - length) / 5000) as bigint) as batch
from (select id, length(seq) as length, cast(sum(length(seq)) over (order by length(seq) desc, id rows unbounded preceding) as bigint) as upto from {seqs})"""
)
def residue_batches(t):
    return ordered.residue_batches(_letters(t.seqs).select("id", "length"), 5000)


@query(
    """
select id, lang, 'scored' as dataset, quality from {labels_docs} where quality is not null
union all select doc_id, lang, 'plain', null from {documents}"""
)
def union_splits(t):
    scored = t.labels_docs.where("quality is not null")
    plain = t.documents.select(F.col("doc_id").alias("id"), "lang")
    return assemble.union_tables({"scored": scored, "plain": plain}).select("id", "lang", "dataset", "quality")


@query("select doc_id as id from {labels} intersect select vec_id from {embeddings}")
def shared_ids(t):
    return assemble.shared_ids(t.labels.select(F.col("doc_id").alias("id")), t.vectors, "id")


@query(
    """
select doc_id as id, 'labels' as source from {labels} where doc_id not in (select vec_id from {embeddings})
union all select vec_id, 'vectors' from {embeddings} where vec_id not in (select doc_id from {labels})"""
)
def source_only_ids(t):
    labels = t.labels.select(F.col("doc_id").alias("id"))
    return assemble.source_only(labels, t.vectors.select("id"), "id", ("labels", "vectors"))
