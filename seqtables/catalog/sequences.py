"""Queries over sequence functions, truncation, reading frames and interval matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables.catalog.registry import query
from seqtables.functions import numeric, sequence
from seqtables.functions.sequence import RESIDUE_CLASSES, AMINO_ACIDS
from seqtables.operators import features, intervals, orf, truncate

MARKER = "Q"
_TAIL = f"(select *, case when contains(seq, '{MARKER}') then split_part(seq, '{MARKER}', -1) end as tail from {{seqs}})"


def _from(residue: str, least: int) -> str:
    rest = f"substr(tail, instr(tail, '{residue}'))"
    return f"case when instr(tail, '{residue}') > 0 and length({rest}) >= {least} then {rest} end"


_BEFORE = f"case when contains(seq, '{MARKER}') and length(split_part(seq, '{MARKER}', 1)) >= 10 then split_part(seq, '{MARKER}', 1) end"


@query(f"select id, {_BEFORE} as seq from {{seqs}}")
def truncate_c(t):
    return t.seqs.select("id", sequence.truncate_c(F.col("seq"), MARKER).alias("seq"))


@query(f"select id, coalesce({_from('M', 10)}, {_from('V', 10)}, {_from('L', 10)}) as seq from {_TAIL}")
def truncate_n_codon(t):
    return t.seqs.select("id", sequence.truncate_n(F.col("seq"), MARKER).alias("seq"))


_EARLIEST = "nullif(regexp_extract(tail, '[MVL].*$'), '')"


@query(f"select id, case when length({_EARLIEST}) >= 10 then {_EARLIEST} end as seq from {_TAIL}")
def truncate_n_length(t):
    return t.seqs.select("id", sequence.truncate_n(F.col("seq"), MARKER, bias="length").alias("seq"))


@query(
    f"""
select id || '-' as id, cut as seq, instr(seq, '{MARKER}') - 1 as sec_index_n, length(seq) - instr(reverse(seq), '{MARKER}') as sec_index_c,
       length(seq) - length(replace(seq, '{MARKER}', '')) as sec_count, length(seq) - length(cut) as trunc_size,
       (length(seq) - length(cut)) / length(seq) as trunc_ratio, length(seq) as original_length
from (select cast(id as varchar) as id, seq, {_BEFORE} as cut from {{seqs}}) where cut is not null"""
)
def truncate_frame(t):
    frame = truncate.truncate_frame(t.seqs, "c", MARKER)
    return frame.select(
        "id", "seq", "sec_index_n", "sec_index_c", "sec_count", "trunc_size", "trunc_ratio", "original_length"
    )


@query(
    f"""
select id, c_length, n_length, c_length < 30 and n_length < 30 as below_limit
from (select id, case when length(split_part(seq, '{MARKER}', 1)) >= 1 then length(split_part(seq, '{MARKER}', 1)) else 1 end as c_length,
             coalesce(length(coalesce({_from('M', 1)}, {_from('V', 1)})), 1) as n_length
      from {_TAIL} where tail is not null)"""
)
def detection_limit(t):
    return truncate.detection_limit(t.seqs, MARKER)


@query(
    f"""
select '-' || id as id, left(cut, 1) as start_residue,
       length(seq) - length(cut) - (length(seq) - instr(reverse(seq), '{MARKER}')) as gap
from (select cast(id as varchar) as id, seq, nullif(regexp_extract(tail, '[VM].*$'), '') as cut from {_TAIL}) where length(cut) >= 30"""
)
def marker_start_gap(t):
    return truncate.marker_start_gap(t.seqs, MARKER)


@query("select id, translate(reverse(nt), 'ACGT', 'TGCA') as nt from {dna}")
def reverse_complement(t):
    return t.dna.select("id", sequence.reverse_complement(F.col("nt")).alias("nt"))


_SLICED = """(select g.*, d.nt as contig, case when strand < 0 then translate(reverse(substr(d.nt, start, stop - start + 1)), 'ACGT', 'TGCA')
                  else substr(d.nt, start, stop - start + 1) end as nt
             from {contig_genes} g join {dna} d on g.contig_id = d.id)"""


def _contigs(t):
    return t.dna.select(F.col("id").alias("contig_id"), "nt")


@query(f"select id, nt, length(nt) % 3 = 0 as in_frame from {_SLICED}")
def gene_nt(t):
    return orf.gene_nucleotides(t.contig_genes, _contigs(t)).select("id", "nt", "in_frame")


@query(
    f"""
select id, case when left(nt, 3) in ('ATG', 'GTG', 'TTG') then left(nt, 3) else 'none' end as start_codon,
       case when right(nt, 3) in ('TAA', 'TAG', 'TGA') then right(nt, 3) else 'none' end as stop_codon from {_SLICED}"""
)
def start_stop_codons(t):
    return orf.with_codons(orf.gene_nucleotides(t.contig_genes, _contigs(t))).select("id", "start_codon", "stop_codon")


@query(
    "select locus_tag, feature, case when feature = 'CDS' then (stop - start) // 3 end as length from {ref_genes}"
)
def coding_length(t):
    length = sequence.coding_length(F.col("start"), F.col("stop"), F.col("feature"))
    return t.ref_genes.select("locus_tag", "feature", length.alias("length"))


def _translated(nt: str) -> str:
    code = " ".join(f"when {number} then '{sequence.genetic_code(number)}'" for number in (11, 4, 25))
    place = " + ".join(
        f"{weight} * (instr('TCAG', substr({nt}, 3 * i + {k}, 1)) - 1)" for k, weight in ((1, 16), (2, 4), (3, 1))
    )
    return (
        f"replace(array_to_string(list_transform(range(0, length({nt}) // 3 - 1), "
        f"lambda i: substr(case translation_table {code} end, cast({place} + 1 as bigint), 1)), ''), '*', 'U')"
    )


@query(f"select id, {_translated('nt')} as seq from {_SLICED}")
def translate_codons(t):
    genes = orf.gene_nucleotides(t.contig_genes, _contigs(t))
    return genes.select("id", sequence.translate_codons(F.col("nt"), F.col("translation_table")).alias("seq"))


@query(
    f"""
select id, strand, length(nt) as original_length, length(extra) as extension_size, length(extra) // 3 as extension_residues,
       case when strand < 0 then start - length(extra) else start end as extended_start,
       case when strand < 0 then stop else stop + length(extra) end as extended_stop,
       right(nt, 3) as original_stop_codon, right(nt || extra, 3) as stop_codon, left(nt, 3) as start_codon, {_translated('(nt || extra)')} as seq
from (select *, regexp_extract(case when strand < 0 then translate(reverse(substr(contig, 2, greatest(start - 2, 0))), 'ACGT', 'TGCA')
                               else substr(contig, stop + 1, greatest(length(contig) - 1 - stop, 0)) end,
                               '^(?:...)*?(?:TAA|TAG|TGA)') as extra from {_SLICED})"""
)
def extend_orf(t):
    extended = orf.extend_orfs(t.contig_genes, _contigs(t), F.col("translation_table"))
    return extended.drop("contig_id", "start", "stop", "translation_table")


@query(
    f"""
with chars as materialized (select id, length(seq) as size, string_split(translate(seq, 'UZO', 'XXX'), '') as s from {{seqs}} where length(seq) >= 2)
select id, kmer, count(*) / any_value(size) as value
from (select id, size, unnest(list_transform(range(1, size - 1), lambda i: s[i] || s[i + 1])) as kmer from chars)
where regexp_matches(kmer, '^[{AMINO_ACIDS}]+$') and substr(kmer, 1, 1) <> substr(kmer, 2, 1) group by id, kmer"""
)
def kmer_profile(t):
    return features.kmer_profile(t.seqs, 2)


@query("select id, cast(length(seq) as double) as length from {seqs}")
def length_feature(t):
    return features.length_features(t.seqs).select("id", F.get("features", F.lit(0)).alias("length"))


@query("select id, translate(replace(replace(seq, '*', ''), 'B', ''), 'UZO', 'XXX') as seq from {seqs}")
def normalize_residues(t):
    return t.seqs.select("id", sequence.normalize_residues(F.col("seq")).alias("seq"))


@query(
    f"""
select id, residue, (length(tail) - length(replace(tail, residue, ''))) / nullif(length(tail), 0) as fraction
from (select id, right(seq, 50) as tail from {{seqs}}), unnest(string_split('{AMINO_ACIDS}', '')) as u(residue)"""
)
def suffix_composition(t):
    shares = sequence.composition(F.col("seq"), suffix=50)
    names = F.array(*[F.lit(a) for a in AMINO_ACIDS])
    return t.seqs.select("id", F.inline(F.arrays_zip(names.alias("residue"), shares.alias("fraction")))).toDF(
        "id", "residue", "fraction"
    )


_CHEMISTRY = ", ".join(f"('{name}', '[{members}]')" for name, members in RESIDUE_CLASSES["chemistry"].items())


@query(
    f"""
select id, class, (length(tail) - length(regexp_replace(tail, members, '', 'g'))) / nullif(length(tail), 0) as fraction
from (select id, right(seq, 50) as tail from {{seqs}}), (values {_CHEMISTRY}) as c(class, members)"""
)
def class_composition(t):
    shares = sequence.class_composition(F.col("seq"), "chemistry", suffix=50)
    names = F.array(*[F.lit(name) for name in RESIDUE_CLASSES["chemistry"]])
    return t.seqs.select("id", F.inline(F.arrays_zip(names, shares))).toDF("id", "class", "fraction")


_PAIRS = """pairs_ as materialized (
  select g.id, r.locus_tag, r.feature, r.pseudo, r.start as ref_start, r.stop as ref_stop,
         least(g.stop, r.stop) - greatest(g.start, r.start) as overlap,
         g.strand = r.strand and (g.start = r.start or g.stop = r.stop) as valid
  from {genes} g join {ref_genes} r on g.contig_id = r.contig_id and not (r.start > g.stop) and not (r.stop < g.start)),
counts_ as materialized (select id, count(*) as n_hits, count(*) filter (valid) as n_valid_hits from pairs_ group by id),
best_ as materialized (select * from pairs_ where valid
          qualify row_number() over (partition by id order by overlap desc, locus_tag, feature, pseudo) = 1),
match_ as materialized (select g.id, coalesce(n_hits, 0) as n_hits, coalesce(n_valid_hits, 0) as n_valid_hits, b.feature, b.locus_tag, b.pseudo
           from {genes} g left join counts_ c on g.id = c.id left join best_ b on g.id = b.id)"""


@query(f"with {_PAIRS} select * from match_")
def interval_match(t):
    return intervals.interval_match(t.genes, t.ref_genes)


@query(
    f"""with {_PAIRS} select id, n_hits, case when feature in ('misc_feature', 'mobile_element', 'repeat_region') then 'misc' when feature like '%RNA' then 'rna'
       when feature = 'CDS' and not pseudo then 'cds' when pseudo then 'pseudo' when n_hits > 0 and n_valid_hits = 0 then 'error' else 'inter' end as label
       from match_"""
)
def label_genes(t):
    labelled = intervals.label_genes(intervals.interval_match(t.genes, t.ref_genes))
    return labelled.select("id", "n_hits", "label")


_SINGLE = """single_ as materialized (select * from {ref_genes} qualify row_number() over (partition by locus_tag, feature order by contig_id, start, stop) = 1),
joined_ as materialized (select g.*, m.locus_tag, m.feature, s.contig_id as ref_contig_id, s.start as ref_start, s.stop as ref_stop, s.strand as ref_strand, s.pseudo as ref_pseudo
            from {genes} g left join match_ m on g.id = m.id left join single_ s on m.locus_tag = s.locus_tag and m.feature = s.feature)"""


def _matched(t):
    genes, refs = t.genes, t.ref_genes
    return intervals.match_with_ref(intervals.interval_match(genes, refs, genes.columns[1:], places=True), refs)


@query(
    f"with {_PAIRS}, {_SINGLE} select id, locus_tag, feature, ref_contig_id, ref_start, ref_stop, ref_strand, ref_pseudo from joined_"
)
def match_with_ref(t):
    return _matched(t).select(
        "id", "locus_tag", "feature", "ref_contig_id", "ref_start", "ref_stop", "ref_strand", "ref_pseudo"
    )


@query(
    f"""with {_PAIRS}, {_SINGLE},
ends_ as (select id, (stop = ref_stop and strand = 1) or (start = ref_start and strand = -1) as c_terminus_aligned,
                 (start = ref_start and strand = 1) or (stop = ref_stop and strand = -1) as n_terminus_aligned from joined_ where locus_tag is not null)
select *, case when n_terminus_aligned and c_terminus_aligned then 'both' when n_terminus_aligned then 'n_terminus' when c_terminus_aligned then 'c_terminus' end as alignment from ends_"""
)
def boundary_alignment(t):
    aligned = intervals.boundary_alignment(_matched(t).where("locus_tag is not null"))
    return aligned.select("id", "c_terminus_aligned", "n_terminus_aligned", "alignment")


@query(
    f"""with {_PAIRS}, {_SINGLE},
diff_ as (select id, cast((stop - start) // 3 - (ref_stop - ref_start) // 3 as double) as d from joined_ where locus_tag is not null)
select id, round(sign(m) * log2(abs(m)), 6) as log2_length_diff from (select id, case when d = 0 then 1.0 else d + sign(d) end as m from diff_)"""
)
def signed_log2_diff(t):
    found = _matched(t).where("locus_tag is not null")
    own = sequence.coding_length(F.col("start"), F.col("stop"))
    ref = sequence.coding_length(F.col("ref_start"), F.col("ref_stop"))
    return found.select("id", F.round(numeric.signed_log2_diff(own, ref), 6).alias("log2_length_diff"))


@query(
    """
select id, cast(list_position(x, list_max(x)) - 1 as integer) as prediction,
       round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) as probability
from (select id, cast(features as double[]) as x from {vectors})"""
)
def softmax_argmax(t):
    p = numeric.softmax(F.col("features"))
    return t.vectors.select(
        "id",
        numeric.argmax(F.col("features")).alias("prediction"),
        F.round(F.array_max(p), 6).alias("probability"),
    )
