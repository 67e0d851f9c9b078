"""Queries over file formats: tables are written out in the format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtables.catalog.registry import query
from seqtables.functions import parsing, sequence
from seqtables.operators import assemble, clean
from seqtables.session import scratch_path
from seqtables.sources import genbank, genomes, proteins, store, text

_DESCRIBED = "concat_ws(';', 'source=' || source, 'domain=' || domain, 'name=' || name, 'non_terminal_residue=' || non_terminal_residue)"


@query(f"select cast(id as varchar) as id, replace({_DESCRIBED}, cast(id as varchar), '') as description, seq from {{seqs}}")
def fasta_roundtrip(t):
    path = scratch_path(t.spark, "fasta")
    text.write_fasta(t.seqs, path)
    return text.read_fasta(t.spark, path).select("id", "description", "seq")


@query(
    f"select id, '>' || cast(id as varchar) || ' ' || {_DESCRIBED} || chr(10) || regexp_replace(regexp_replace(seq, '({"." * 60})', '\\1' || chr(10), 'g'), '\\n$', '') as value from {{seqs}}"
)
def fasta_records(t):
    return text.fasta_records(t.seqs)


@query(
    """
select start, stop, strand, id as "ID", partial, 'ATG' as start_type, 'None' as rbs_motif, 'None' as rbs_spacer,
       cast('0.' || cast(10 + start % 90 as varchar) as double) as gc_content from {genes}"""
)
def parse_prodigal_header(t):
    return t.headers.select(F.inline(F.array(parsing.parse_prodigal(F.col("description")))))


@query("select id, partial, 'ATG' as start_type, '0.' || cast(10 + start % 90 as varchar) as gc_cont from {genes}")
def parse_kv_header(t):
    fields = parsing.parse_kv(F.substring_index("description", "# ", -1))
    parsed = t.headers.select("id", fields.alias("h"))
    return parsed.select("id", *[F.col("h")[key].alias(key) for key in ("partial", "start_type", "gc_cont")])


@query(
    """
select true as meets_threshold, id, ko, cast(100.5 as double) as threshold, cast(null as double) as score, cast(0.00001 as double) as e_value, ko_definition
from {annotations} where meets_threshold is not null"""
)
def annotation_scan(t):
    return text.parse_scan_lines(t.kofam_lines)


@query("select genome_id, id, ko, score, meets_threshold is not null as meets_threshold from {annotations} where ko in ('Brand#1', 'Brand#2', 'Brand#3')")
def annotation_ko_filter(t):
    kept = text.select_annotations(t.annotations, ["Brand#1", "Brand#2", "Brand#3"])
    return kept.select("genome_id", "id", "ko", "score", "meets_threshold")


@query("select query_id, regexp_replace(replace(subject_id, '|', ''), '^sp', '') as subject_id, l_linenumber, l_partkey, bit_score from {hsps}")
def blast_tag_strip(t):
    stripped = t.hsps.withColumn("subject_id", parsing.subject_name(F.col("subject_id")))
    return stripped.select("query_id", "subject_id", "l_linenumber", "l_partkey", "bit_score")


@query("select id, upper(nt) as nt from {dna}")
def clean_nt(t):
    numbered = F.concat(F.lit("        1 "), F.lower("nt"), F.lit("\n       61 \n"))
    return t.dna.select("id", sequence.clean_nucleotides(numbered).alias("nt"))


@query(
    """
select id, strand, start, stop, (case when partial = '10' then '1' else '0' end) || (case when start % 4 = 0 then '1' else '0' end) as partial from {genes}"""
)
def parse_coordinate(t):
    return t.coords.select("id", F.inline(F.array(parsing.parse_coordinate(F.col("coordinate")))))


_NOTES = """(select doc_id as id, case doc_id % 4 when 0 then text when 1 then 'frameshifted; ' || text when 2 then text || ' internal stop' else null end as note from {documents})"""


@query(
    f"select id, contains(note, 'frameshifted') as frameshifted, contains(note, 'internal stop') as internal_stop, contains(note, 'incomplete') as incomplete from {_NOTES}"
)
def note_flags(t):
    kind = F.col("doc_id") % 4
    note = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("frameshifted; "), "text"))
        .when(kind == 2, F.concat("text", F.lit(" internal stop")))
    )
    return t.documents.select(F.col("doc_id").alias("id"), F.inline(F.array(parsing.parse_note(note))))


_LEVELS = ", ".join(f"regexp_extract(gtdb_taxonomy, '{level[0]}__([^;]*)', 1) as \"{level}\"" for level in parsing.TAXONOMY_LEVELS)


@query(
    f"select accession[4:] as genome_id, left(accession, 2) as prefix, checkm_completeness, gtdb_representative, {_LEVELS} from {{genomes}} where gtdb_representative = 't'"
)
def genome_metadata(t):
    path = scratch_path(t.spark, "genomes")
    t.genomes.write.csv(path, sep="\t", header=True)
    loaded = genomes.read_genomes(t.spark, path)
    return loaded.select("genome_id", "prefix", "checkm_completeness", "gtdb_representative", *parsing.TAXONOMY_LEVELS)


@query(
    """
select event_id, try_cast(regexp_extract(props, '[0-9]+') as bigint) as k, try_cast(event_type as double) as bad, cast(value as double) as value from {events}"""
)
def try_numeric(t):
    raw = t.events.select(
        "event_id",
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
        F.col("event_type").alias("bad"),
        F.col("value").cast("string").alias("value"),
    )
    return clean.cast_declared(raw, {"k": "long", "bad": "double", "value": "double", "absent": "long"})


@query("select id, round(list_sum(cast(features as double[])), 5) as total, label from {vectors}")
def feature_store_roundtrip(t):
    path = scratch_path(t.spark, "features")
    vectors = t.vectors
    store.write_metadata(vectors.select("id", "label", F.lit("x").alias("seq")), path)
    store.write_features(vectors.select("id", "features"), path, "plm_esm_gap")
    loaded = store.read_features(t.spark, path, "plm_esm_gap")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return loaded.select("id", F.round(total, 5).alias("total"), "label")


@query(
    """
select s.id as "ID", s.source as genome_id, length(s.seq) as length, v.label, g.n as n_proteins
from {seqs} s join {vectors} v on s.id = v.id left join (select source, count(*) as n from {seqs} group by source) g on s.source = g.source where length(s.seq) < 2000"""
)
def embedding_consolidate(t):
    seqs = t.seqs
    owned = seqs.select(F.col("id").alias("ID"), F.col("source").alias("genome_id"))
    owned_vectors = owned.join(t.vectors.withColumnRenamed("id", "ID"), "ID")
    sizes = owned.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_proteins"))
    table = assemble.consolidate_embeddings(seqs.select(F.col("id").alias("ID"), F.col("source").alias("genome_id"), "seq"), owned_vectors, sizes)
    return table.select("ID", "genome_id", F.length("seq").cast("long").alias("length"), "label", "n_proteins")


@query("select accession, accession[4:] as genome_id from {genomes}")
def genome_id_extract(t):
    name = F.concat(F.lit("/data/"), "accession", F.lit("_protein.faa"))
    return t.genomes.select("accession", parsing.genome_id_of(name).alias("genome_id"))


@query(
    """
select accession || cast(id as varchar) as id, 'NAME_' || cast(id as varchar) as name, 'Bacteria' as domain, source as phylum, cast(id % 50 as varchar) as ncbi_taxonomy_id,
       'WP_' || cast(id as varchar) as refseq_protein_id, case when id % 3 > 0 then 'NZ_' || cast(id as varchar) end as refseq_nucleotide_id,
       case when id % 10 = 0 then '1,7' end as non_terminal_residue, case when id % 4 > 0 then 'eco:' || cast(id as varchar) end as kegg,
       case when id % 5 > 0 then 'Does ' || domain end as function, 'predicted' as existence, nullif(seq, '') as seq
from {seqs}, (values ('P'), ('Q')) as a(accession)"""
)
def xml_entries(t):
    path = scratch_path(t.spark, "entries")
    number, kind = F.col("id").cast("string"), F.col("id")
    tagged = lambda prefix: F.concat(F.lit(prefix), number)
    reference = lambda name, value, prop=None: F.struct(
        F.lit(name).alias("_type"),
        value.alias("_id"),
        (prop if prop is not None else F.lit(None).cast("array<struct<_type:string,_value:string>>")).alias("property"),
    )
    nucleotide = F.when(
        kind % 3 > 0, F.array(F.struct(F.lit("nucleotide sequence ID").alias("_type"), tagged("NZ_").alias("_value")))
    )
    position = lambda at: F.struct(
        F.lit("non-terminal residue").alias("_type"), F.struct(F.struct(F.lit(at).alias("_position")).alias("position")).alias("location")
    )
    refs = F.array_compact(
        F.array(F.when(kind % 4 > 0, reference("KEGG", tagged("eco:"))), reference("RefSeq", tagged("WP_"), nucleotide))
    )
    entries = t.seqs.select(
        F.array(tagged("P"), tagged("Q")).alias("accession"),
        tagged("NAME_").alias("name"),
        F.struct(
            F.array(F.struct(F.lit("Some organism").alias("_VALUE"), F.lit("scientific").alias("_type"))).alias("name"),
            F.array(F.struct(F.lit("NCBI Taxonomy").alias("_type"), (kind % 50).cast("string").alias("_id"))).alias("dbReference"),
            F.struct(F.array(F.lit("Bacteria"), F.lit("Kingdom"), F.col("source")).alias("taxon")).alias("lineage"),
        ).alias("organism"),
        refs.alias("dbReference"),
        F.when(
            kind % 5 > 0, F.array(F.struct(F.lit("function").alias("_type"), F.concat(F.lit("Does "), "domain").alias("text")))
        ).alias("comment"),
        F.struct(F.lit("predicted").alias("_type")).alias("proteinExistence"),
        F.when(kind % 10 == 0, F.array(position("1"), position("7"))).alias("feature"),
        F.array(F.struct(F.col("seq").alias("_VALUE"), F.length("seq").cast("string").alias("_length"))).alias("sequence"),
    )
    entries.write.format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)
    return proteins.read_protein_xml(t.spark, path).select(
        "id", "name", "domain", "phylum", "ncbi_taxonomy_id", "refseq_protein_id", "refseq_nucleotide_id",
        "non_terminal_residue", "kegg", "function", "existence", "seq",
    )


@query(
    """
select 'T' || cast(id as varchar) || '_' || feature as locus_tag, feature, 'CONTIG' || cast(id as varchar) as contig_id, case feature when 'CDS' then 1 else -1 end as strand,
       case feature when 'CDS' then 1 + id % 7 else 31 end as start, case feature when 'CDS' then 90 + id % 5 else 60 end as stop, case feature when 'CDS' then '10' else '00' end as partial,
       case feature when 'CDS' then 'some, other' end as product, case feature when 'CDS' then id % 2 = 0 end as frameshifted, case feature when 'CDS' then false end as incomplete,
       case feature when 'CDS' then id % 2 = 1 end as internal_stop, case feature when 'CDS' then nullif(seq, '') end as seq, feature = 'tRNA' as pseudo, length(seq) as n_nt
from {seqs}, (values ('CDS'), ('tRNA')) as f(feature)"""
)
def gbff_features(t):
    path = scratch_path(t.spark, "flat")
    tag, pad = F.col("id").cast("string"), " " * 21
    whole = F.translate("seq", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "acgtacgtacgtacgtacgtacgtac")
    lines = F.concat(
        F.lit("LOCUS       CONTIG"), tag, F.lit("  bp DNA\nFEATURES             Location/Qualifiers\n     source          1..100\n"),
        F.lit("     gene            <1..90\n" + pad + '/locus_tag="G'), tag, F.lit('"\n     CDS             <'),
        (1 + F.col("id") % 7).cast("string"), F.lit(".."), (90 + F.col("id") % 5).cast("string"), F.lit("\n" + pad + '/locus_tag="T'), tag,
        F.lit('_CDS"\n' + pad + '/product="some"\n' + pad + '/product="other"\n' + pad + '/note="'),
        F.when(F.col("id") % 2 == 0, "frameshifted").otherwise("internal stop"),
        F.lit('"\n' + pad + '/translation="'), F.regexp_replace("seq", "(.{58})", "$1\n" + pad),
        F.lit('"\n     tRNA            complement(31..60)\n' + pad + '/locus_tag="T'), tag, F.lit('_tRNA"\n' + pad + "/pseudo\n"),
        F.lit("     repeat_region   5..9\n" + pad + '/note="no tag"\nORIGIN\n        1 '), whole,
    )
    t.seqs.select(lines.alias("value")).write.option("lineSep", genbank.RECORD_END).text(path)
    contigs = genbank.read_contigs(t.spark, path).select("contig_id", F.length("nt").cast("long").alias("n_nt"))
    features = genbank.read_features(t.spark, path).drop("genome_id", "protein_id")
    return features.join(contigs, "contig_id")
