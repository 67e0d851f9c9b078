"""Views over the given tables that play the part of the sequence inputs.

One text serves both engines: braces name the tables a view reads. Views cover their
tables whole and keep texts whole.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_LINE_ID = (
    "concat_ws('_', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
    "cast(l_suppkey as string), cast(cast(l_quantity as bigint) as string))"
)
_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', ''{all}))"

_TEXTS: dict[str, str] = {
    # Letters of the documents as sequences.
    "seqs": f"""
select doc_id as id, {_LETTERS} as seq, source, lang as domain, concat('name', cast(doc_id - doc_id % 3 as string)) as name,
       case when doc_id % 10 = 0 then '1' end as non_terminal_residue
from {{documents}}""",
    "items": f"""
select item_id as id, {_LETTERS} as seq from {{benchmark}}""",
    # The same sequences over four letters; each is a contig.
    "dna": """
select id, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') as nt from {seqs}""",
    # Every line item as a predicted gene, and as an annotated feature placed further along.
    "genes": f"""
select {_LINE_ID} as id, concat('C', cast(l_suppkey as string)) as contig_id, l_partkey * 30 + 1 as start,
       l_partkey * 30 + 1 + cast(3 * l_quantity as bigint) as stop,
       case when l_linestatus = 'O' then 1 else -1 end as strand,
       case when l_returnflag = 'R' then '10' else '00' end as partial
from {{lineitem}}""",
    "ref_genes": f"""
select {_LINE_ID} as locus_tag, concat('C', cast(l_suppkey as string)) as contig_id, l_partkey * 30 + 211 as start,
       l_partkey * 30 + 211 + cast(3 * l_quantity as bigint) as stop,
       case when l_linestatus = 'O' then 1 else -1 end as strand,
       case when l_orderkey % 10 = 0 then 'tRNA' when l_orderkey % 10 = 1 then 'misc_feature' else 'CDS' end as feature,
       (l_returnflag = 'R' and l_orderkey % 10 > 1) as pseudo
from {{lineitem}}""",
    # Genes inside the contigs of ``dna``: every line item, dealt over all contigs by place of their ids.
    "contig_genes": f"""
select {_LINE_ID} as id, d.id as contig_id, 1 + (l_partkey * 7) % (d.size - 3 * n_codons + 1) as start,
       1 + (l_partkey * 7) % (d.size - 3 * n_codons + 1) + 3 * n_codons - 1 as stop,
       case when l_linestatus = 'O' then 1 else -1 end as strand,
       case when l_returnflag = 'A' then 11 when l_returnflag = 'R' then 4 else 25 end as translation_table
from (select i.*, d.id, d.size, least(cast(l_quantity as bigint), cast(floor(d.size / 3) as bigint)) as n_codons
      from (select l.*, least_id + (l_orderkey + 13 * l_partkey + l_linenumber) % (most_id - least_id + 1) as place
            from {{lineitem}} l cross join (select min(id) as least_id, max(id) as most_id from {{dna}}) b) i
      join (select id, length(nt) as size from {{dna}}) d on i.place = d.id where d.size >= 3) d""",
    "headers": """
select id, concat('# ', cast(start as string), ' # ', cast(stop as string), ' # ', cast(strand as string), ' # ID=', id,
       ';partial=', partial, ';start_type=ATG;rbs_motif=None;rbs_spacer=None;gc_cont=0.', cast(10 + start % 90 as string)) as description
from {genes}""",
    "coords": """
select id, concat(case when strand = -1 then 'complement(' else '' end, case when partial = '10' then '<' else '' end,
       cast(start as string), '..', case when start % 4 = 0 then '>' else '' end, cast(stop as string),
       case when strand = -1 then ')' else '' end) as coordinate
from {genes}""",
    "annotations": f"""
select l_suppkey as genome_id, {_LINE_ID} as id, p_brand as ko, concat(p_type, ' [EC:', cast(p_size as string), '.1]') as ko_definition,
       l_extendedprice as score, case when l_returnflag = 'R' then '*' end as meets_threshold
from {{lineitem}} join {{part}} on l_partkey = p_partkey""",
    "kofam_lines": """
select concat(case when meets_threshold is not null then '* ' else '  ' end, id, ' ', ko, ' 100.5 - ', '1e-05 ', ko_definition) as value
from {annotations}""",
    "hsps": """
select l_orderkey as query_id, concat('sp|S', cast(l_suppkey as string), '|') as subject_id, l_linenumber, l_partkey,
       l_discount * 100 as sequence_identity, cast(l_quantity as bigint) as alignment_length, l_tax as e_value, l_extendedprice as bit_score
from {lineitem}""",
    "genomes": """
select concat(case when c_custkey % 2 = 0 then 'RS_GCF_' else 'GB_GCA_' end, lpad(cast(c_custkey as string), 9, '0'), '.1') as accession,
       concat('d__', r_name, ';p__', n_name, ';c__', c_mktsegment, ';o__O', cast(c_custkey % 50 as string), ';f__F', cast(c_custkey % 100 as string),
              ';g__G', cast(c_custkey % 200 as string), ';s__', c_name) as gtdb_taxonomy,
       c_acctbal as checkm_completeness, case when c_custkey % 3 = 0 then 't' else 'f' end as gtdb_representative
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "preds": """
select id, label, case when id % 3 = 0 then 'test' when id % 3 = 1 then 'val' else 'train' end as dataset,
       case when id % 5 = 0 then (label + 1) % 3 else label end as model_3c_a_prediction,
       case when id % 7 = 0 then (label + 2) % 3 else label end as model_3c_b_prediction
from (select doc_id as id, case when toxic = 1 then 2 else quality end as label from {labels}) b""",
    "scores": f"""
select {_LINE_ID} as id, l_suppkey as genome_id, l_discount * 10 as model_output from {{lineitem}}""",
    "clusters": """
select s.id, g.mmseqs_representative
from {seqs} s join (select source, length(seq) % 10 as tail, min(id) as mmseqs_representative from {seqs} group by 1, 2) g
  on s.source = g.source and length(s.seq) % 10 = g.tail""",
    "pairs": """
select mmseqs_representative, id from {clusters}""",
    "vectors": """
select vec_id as id, embedding as features, label from {embeddings}""",
    "token_vectors": """
select vec_id % 50 as id, cast(floor(vec_id / 50) as bigint) as pos, embedding as v from {embeddings}""",
    "labels_docs": """
select d.doc_id as id, d.lang, case when l.quality is null then null else concat('q', cast(l.quality as string)) end as quality
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
}


def _sources(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


FIXTURES: dict[str, tuple[str, list[str]]] = {}
for _name, _text in _TEXTS.items():
    _plain = _text.replace("{all}", "").strip()
    FIXTURES[_name] = (_plain, _sources(_plain))


def duckdb_sql(text: str) -> str:
    """SQL with every fixture it names written out as a common table expression."""
    needed: dict[str, str] = {}

    def visit(body: str) -> None:
        for name in _sources(body):
            if name in BASE_TABLES or name in needed:
                continue
            fixture = _TEXTS[name].replace("{all}", ", 'g'").strip()
            visit(fixture)
            needed[name] = fixture

    visit(text)
    plain = lambda body: re.sub(r"\{(\w+)\}", r"\1", body)
    body = plain(text).strip()
    if not needed:
        return body
    views = ",\n".join(f"{name} as materialized ({plain(fixture)})" for name, fixture in needed.items())
    recursive = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if recursive:
        return f"with {recursive.group(1) or ''}{views},\n{body[recursive.end():]}"
    return f"with {views}\n{body}"
