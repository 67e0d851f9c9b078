from seqtables.functions.parsing import parse_kv, parse_prodigal
from seqtables.operators.features import featurizer, hash_encoder, register_encoder
from seqtables.session import cut, shared_dir
from seqtables.sources import genbank, genomes, proteins, store, text


def test_fasta(spark, tmp_path):
    file = tmp_path / "RS_GCF_000001405.1_protein.faa"
    head = "# 3 # 98 # 1 # ID=1_1;partial=00;start_type=ATG;rbs_motif=None;rbs_spacer=None;gc_cont=0.4"
    file.write_text(f">a_1 {head}\nMKV\nLL*\n>b_2 {head}\nM*M*\n")
    rows = text.read_fasta(spark, str(file), parse_prodigal).orderBy("id").collect()
    assert [(r.id, r.seq, r.start, r.partial) for r in rows] == [("a_1", "MKVLL", 3, "00"), ("b_2", "MM", 3, "00")]
    assert rows[0].genome_id == "GCF_000001405.1"
    plain = text.read_fasta(spark, str(file)).where("id = 'a_1'").first()
    assert plain.description == head


def test_fasta_key_values(spark, tmp_path):
    (tmp_path / "x.faa").write_text(">a k=v;n=2\nMM\n>b k=w;n=3\nMA\n")
    rows = text.read_fasta(spark, str(tmp_path / "x.faa"), parse_kv).orderBy("id").collect()
    assert [r.fields["k"] for r in rows] == ["v", "w"]


def test_fasta_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "M" * 61, "x=1 ", None, 3)], "id string, seq string, note string, gap string, n int")
    text.write_fasta(df, str(tmp_path / "out"))
    back = text.read_fasta(spark, str(tmp_path / "out")).first()
    assert back.seq == "M" * 61 and back.description == "note=x1"


def test_annotation_scan(spark, tmp_path):
    (tmp_path / "k.txt").write_text("# head\n* g1 K00001 100.5 200.1 1e-05 alcohol  dehydrogenase [EC:1]\n  g2 K2 - 3 bad x y\n")
    hits = text.read_annotation_scan(spark, str(tmp_path / "k.txt")).collect()
    assert len(hits) == 1 and hits[0].ko_definition == "alcohol dehydrogenase [EC:1]" and hits[0].e_value == 1e-05
    every = text.read_annotation_scan(spark, str(tmp_path / "k.txt"), meets_threshold=False).orderBy("id").collect()
    assert every[1].threshold is None and every[1].e_value is None and every[1].ko_definition == "x y"


def test_annotation_tab(spark, tmp_path):
    (tmp_path / "GCA_000001405.1.ko.tab").write_text("#c\n*\tg1\tK1\t1\t2\t0.1\tx\n\tg2\tK1\t1\t2\t0.1\tx\n\tg3\tK9\t1\t2\t0.1\tx\n")
    rows = text.read_annotation_tab(spark, str(tmp_path), ["K1"]).orderBy("id").collect()
    assert [(r.id, r.meets_threshold, r.genome_id) for r in rows] == [("g1", True, "GCA_000001405.1"), ("g2", False, "GCA_000001405.1")]


def test_clusters_and_hits(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("b\tb\nb\tc\na\ta\n")
    rows = text.read_clusters(spark, str(tmp_path / "c.tsv")).orderBy("id").collect()
    assert [(r.id, r.mmseqs_cluster) for r in rows] == [("a", 0), ("b", 1), ("c", 1)]
    assert text.read_clusters(spark, str(tmp_path / "c.tsv"), reps_only=True).count() == 2
    (tmp_path / "h.tsv").write_text("q\tsp|S1|\t99.5\t10\t0\t0\t1\t10\t1\t10\t1e-5\t50\t100\t100\t10\t10\n")
    hit = text.read_hits(spark, str(tmp_path / "h.tsv")).first()
    assert (hit.id, hit.subject_id, hit.alignment_length) == ("q", "S1", 10)


ENTRY = """<?xml version="1.0"?><uniprot xmlns="http://uniprot.org/uniprot"><entry>
<accession>P1</accession><accession>P2</accession><name>ABC_ECOLI</name>
<organism><name type="scientific">Escherichia coli</name><dbReference type="NCBI Taxonomy" id="562"/>
<lineage><taxon>Bacteria</taxon><taxon>Kingdom</taxon><taxon>Phylum</taxon></lineage></organism>
<comment type="function"><text evidence="1">Binds things.</text></comment>
<dbReference type="RefSeq" id="WP_1"><property type="nucleotide sequence ID" value="NZ_1"/></dbReference>
<dbReference type="KEGG" id="eco:b1"/><dbReference type="KEGG" id="eco:b2"/>
<proteinExistence type="predicted"/>
<feature type="non-terminal residue"><location><position position="1"/></location></feature>
<feature type="chain"><location><begin position="1"/><end position="5"/></location></feature>
<feature type="non-terminal residue"><location><position position="5"/></location></feature>
<sequence length="5">MK
UVV</sequence></entry></uniprot>"""


def test_protein_xml(spark, tmp_path):
    (tmp_path / "e.xml").write_text(ENTRY)
    rows = proteins.read_protein_xml(spark, str(tmp_path / "e.xml")).orderBy("id").collect()
    assert [r.id for r in rows] == ["P1", "P2"]
    first = rows[0]
    assert (first.seq, first.non_terminal_residue, first.kegg, first.function) == ("MKUVV", "1,5", "eco:b1", "Binds things.")
    assert (first.domain, first.phylum, first.order, first.species) == ("Bacteria", "Phylum", None, "ABC_ECOLI")
    assert (first.organism_name, first.refseq_nucleotide_id, first.ncbi_taxonomy_id) == ("Escherichia coli", "NZ_1", "562")
    assert first.file_name == "e.xml" and first.existence == "predicted"


FLAT = """LOCUS       C1 120 bp
FEATURES             Location/Qualifiers
     source          1..120
                     /organism="x"
     gene            1..90
                     /locus_tag="T1"
     CDS             complement(<1..>90)
                     /locus_tag="T1"
                     /product="some
                     thing"
                     /GO_function="a"
                     /note="internal stop; incomplete"
                     /translation="MKV
                     LL"
     misc_feature    5..9
                     /note="no tag"
ORIGIN
        1 acgtnacgta
       11 ttt
//
LOCUS       C2 10 bp
FEATURES             Location/Qualifiers
     tRNA            3..9
                     /locus_tag="T2"
                     /pseudo
ORIGIN
        1 gg
//
"""


def test_flat_file(spark, tmp_path):
    (tmp_path / "x.gbff").write_text(FLAT)
    rows = genbank.read_features(spark, str(tmp_path / "x.gbff")).orderBy("locus_tag").collect()
    assert [(r.locus_tag, r.feature, r.contig_id, r.strand, r.start, r.stop, r.partial) for r in rows] == [
        ("T1", "CDS", "C1", -1, 1, 90, "11"),
        ("T2", "tRNA", "C2", 1, 3, 9, "00"),
    ]
    assert (rows[0].seq, rows[0].internal_stop, rows[0].frameshifted, rows[0].pseudo) == ("MKVLL", True, False, False)
    assert rows[1].pseudo and rows[1].internal_stop is None
    contigs = {r.contig_id: r.nt for r in genbank.read_contigs(spark, str(tmp_path / "x.gbff")).collect()}
    assert contigs == {"C1": "ACGTNACGTATTT", "C2": "GG"}


def test_genomes(spark, tmp_path):
    (tmp_path / "g.tsv").write_text(
        "accession\tgtdb_representative\tgtdb_taxonomy\tcheckm_completeness\tgenome_size\tncbi_taxid\tunknown\n"
        "RS_GCF_1.1\tt\td__B;p__P;c__C;o__O;f__F;g__G;s__S t\t98.5\tnone\t7\tx\n"
        "GB_GCA_2.1\tf\td__B;p__P;c__C;o__O;f__F;g__G;s__S\t1\t2\t7\tx\n"
    )
    rows = genomes.read_genomes(spark, str(tmp_path / "g.tsv")).collect()
    assert len(rows) == 1 and "unknown" not in rows[0].asDict()
    assert (rows[0].genome_id, rows[0].prefix, rows[0].genome_size, rows[0].ncbi_taxonomy_id) == ("GCF_1.1", "RS", None, 7)
    assert (rows[0].species, rows[0].gtdb_representative) == ("S t", "t")


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("b", "MKV", None), ("a", "MK", "x"), ("c", None, "y")], "id string, seq string, note string")
    store.write_metadata(df, path)
    assert store.write_features(featurizer("len")(df.where("seq is not null")), path, "len")
    assert not store.write_features(featurizer("len")(df.limit(0)), path, "len")
    rows = store.read_features(spark, path, "len").orderBy("id").collect()
    assert [(r.id, r.features, r.note) for r in rows] == [("a", [2.0], "x"), ("b", [3.0], "none")]


def test_stage_and_splits(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", "train"), ("b", "test")], "id string, dataset string")

    for _ in range(2):
        staged = store.stage(spark, str(tmp_path / "s"), build)
    assert len(calls) == 1
    store.write_splits(staged, str(tmp_path / "out"))
    assert (tmp_path / "out" / "dataset=train").exists()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_registry(spark):
    import pytest

    with pytest.raises(ValueError, match="unknown"):
        featurizer("nope")
    with pytest.raises(ValueError, match="register_encoder"):
        featurizer("plm_esm_cls")
    register_encoder("plm_esm_gap", hash_encoder(4))
    df = spark.createDataFrame([("a", "MKVLLA")], "id string, seq string")
    assert len(featurizer("plm_esm_gap")(df).first().features) == 4
    assert len(featurizer("aa_1mer")(df).first().features) == 20


def test_checkpoint_folder_is_read_from_the_session(spark):
    cut(spark.range(3))
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)
