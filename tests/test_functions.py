import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqtables.functions import numeric, parsing, rows, sequence

L = F.lit


def test_truncate_c(one):
    assert one(sequence.truncate_c(L("ABCUDEU"), "U", 3)) == "ABC"
    assert one(sequence.truncate_c(L("ABUDEU"), "U", 3)) is None
    assert one(sequence.truncate_c(L("UABC"), "U", 1)) is None
    assert one(sequence.truncate_c(L("ABC"), "U", 1)) is None


def test_truncate_n_prefers_frequent_starts(one):
    # M comes later than V but is tried first; too short an M part falls back to V.
    assert one(sequence.truncate_n(L("AUAVAAMAAA"), "U", 3)) == "MAAA"
    assert one(sequence.truncate_n(L("AUAVAAMAAA"), "U", 5)) == "VAAMAAA"
    assert one(sequence.truncate_n(L("AUAVAAMAAA"), "U", 3, bias="length")) == "VAAMAAA"
    assert one(sequence.truncate_n(L("MMMMU"), "U", 1)) is None
    assert one(sequence.truncate_n(L("AUALAA"), "U", 1, starts=("M", "V"))) is None


def test_marker_places(one):
    assert one(sequence.first_index(L("AUBU"), "U")) == 1
    assert one(sequence.last_index(L("AUBU"), "U")) == 3
    assert one(sequence.last_index(L("AB"), "U")) is None
    assert one(sequence.count_of(L("AUBU"), "U")) == 2
    assert one(sequence.has_marker(L(None).cast("string"), "U")) is False


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ACGTRYKMBVDHN", max_size=40))
def test_reverse_complement_is_an_involution(one, nt):
    assert one(sequence.reverse_complement(sequence.reverse_complement(L(nt)))) == nt


def test_nucleotide_slice(one):
    assert one(sequence.nucleotide_slice(L("AACCGGTT"), L(2), L(4), L(1))) == "ACC"
    assert one(sequence.nucleotide_slice(L("AACCGGTT"), L(2), L(4), L(-1))) == "GGT"


def test_translation(one):
    assert one(sequence.translate_codons(L("ATGTGAGGGTAA"))) == "MUG"
    assert one(sequence.translate_codons(L("ATGTGAGGGTAA"), 4)) == "MWG"
    assert one(sequence.translate_codons(L("ATGTGAGGGTAA"), L(25))) == "MGG"
    assert one(sequence.translate_codons(L("ATGNNATAA"))) == "MX"
    assert one(sequence.translate_codons(L("AT"))) == ""
    assert one(sequence.translate_codons(L("ATGGCNAAATAA"))) == "MAK"
    assert one(sequence.translate_codons(L("ATGRAYSARATHTARMGRTAA"))) == "MBZIUR"
    assert one(sequence.translate_codons(L("AAAAGATAA"), L(9))) == "NS"
    assert one(sequence.translate_codons(L("AGGTAATAA"), 33)) == "KY"
    assert one(sequence.translate_codons(L("ATGTAA"), L(None).cast("int"))) is None
    with pytest.raises(ValueError):
        sequence.translate_codons(L("ATGTAA"), 99)
    with pytest.raises(Exception, match="unknown translation table 99"):
        one(sequence.translate_codons(L("ATGTAA"), L(99)))


def test_translation_of_batches():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGTUNRYac-é" if i % 4 == 0 else "ACGT", k=rng.randrange(40))) for i in range(200)] + [None]
    tables = [rng.choice((1, 4, 11, 25, 33, None)) for _ in texts]
    wide, letters = {t: sequence.ambiguous_code(t) for t in (1, 4, 11, 25, 33)}, "".join(sequence.AMBIGUOUS_BASES)

    def plain(text, table):
        at = [[letters.find(c) for c in text[i : i + 3]] for i in range(0, len(text) - 2, 3)][:-1]
        return "".join(wide[table][256 * a + 16 * b + c] if min(a, b, c) >= 0 else "X" for a, b, c in at)

    want = [None if x is None or t is None else plain(x, t) for x, t in zip(texts, tables)]
    for size in (1, 5, 1 << 20):
        got = sequence.translated(pa.array(["ATG", *texts]).slice(1), pa.array([1, *tables], pa.int32()).slice(1), size)
        assert got.to_pylist() == want
    assert sequence.translated(pa.array([], pa.string()), pa.array([], pa.int32())).to_pylist() == []


def test_codons_and_length(one):
    assert one(sequence.start_codon(L("ATGAAATAA"))) == "ATG"
    assert one(sequence.start_codon(L("CTGAAATAA"))) == "none"
    assert one(sequence.stop_codon(L("ATGAAATAA"))) == "TAA"
    assert one(sequence.coding_length(L(1), L(90), L("CDS"))) == 29
    assert one(sequence.coding_length(L(1), L(90), L("tRNA"))) is None


def test_composition(one):
    assert one(sequence.composition(L("AAAC"), "AC", 2)) == [0.5, 0.5]
    # Each residue is mapped once: the class key A is not mapped again as a residue.
    assert one(sequence.class_composition(L("FIIV"), "codon")) == [0.25, 0.0, 0.5, 0.25]


def test_kmers(one):
    assert one(sequence.kmers(L("ABCD"), 2)) == ["AB", "BC", "CD"]
    assert one(sequence.kmers(L("ABCD"), 2, stop_early=True)) == ["AB", "BC"]
    assert one(sequence.kmers(L("A"), 2)) == []
    assert one(sequence.normalize_residues(L("AUZOB*"))) == "AXXX"
    assert one(sequence.normalize_residues(L("AUB"), spaced=True)) == "A X"


def test_parse_prodigal(one):
    text = "# 3 # 98 # -1 # ID=1_1;partial=10;start_type=ATG;rbs_motif=None;rbs_spacer=None;gc_cont=0.427"
    found = one(parsing.parse_prodigal(L(text)))
    assert (found.start, found.stop, found.strand, found.ID, found.partial) == (3, 98, -1, "1_1", "10")
    assert found.gc_content == 0.427
    assert one(parsing.parse_prodigal(L("no header"))).start is None


def test_parse_coordinate(one):
    assert one(parsing.parse_coordinate(L("complement(<1..>90)"))).asDict() == {
        "strand": -1, "start": 1, "stop": 90, "partial": "11",
    }
    assert one(parsing.parse_coordinate(L("5..9"))).partial == "00"


def test_names(one):
    assert one(parsing.code_name(L("Escherichia coli"))) == "ecol"
    assert one(parsing.short_name(L("Escherichia coli"))) == "E. coli"
    assert one(parsing.subject_name(L("sp|Q9X|"))) == "Q9X"
    assert one(parsing.subject_name(L("Q9X"))) == "Q9X"
    assert one(parsing.genome_id_of(L("/x/RS_GCF_000001405.1_protein.faa"))) == "GCF_000001405.1"
    assert one(parsing.contig_before_number(L("NZ_A.1_12"))) == "NZ_A.1"
    assert one(parsing.none_to_number(L("none"), "int")) == -1
    assert one(parsing.numeric_or_text(L("1.5"))).as_double == 1.5
    assert one(parsing.parse_note(L(None).cast("string"))).frameshifted is None


def test_numeric(one):
    p = one(numeric.softmax(F.array(L(1000.0), L(1000.0))))
    assert p == [0.5, 0.5]
    assert one(numeric.argmax(F.array(L(1.0), L(3.0), L(3.0)))) == 1
    assert abs(one(numeric.cross_entropy(F.array(L(0.0), L(0.0)), L(1))) - 0.6931471805599453) < 1e-12
    assert one(numeric.signed_log2_diff(L(5), L(5))) == 0.0
    assert one(numeric.signed_log2_diff(L(2), L(5))) == -2.0
    assert one(numeric.subset(F.array(L(1), L(2), L(3)), F.array(L(2), L(0)))) == [3, 1]
    assert one(rows.let(L(2), lambda x: x * x)) == 4
