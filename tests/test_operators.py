import collections
import itertools
import math
import operator
import random
import re

import pytest
from pyspark.sql import functions as F

from seqtables.functions.sequence import kmers
from seqtables.operators import assemble, clean, cluster, dedupe, features, intervals, model, ordered, orf, similarity, stats, truncate
from seqtables.plans import corpus, genes as gene_plan, scoring

GENE = "id string, contig_id string, start long, stop long, strand int"
REF = "locus_tag string, contig_id string, start long, stop long, strand int, feature string, pseudo boolean"


def brute_match(gene, refs):
    _, contig, start, stop, strand = gene
    hits = [r for r in refs if r[1] == contig and not (r[2] > stop) and not (r[3] < start)]
    valid = [r for r in hits if r[4] == strand and (r[2] == start or r[3] == stop)]
    best = min(valid, key=lambda r: (-(min(r[3], stop) - max(r[2], start)), r[0], r[5], r[6]), default=None)
    return (len(hits), len(valid), best and best[5], best and best[0], best and best[6])


def test_interval_match_equals_brute_force(spark):
    rng = random.Random(1)
    span = lambda: (lambda a: (a, a + rng.choice([0, 3, 6, 9, 30])))(rng.randrange(1, 60))
    genes = [(f"g{i}", rng.choice("AB"), *span(), rng.choice([1, -1])) for i in range(150)]
    refs = [
        (f"r{i}", rng.choice("AAAB"), *span(), rng.choice([1, -1]), rng.choice(["CDS", "tRNA", "misc_feature"]), rng.random() < 0.3)
        for i in range(150)
    ]
    got = intervals.interval_match(spark.createDataFrame(genes, GENE), spark.createDataFrame(refs, REF))
    found = {r.id: tuple(r)[1:] for r in got.collect()}
    assert found == {g[0]: brute_match(g, refs) for g in genes}


def exchanges(df):
    """Names of the columns that each shuffle of the plan deals its rows by."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_interval_match_shuffles_genes_and_features_once(spark):
    genes = spark.createDataFrame([("g", "A", 1, 9, 1)], GENE)
    refs = spark.createDataFrame([("r", "A", 1, 9, 1, "CDS", False)], REF)
    assert len(exchanges(intervals.label_genes(intervals.interval_match(genes, refs)))) == 1


def test_interval_match_with_missing_places(spark):
    genes = [("a", None, 1, 9, 1), ("b", "A", None, 9, 1), ("c", "A", 1, None, 1), ("d", "A", 1, 9, None), ("e", "A", 1, 9, 1), ("e", "A", 1, 9, 1)]
    refs = [("r", "A", 1, 9, 1, "CDS", False), ("s", "A", 1, 12, None, "CDS", False), ("t", None, 1, 9, 1, "CDS", False), ("u", "A", None, 9, 1, "CDS", False)]
    found = intervals.interval_match(spark.createDataFrame(genes, GENE), spark.createDataFrame(refs, REF), ["strand"])
    got = collections.Counter((r.id, r.strand, r.n_hits, r.n_valid_hits, r.locus_tag) for r in found.collect())
    none = {("a", 1, 0, 0, None): 1, ("b", 1, 0, 0, None): 1, ("c", 1, 0, 0, None): 1}
    assert got == none | {("d", None, 2, 0, None): 1, ("e", 1, 2, 1, "r"): 2}


def test_genes_without_match_are_spread(spark):
    genes = spark.range(2000).selectExpr("concat('g', id) as id", "'A' as contig_id", "id * 100 + 50 as start", "id * 100 + 59 as stop", "1 as strand")
    refs = spark.createDataFrame([("r", "A", 1, 9, 1, "CDS", False), ("s", "A", 50, 70, 1, "CDS", False)], REF)
    matches = intervals.interval_match(genes, refs, genes.columns[1:])
    joined = intervals.match_with_ref(matches, refs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert any(keys.startswith("__tag") for keys in exchanges(joined))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = joined.collect()
    assert len(rows) == 2000
    assert [(r.id, r.start, r.ref_stop) for r in rows if r.locus_tag] == [("g0", 50, 70)]


def test_matches_with_places_join_only_repeated_keys(spark):
    # before, all features were shuffled by their names, and all matches
    rng = random.Random(9)
    place = lambda: (lambda a: (rng.choice("AB"), a, a + rng.choice((6, 9, 12)), rng.choice((1, 1, -1, None))))(rng.randrange(1, 40))
    genes = [(f"g{i}", *place()) for i in range(300)] + [("h", None, 1, 7, 1), ("i", "A", None, 7, 1)]
    refs = [(rng.choice((f"r{i}", f"r{i}", "same", None)), *place(), rng.choice(("CDS", "tRNA", None)), rng.choice((True, False, None))) for i in range(200)]
    refs += [("same", None, 3, 9, 1, "CDS", True), ("r1", "A", None, 9, 1, "CDS", True)]
    own, known = spark.createDataFrame(genes, GENE), spark.createDataFrame(refs, REF)
    for keep in (own.columns[1:], ["contig_id", "strand"]):
        plain = intervals.match_with_ref(intervals.interval_match(own, known, keep), known)
        placed = intervals.match_with_ref(intervals.interval_match(own, known, keep, places=True), known)
        assert sorted(plain.columns) == sorted(placed.columns)
        assert [keys.split("#")[0] for keys in exchanges(placed)] == ["contig_id"]
        got, want = (collections.Counter(map(tuple, df.select(*plain.columns).collect())) for df in (placed, plain))
        assert got == want and any(r.ref_start for r in placed.collect())


def test_touching_intervals_and_copies(spark):
    # One base in common is a hit; many copies of one interval count in full.
    genes = spark.createDataFrame([("a", "A", 10, 20, 1)] + [(f"c{i}", "A", 50, 60, 1) for i in range(40)], GENE)
    refs = [("x", "A", 20, 30, 1, "CDS", False), ("y", "A", 21, 30, 1, "CDS", False)]
    refs += [(f"z{i:02}", "A", 50, 65, 1, "CDS", False) for i in range(40)]
    got = {r.id: r for r in intervals.interval_match(genes, spark.createDataFrame(refs, REF)).collect()}
    assert (got["a"].n_hits, got["a"].n_valid_hits) == (1, 0)
    assert (got["c7"].n_hits, got["c7"].n_valid_hits, got["c7"].locus_tag) == (40, 40, "z00")


def test_labels(spark):
    rows = [
        ("a", 0, 0, None, None, "inter"), ("b", 2, 0, None, None, "error"), ("c", 1, 1, "CDS", True, "pseudo"),
        ("d", 1, 1, "CDS", False, "cds"), ("e", 1, 1, "tRNA", False, "rna"), ("f", 1, 1, "misc_feature", True, "misc"),
        ("g", 1, 1, "CDS", None, "cds"),
    ]
    df = spark.createDataFrame(rows, "id string, n_hits long, n_valid_hits long, feature string, pseudo boolean, want string")
    assert all(r.label == r.want for r in intervals.label_genes(df).collect())


def brute_extension(nt, start, stop, strand):
    comp = nt[::-1].translate(str.maketrans("ACGT", "TGCA")) if strand < 0 else nt
    at = stop if strand > 0 else len(nt) - start + 1
    size = 0
    while at + 3 < len(comp):
        size += 3
        if comp[at : at + 3] in ("TAA", "TAG", "TGA"):
            return size
        at += 3
    return 0


def test_extension_equals_brute_force(spark):
    rng = random.Random(2)
    contigs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(60, 200))) for i in range(20)}
    contigs["flush"] = "ATGCCC" + "TAA"
    genes = [("flush", "flush", 1, 6, 1)]
    for i in range(120):
        name = rng.choice(sorted(contigs))
        size = len(contigs[name])
        start = rng.randrange(1, size - 6)
        stop = start + 3 * rng.randrange(1, (size - start) // 3 + 1) - 1
        genes.append((f"g{i}", name, start, stop, rng.choice([1, -1])))
    made = spark.createDataFrame(genes, GENE)
    sequences = spark.createDataFrame(list(contigs.items()), "contig_id string, nt string")
    for width in (3, 12, 8190):
        found = {r.id: r.extension_size for r in orf.extend_orfs(made, sequences, width=width).collect()}
        assert found == {g[0]: brute_extension(contigs[g[1]], *g[2:]) for g in genes}
    assert found["flush"] == 0 and max(found.values()) > 12
    cut = {r.id: r.nt for r in orf.gene_nucleotides(made, sequences, width=6).collect()}
    pairs = str.maketrans("ACGT", "TGCA")
    for name, contig, start, stop, strand in genes:
        nt = contigs[contig][start - 1 : stop]
        assert cut[name] == (nt if strand > 0 else nt[::-1].translate(pairs))


def test_genes_off_their_contig(spark):
    genes = [("a", "c", -4, 3, 1), ("b", "c", 5, 99, -1), ("c", "c", 50, 60, 1), ("d", "c", 50, 60, -1), ("e", "c", None, 4, 1), ("f", "no", 1, 3, 1), ("g", "null", 1, 3, 1), ("a", "c", -4, 3, 1)]
    contigs = spark.createDataFrame([("c", "ACGTTAAC"), ("null", None), ("empty", "")], "contig_id string, nt string")
    made = spark.createDataFrame(genes, GENE).withColumn("text", F.lit("x"))
    cut = [(r.id, r.nt, r.text) for r in orf.gene_nucleotides(made, contigs).collect()]
    assert sorted(cut) == sorted([("a", "ACG", "x"), ("a", "ACG", "x"), ("b", "GTTA", "x"), ("c", "", "x"), ("d", "", "x"), ("e", None, "x"), ("g", None, "x")])
    grown = {r.id: (r.extension_size, r.stop_codon) for r in orf.extend_orfs(made, contigs).collect()}
    assert grown["a"] == (0, "ACG") and grown["c"] == (0, "") and grown["d"] == (0, "") and set(grown) == set("abcdeg")
    none = contigs.limit(0)
    assert orf.gene_nucleotides(made, none).count() == 0 and orf.extend_orfs(made.limit(0), contigs).count() == 0


def test_genes_meet_their_contig_in_one_shuffle(spark):
    contigs = spark.createDataFrame([("c", "ACGTTAACGG" * 5)], "contig_id string, nt string")
    genes = spark.createDataFrame([(f"g{i}", "c", a, a + n, 1 if i % 2 else -1) for i, (a, n) in enumerate((a, n) for a in range(1, 51, 3) for n in (0, 2, 7, 40))], GENE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = orf.gene_nucleotides(genes, contigs, width=9)
        assert len(exchanges(found)) == 2  # the genes' and the contigs'
        for r in found.collect():
            forward = ("ACGTTAACGG" * 5)[r.start - 1 : r.stop]
            assert r.nt == (forward if r.strand > 0 else forward[::-1].translate(str.maketrans("ACGT", "TGCA")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_running_sums_and_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaab"), rng.randrange(100), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int, w int").repartition(5)
    for block in (None, F.floor(F.col("v") / 10)):
        got = ordered.running_sums(df, ["v", "id"], {"upto": "w"}, group=["g"], block=block).collect()
        for r in got:
            assert r.upto == sum(w for i, g, v, w in rows if g == r.g and (v, i) <= (r.v, r.id))
    sliced = ordered.row_slice(df, ["v", "id"], 10, 20).collect()
    assert sorted((r.v, r.id) for r in sliced) == sorted((v, i) for i, _, v, _ in rows)[10:20]
    ids = {r.g: r.n for r in ordered.dense_ids(df, "g", "n").collect()}
    assert ids == {"a": 0, "b": 1}


def test_mann_whitney_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(12) / 4, rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(rows, "v double, first boolean")
    got = stats.mann_whitney_p(stats.mann_whitney_u(df, "v", F.col("first")))
    row = got.first()
    a, b = [v for v, f in rows if f], [v for v, f in rows if not f]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (row.n1, row.n2, row.u) == (len(a), len(b), u) and 0 < row.p <= 1
    less = stats.mann_whitney_p(stats.mann_whitney_u(df, "v", F.col("first")), "less").first().p
    more = stats.mann_whitney_p(stats.mann_whitney_u(df, "v", F.col("first")), "greater").first().p
    assert less + more > 1 and min(less, more) * 2 == pytest.approx(row.p)
    other = stats.mann_whitney_u(df, "v", ~F.col("first")).first().u
    assert u + other == len(a) * len(b)


def test_small_samples_have_exact_p(spark):
    rng = random.Random(8)
    rows = [(g, v, i < n1) for g, (n1, n2) in enumerate(((1, 1), (1, 6), (3, 4), (5, 5), (8, 2), (4, 7), (0, 3))) for i, v in enumerate(rng.sample(range(100), n1 + n2))]
    rows += [(7, 1, True), (7, 1, False), (7, 2, True), (8, None, True), (8, 3, None)]
    tests = stats.mann_whitney_u(spark.createDataFrame(rows, "g int, v int, first boolean"), "v", F.col("first"), "g")
    found = {side: {r.g: r.p for r in stats.mann_whitney_p(tests, side).collect()} for side in ("two-sided", "less", "greater")}
    assert set(found["less"]) == set(range(8)) and found["less"][6] is None
    for g in range(6):
        values = sorted(v for h, v, _ in rows if h == g)
        own = [values.index(v) for h, v, first in rows if h == g and first]
        every = [sum(c) for c in itertools.combinations(range(len(values)), len(own))]
        more, less = (sum(f(x, sum(own)) for x in every) / len(every) for f in (operator.ge, operator.le))
        got = [found[side][g] for side in ("greater", "less", "two-sided")]
        assert got == pytest.approx([more, less, min(1.0, 2 * min(more, less))])
    # beyond the centre the differences cancel: compare with whole numbers
    for m, n in ((8, 60), (5, 200)):
        ways = [collections.Counter() for _ in range(m + 1)]
        ways[0][0] = 1
        for rank in range(m + n):
            for k in range(m, 0, -1):
                for total, w in ways[k - 1].items():
                    ways[k][total + rank] += w
        least = m * (m - 1) // 2
        for u in (1, m * n // 3, m * n // 2, m * n - 3):
            want = sum(w for total, w in ways[m].items() if total - least >= u) / math.comb(m + n, m)
            assert stats._exact_tail(m, n, u) == pytest.approx(want, rel=1e-10)
        total = math.comb(m + n, m)
        assert stats._exact_tail(m, n, 0) == 1 and stats._exact_tail(m, n, m * n) == pytest.approx(1 / total)
        assert stats._exact_tail(n, m, m * n / 2) + stats._exact_tail(m, n, m * n // 2 + 1) == pytest.approx(1)


def test_ecdf_is_strict_and_monotone(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.5, 0.5, 2.0)], "g string, v double")
    rows = stats.ecdf(df, "v", "g", 1.0, 3).orderBy("x").collect()
    assert [(r.x, r.fraction) for r in rows] == [(0.0, 0.0), (0.5, 0.25), (1.0, 0.75)]


def _words(text, k):
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def _family(rng, n=12, copies=6):
    rows, letters = [], "ACDEFGHIKLMNPQRSTVWY"
    for f in range(n):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(80, 140)))
        for c in range(copies):
            seq = list(base[: len(base) - c])
            if c:
                seq[rng.randrange(len(seq))] = rng.choice(letters)
            rows.append((f"{f:02}{c}", "".join(seq)))
        rows.append((f"{f:02}x", base))
    return rows


def test_kmer_search_equals_brute_force(spark):
    rng = random.Random(5)
    rows = _family(rng)
    queries = [(f"q{i}", seq[10:60]) for i, (_, seq) in enumerate(rows[::5])]
    schema = "id string, seq string"
    want = set()
    for q, text in queries:
        own = _words(text, 4)
        scored = sorted((-len(own & _words(s, 4)), i) for i, s in rows if 2 * len(own & _words(s, 4)) >= len(own))
        want |= {(q, i, -n) for n, i in scored[:5]}
    for share in (0.25, 0.75, 1.0):
        got = similarity.kmer_search(spark.createDataFrame(queries, schema), spark.createDataFrame(rows, schema), 4, 5, 0.5, share)
        assert {(r.query_id, r.subject_id, r.shared_kmers) for r in got.collect()} == want


def test_few_queries_are_counted_without_a_shuffle_of_words(spark):
    rng = random.Random(8)
    rows = [*_family(rng), ("x", "AéBCDEFGH" * 3), ("y", "AB"), ("z", "")]
    queries = [(f"q{i}", seq[10:60]) for i, (_, seq) in enumerate(rows[:-3:7])] + [("e", "AéBCDEFGHAé"), ("s", "AB"), ("n", None)]
    schema = "id string, seq string"
    asked, there = spark.createDataFrame(queries, schema), spark.createDataFrame([*rows, ("m", None)], schema)
    columns = ["query_id", "subject_id", "rank", "shared_kmers", "jaccard", "query_coverage_per_subject", "query_sequence_length", "subject_sequence_length"]
    for k in (4, 9):
        sent, joined = (similarity.kmer_search(asked, there, k, 5, 0.5, sent=n) for n in (10_000, 0))
        assert not any("word" in keys for keys in exchanges(sent))
        found = sorted(map(tuple, sent.select(columns).collect()))
        assert found and found == sorted(map(tuple, joined.select(columns).collect()))
        for share in (0.25, 1.0) if k == 4 else ():
            joined = similarity.kmer_search(asked, there, k, 5, 0.5, share, sent=0)
            assert found == sorted(map(tuple, joined.select(columns).collect()))


def test_clusters_cover_their_members(spark):
    rows = _family(random.Random(6))
    df = spark.createDataFrame(rows, "id string, seq string")
    found = {r.id: r for r in cluster.cluster(df, 0.6, k=4).collect()}
    assert set(found) == {i for i, _ in rows}
    seqs, limit = dict(rows), similarity.jaccard_for_identity(0.6, 4)
    reps = {r.mmseqs_representative for r in found.values()}
    assert all(found[r].mmseqs_representative == r or seqs[found[r].mmseqs_representative] == seqs[r] for r in reps)
    for i, row in found.items():
        rep = seqs[row.mmseqs_representative]
        a, b = _words(seqs[i], 4), _words(rep, 4)
        assert seqs[i] == rep or len(a & b) / len(a | b) >= limit
        assert len(rep) >= len(seqs[i])
    assert len({r.mmseqs_cluster for r in found.values()}) == len(reps) == 12
    kept = cluster.dereplicate(df, 0.6, k=4)
    assert {r.id for r in kept.collect()} == reps


def test_unrelated_proteins_stay_apart_and_families_together(spark):
    rng = random.Random(3)
    letters = "ARNDCQEGHILKMFPSTWYV"
    rows = [(f"r{i:03}", "".join(rng.choices(letters, k=rng.randint(60, 900)))) for i in range(400)]
    family = [(f"f{i}", "".join(c if rng.random() > 0.03 else rng.choice(letters) for c in rows[0][1])) for i in range(5)]
    df = spark.createDataFrame([*rows, *family, ("none", None)], "id string, seq string")
    found = {r.id: r for r in cluster.cluster(df).collect()}
    assert len(found) == 406
    assert found["none"].mmseqs_representative is None and found["none"].mmseqs_cluster is None
    assert len({found[i].mmseqs_representative for i, _ in rows}) == 400
    assert len({found[i].mmseqs_representative for i, _ in [rows[0], *family]}) == 1


def test_rows_without_a_group_are_one_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "id int, g string")
    rows = {r.id: r.dataset for r in cluster.group_split(df, "g").collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[2] == rows[3]


def test_density_far_from_zero_and_without_spread(spark):
    df = spark.createDataFrame([("a", 1e9 + i) for i in range(5)] + [("b", 7.0), ("c", 2.0), ("c", 2.0)], "g string, v double")
    rows = stats.kernel_density(df, "v", "g").collect()
    peak = max(r.density for r in rows if r.g == "a")
    h = (10 / 4) ** 0.5 * 5**-0.2
    want = sum(math.exp(-0.5 * ((1e9 + 4 * 25 / 49 - (1e9 + i)) / h) ** 2) for i in range(5)) / (5 * h * math.sqrt(2 * math.pi))
    assert abs(peak - want) < 1e-6
    assert {r.g for r in rows} == {"a", "b", "c"} and all(r.density is None for r in rows if r.g != "a")


def test_components_close_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30], "src int, dst int")
    found = {r.id: r.component for r in cluster.connected_components(edges).collect()}
    assert found == {i: 0 if i <= 30 else 31 for i in range(61)}


def test_group_split_has_no_leak_and_exact_quota(spark):
    df = spark.createDataFrame([(i, i % 50) for i in range(1000)], "id int, g int")
    rows = cluster.group_split(df, "g").collect()
    seen = {}
    for r in rows:
        assert seen.setdefault(r.g, r.dataset) == r.dataset
    sizes = [sum(v == name for v in seen.values()) for name in ("train", "val", "test")]
    assert sizes == [32, 8, 10] and len(rows) == 1000


def test_four_classes_double_marker_rows(spark):
    df = spark.createDataFrame([("a", "MU" * 20), ("b", "M" * 250), ("c", "M" * 20)], "id string, seq string")
    labels = sorted((r.id, r.label) for r in clean.assign_classes(df, 4).collect())
    assert labels == [("a", 1), ("a", 3), ("b", 0), ("c", 2)]
    assert sorted((r.id, r.label) for r in clean.assign_classes(df, 2).collect()) == [("a", 1), ("b", 0), ("c", 0)]
    cut = truncate.truncate_classes(clean.assign_classes(df, 4), min_length=1).collect()
    assert {r.id for r in cut} == {"a-", "b", "c"}


def test_kmer_features_modes(spark):
    df = spark.createDataFrame([("a", "AAR"), ("b", "U")], "id string, seq string")
    names = features.kmer_names(1)
    value = lambda compat: {r.id: r.features for r in features.kmer_features(df, 1, compat).collect()}
    assert value(True)["a"][names.index("R")] == 0 and value(False)["a"][names.index("R")] == pytest.approx(1 / 3)
    assert sum(value(False)["b"]) == 0
    assert "AA" not in features.kmer_names(2)
    assert df.select(F.size(kmers(F.col("seq"), 2))).first()[0] == 2


def test_encoder_failures_are_kept(spark):
    def broken(seqs):
        if any("X" in s for s in seqs):
            raise RuntimeError("no X")
        return features.hash_encoder(4)(seqs)

    df = spark.createDataFrame([("a", "MKVLLA"), ("b", "XXXXXXXXXX"), ("c", None)], "id string, seq string")
    rows = {r.id: r for r in features.encode(df, broken, budget=5).collect()}
    assert rows["b"].error == "no X" and rows["a"].error is None and len(rows["a"].features) == 4 and "c" not in rows


def test_pooling(spark, one):
    tokens = F.array(*[F.array(F.lit(float(i)), F.lit(float(10 * i))) for i in range(6)])
    size = F.lit(4)
    assert one(features.pool_tokens(tokens, size)) == [2.5, 25.0]
    assert one(features.pool_tokens(tokens, size, last_n=2)) == [3.5, 35.0]
    assert one(features.pool_tokens(tokens, size, last_n=9)) is None
    assert one(features.pool_tokens(tokens, size, "first")) == [0.0, 0.0]
    assert one(features.pool_tokens(tokens, size, "end")) == [5.0, 50.0]


def test_scaling_twice_is_refused(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [3.0, 5.0])], "id string, features array<double>")
    scaled = model.standardize(df)
    assert sorted(r.features for r in scaled.collect()) == [[-1.0, 0.0], [1.0, 0.0]]
    with pytest.raises(ValueError, match="already"):
        model.standardize(scaled)


def test_balanced_resample(spark):
    df = spark.createDataFrame([(i, 0 if i < 900 else 1) for i in range(1000)], "id int, label int")
    counts = {r.label: r["count"] for r in model.balanced_resample(df).groupBy("label").count().collect()}
    size = stats.balanced_sample_size(df, "label").first().sample_size
    assert counts[0] == pytest.approx(size / 2, rel=0.05) and counts[1] == pytest.approx(size / 2, rel=0.05)
    again = model.balanced_resample(df.repartition(7)).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in again} == counts
    rare = spark.range(30_000).select("id", (F.col("id") == 7).cast("int").alias("label"))
    drawn = model.balanced_resample(rare).where("label = 1").select(F.count("copy").alias("n"), F.max("copy").alias("top"), F.countDistinct("copy").alias("d")).first()
    half = stats.balanced_sample_size(rare, "label").first().sample_size / 2
    assert drawn.n == drawn.top == drawn.d and half > 2 * model.COPIES and abs(drawn.n - half) <= 1


def test_classifier(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(i % 2 * 3, 1), rng.gauss(0, 1)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, features array<double>, label int")
    for weighted in (False, True):
        fitted = model.train_classifier(df.where("id < 150"), df.where("id >= 150"), 2, (4,), epochs=4, weighted=weighted)
        score = stats.balanced_accuracy(fitted.predict(df), "label", "prediction").first()[0]
        assert score > 0.85
        assert fitted.training_curve(spark).where("is_best").count() == 1
    fitted.save(spark, str(tmp_path / "m"))
    loaded = model.Classifier.load(spark, str(tmp_path / "m"))
    same = lambda c: [tuple(r) for r in c.predict(df).select("id", "prediction").orderBy("id").collect()]
    assert same(loaded) == same(fitted)
    ids = spark.createDataFrame([(i, i % 3) for i in range(200)], "id int, genome_id int")
    notes = spark.createDataFrame([(i, "K1") for i in range(0, 200, 2)], "id int, ko string")
    table = scoring.score_genomes(
        loaded, df, ids, notes, ids.select("genome_id").distinct().withColumn("copies", F.lit(1)),
        ids.select("genome_id").distinct().withColumn("size", F.lit(9)),
    )
    assert table.count() == model.predict_positives(loaded, df).count() and "ko" in table.columns


def test_training_goes_on_from_the_last_epoch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(i % 2 * 3, 1), rng.gauss(0, 1)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, features array<double>, label int").coalesce(1)
    train, val = df.where("id < 90"), df.where("id >= 90")
    whole = model.train_classifier(train, val, 2, (3,), epochs=3, steps=3)
    begun = model.train_classifier(train, val, 2, (3,), epochs=1, steps=3)
    begun.save(spark, str(tmp_path / "m"))
    later = model.train_classifier(train, val, 2, (3,), epochs=2, steps=3, resume=model.Classifier.load(spark, str(tmp_path / "m")))
    for fitted in (whole, later):
        assert [line[0] for line in fitted.curve] == [0, 1, 2, 3] and sum(line[4] for line in fitted.curve) == 1
        losses = [line[2] for line in fitted.curve]
        assert losses == sorted(losses, reverse=True) and losses[3] < losses[0]
        top = max(line[3] for line in fitted.curve)
        kept = stats.balanced_accuracy(fitted.predict(val), "label", "prediction").first()[0]
        assert kept == pytest.approx(top) and next(line for line in fitted.curve if line[4])[3] == top
    assert later.last == pytest.approx(whole.last) and [x[2] for x in later.curve] == pytest.approx([x[2] for x in whole.curve])


def test_pairs_along_the_strand(spark):
    rows = [("a", 1, 10, 1), ("a", 2, 30, 1), ("a", 3, 50, 1), ("b", 4, 10, -1), ("b", 5, 30, -1)]
    df = spark.createDataFrame(rows, "g string, id int, start long, strand int")
    got = {r.g: (r.c_terminus, r.n_terminus) for r in dedupe.strand_ordered_pair(df, "g", "id").collect()}
    assert got == {"a": (1, 2), "b": (5, 4)}


def test_consolidation_check(spark):
    proteins = spark.createDataFrame([("g", "1_1", "MK"), ("g", "1_2", "MA")], "genome_id string, ID string, seq string")
    vectors = spark.createDataFrame([("g", "1_1", [1.0])], "genome_id string, ID string, features array<double>")
    assert [r.ID for r in assemble.unmatched(proteins, vectors).collect()] == ["1_2"]


def test_corpus_plan(spark, tmp_path):
    rng = random.Random(8)
    entry = (
        "<entry><accession>P{i}</accession><name>N{i}</name><organism><lineage><taxon>{d}</taxon></lineage></organism>"
        '<proteinExistence type="predicted"/><sequence>{s}</sequence></entry>'
    )
    rows = []
    for i in range(40):
        seq = "M" + "".join(rng.choice("ACDEFGHIKLNPQRSTVWY") for _ in range(60))
        if i % 4 == 0:
            seq = seq[:30] + "U" + seq[30:]
        rows.append(entry.format(i=i, d="Bacteria" if i else "Archaea", s=seq))
    (tmp_path / "e.xml").write_text("<x>" + "".join(rows) + "</x>")
    built = corpus.build_corpus(spark, [str(tmp_path / "e.xml")], str(tmp_path / "out"), classes=2)
    assert built.count() == 39 and {r.dataset for r in built.select("dataset").distinct().collect()} == {"train", "val", "test"}
    assert built.where("label = 1 and id like '%-' and length(seq) = 30").count() == 9


def test_gene_plan(spark):
    contigs = spark.createDataFrame([("A", "ATGAAATAA" * 3)], "contig_id string, nt string")
    genes = spark.createDataFrame([("g", "A", 1, 9, 1)], GENE)
    refs = spark.createDataFrame([("r", "A", 1, 18, 1, "CDS", False)], REF)
    row = gene_plan.annotate(genes, refs, contigs).first()
    assert (row.label, row.alignment, row.start_codon, row.stop_codon, row.ref_length) == ("cds", "n_terminus", "ATG", "TAA", 5)


def test_long_near_copies_and_families_link_beyond_chance(spark):
    rng = random.Random(11)

    def mutate(text, letters, changed):
        return "".join(rng.choice(letters.replace(c, "")) if rng.random() < changed else c for c in text)

    base, other = ("".join(rng.choices("ABCDEF", k=n)) for n in (12_050, 11_000))
    rows = [("base", base), ("copy", mutate(base[:12_000], "ABCDEF", 0.001)), ("other", other)]
    kept = cluster.dereplicate(spark.createDataFrame(rows, "id string, seq string"))
    assert {r.id for r in kept.collect()} == {"base", "other"}

    amino = "ACDEFGHIKLMNPQRSTVWY"
    proteins = ["".join(rng.choices(amino, k=1000)) for _ in range(40)]
    rate = similarity.chance_rate(similarity.kmer_holders(spark.createDataFrame(list(enumerate(proteins)), "id long, seq string"), 3))
    pairs = [(share, a, mutate(a, amino, 1 - share)) for share in (0.7, 0.5) for a in proteins[:10]]
    pairs += [(0.0, a, b) for a, b in zip(proteins, proteins[1:])]
    compared = similarity.compare_kmers(spark.createDataFrame(pairs, "share double, a string, b string"), "a", "b", 3)
    shared = similarity.beyond_chance(F.col("shared"), F.col("own"), F.col("other"), rate)
    jaccard = shared / (F.col("own") + F.col("other") - shared)
    linked = compared.groupBy("share").agg(F.avg((jaccard >= similarity.jaccard_for_identity(0.3, 3)).cast("int")).alias("part"))
    part = {r.share: r.part for r in linked.collect()}
    assert part[0.7] == 1 and part[0.0] == 0


@pytest.mark.parametrize("k, least, share", [(3, 0.15, 0.1), (4, 0.45, 0.0), (4, 0.45, 0.6), (9, 0.3, 0.1), (3, 1.0, 0.1)])
def test_similar_pairs_miss_none(spark, k, least, share):
    rng = random.Random(k)
    rows = []
    for family, letters in enumerate(("ABCD", "ABCDEFGHIJ", "ABCDEé的𝄞")):
        base = rng.choices(letters, k=150)
        for i in range(14):
            cut_at = rng.randrange(60, 151)
            rows.append((f"{family}{i:02}", "".join(c if rng.random() > 0.02 * (i % 6) else rng.choice(letters) for c in base[:cut_at])))
    rows += [("short", "AB"), ("same", rows[0][1]), ("none", None), ("z", "ABCDABCDABCD" * 30)]
    df = spark.createDataFrame(rows, "id string, seq string")
    single = {}
    for i, seq in sorted(rows):
        if seq is not None:
            single.setdefault(seq, i)
    sets = {i: (len(seq), {seq[j : j + k] for j in range(len(seq) - k + 1)}) for seq, i in single.items()}
    want = {}
    for a, b in itertools.combinations(sets, 2):
        shared = len(sets[a][1] & sets[b][1])
        if shared and shared / len(sets[a][1] | sets[b][1]) >= least:
            center, other = sorted((a, b), key=lambda i: (-sets[i][0], i))
            want[other, center] = shared
    got = similarity.similar_pairs(df, k, least, probe_share=share).collect()
    assert {(r.id, r.center): r.shared for r in got} == want and len(got) == len(want)


def test_frequent_words_are_dealt_to_blocks(spark):
    rows = [(i, "ABCDEFGH" + "".join(random.Random(i // 2).choices("JKLMNOPQ", k=30)) + "RS"[i % 2]) for i in range(60)]
    single = spark.createDataFrame(rows, "id long, seq string")
    holders = similarity.kmer_holders(single, 4)
    for known in (5, 1_000_000):
        prefix = similarity.prefixes(single, holders, 4, 0.6, 0.9, known=known)
        pairs = {hot: {(r.id, r.other) for r in similarity.candidate_pairs(prefix, 0.6, 0.9, hot=hot).collect()} for hot in (7, 2000)}
        assert pairs[7] == pairs[2000] >= {(2 * i, 2 * i + 1) for i in range(30)}
