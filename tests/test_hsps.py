"""Segments and homolog clusters against brute force and planted families."""

import itertools
import random

import pytest

from seqtables.operators import hsps
from seqtables.sources.text import HIT_COLUMNS

AMINO = hsps.RESIDUES


def _mutated(rng, text, share):
    return "".join(c if rng.random() > share else rng.choice(AMINO.replace(c, "")) for c in text)


def _best(scores):
    """(sum, -end, -length) is largest: all segments are tried."""
    return max(((sum(scores[a:b]), -b, b - a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))


def test_segments_are_those_of_a_scan_of_all_diagonals(spark):
    rng = random.Random(2)
    base = "".join(rng.choices(AMINO, k=40))
    subjects = [(f"s{i}", _mutated(rng, base, 0.05 * i)[i : 40 - i // 2]) for i in range(8)] + [("none", None), ("short", "AC")]
    queries = [("q0", base), ("q1", base[10:30] * 2), ("q2", "ééé" + base[:20]), ("q3", None)]
    scoring = hsps.Scoring()
    want = set()
    total = sum(len(s) for _, s in subjects if s)
    for (q, x), (s, y) in itertools.product(queries, subjects):
        found = []
        for d in range(-len(x or ""), len(y or "")):
            places = [p for p in range(len(x or "")) if 0 <= p + d < len(y or "")]
            words = sum(1 for p in places if p + 3 <= len(x) and p + d + 3 <= len(y) and x[p : p + 3] == y[p + d : p + d + 3])
            if words >= 2:
                score = lambda p: int(scoring.table[ord(x[p].encode("latin-1", "replace")), ord(y[p + d])])  # noqa: B023, E731
                value, end, size = _best([score(p) for p in places])
                if value > 0:
                    start = places[0] - end - size
                    found.append((-value, start + 1, start + d + 1, size, sum(x[p] == y[p + d] for p in range(start, start + size))))
        for value, start, other, size, same in sorted(found)[:2]:
            e_value = scoring.kappa * len(x) * total * 2.718281828459045 ** (value * scoring.scale)
            if e_value <= 10:
                want.add((q, s, start, start + size - 1, other, other + size - 1, size - same, round(e_value, 9)))
    frame = lambda rows: spark.createDataFrame(rows, "id string, seq string")
    got = hsps.search(frame(queries), frame(subjects), max_hsps=2, scoring=scoring)
    assert got.columns == [name for name, _ in HIT_COLUMNS]
    rows = got.collect()
    places = ("query_alignment_start", "query_alignment_end", "subject_alignment_start", "subject_alignment_end", "mismatch")
    assert {(r.query_id, r.subject_id, *(r[c] for c in places), round(r.e_value, 9)) for r in rows} == want and want
    assert all(r.query_coverage_per_pair <= r.query_coverage_per_subject <= 100 for r in rows)
    few = hsps.search(frame(queries), frame(subjects), max_subjects=1).collect()
    assert len(few) == len({r.query_id for r in few})


def test_statistics_of_scores():
    scoring = hsps.Scoring()
    at = [ord(c) for c in AMINO]
    table = scoring.table[at][:, at]
    assert (table == table.T).all()
    assert abs((2.718281828459045 ** (scoring.scale * table)).mean() - 1) < 1e-9
    with pytest.raises(ValueError):
        hsps.Scoring(unlike=4).scale
    pairs = hsps.read_scores(["# a comment", "   A  C", "A  4 -1", "C -1  9"])
    assert hsps.Scoring(pairs=pairs).table[ord("C"), ord("C")] == 9 and pairs["A", "C"] == -1


def test_homologs_at_a_third_identity_stay_together(spark):
    """Families whose members keep 35 % of an ancestor's residues, among unrelated proteins."""
    rng = random.Random(8)
    rows = [(f"r{i:03}", "".join(rng.choices(AMINO, k=rng.randint(60, 900)))) for i in range(400)]
    for family in range(10):
        base = "".join(rng.choices(AMINO, k=400))
        rows += [(f"f{family}a", base + "A")] + [(f"f{family}{c}", _mutated(rng, base, 0.65)) for c in "bcde"]
    df = spark.createDataFrame([*rows, ("none", None)], "id string, seq string")
    found = {r.id: r.mmseqs_representative for r in hsps.cluster_homologs(df).collect()}
    assert found["none"] is None and len(found) == len(rows) + 1
    assert len({found[i] for i in found if i.startswith("r")}) == 400
    together = sum(found[f"f{family}{c}"] == f"f{family}a" for family in range(10) for c in "bcde")
    assert together >= 36
    assert all(found[i] == i or found[i][:2] == i[:2] for i in found if i.startswith("f"))


def test_words_of_few_queries_are_looked_for_where_subjects_are_read(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ACDé" if i % 9 == 0 else "ACD", k=rng.randrange(70))) for i in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    asked = df.where("id % 5 = 0")
    for k, groups in ((3, ()), (9, ("AC",)), (20, ("AC", "D"))):
        rows = lambda sent: sorted((r.query_id, r.subject_id, sorted(r.diagonals)) for r in hsps.diagonals(asked, df, k, 2, groups, sent).collect())  # noqa: B023, E731
        assert rows(10_000) == rows(0) != []
    plan = hsps.diagonals(asked, df, 9, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate posexplode" not in plan
