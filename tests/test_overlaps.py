"""Candidates by blocks against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqtables.operators import cluster, overlaps, similarity, tiles


def brute(rows, k, least):
    sets = {i: {seq[j : j + k] for j in range(len(seq) - k + 1)} for i, seq in rows}
    pairs = itertools.combinations(sets, 2)
    return {(a, b): len(sets[a] & sets[b]) for a, b in pairs if sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


@pytest.mark.parametrize("least", [0.2, 0.6])
def test_blocks_miss_no_pair_and_give_each_once(spark, monkeypatch, least):
    monkeypatch.setattr(overlaps, "LEAST_WORDS", 700)
    monkeypatch.setattr(overlaps, "ROWS", 6)
    rng = random.Random(5)
    base = [rng.choices("ABCDEFGH", k=120) for _ in range(3)]
    rows = []
    for i in range(45):
        size = rng.choice((40, 80, 80, 120))
        rows.append((i, f"{''.join(c if rng.random() > 0.004 * i else rng.choice('ABCDEFGH') for c in base[i % 3][:size])}{i:03}"))
    single = spark.createDataFrame([*rows, (99, "A")], "id long, seq string")
    _, blocks = overlaps.packed_blocks(single, similarity._code_batches(4), least, 0.1)
    assert blocks > 6
    got = [(*sorted((r.id, r.center)), r.shared) for r in similarity.compared_pairs(single, 4, least).collect()]
    want = brute(rows, 4, least)
    assert {(a, b): n for a, b, n in got} == want and len(got) == len(want)


def test_blocks_meet_in_few_tasks_and_far_sizes_lose_no_pair(spark, monkeypatch):
    # before, each two blocks were a task, so that the tasks grew with the square of the input
    for name, value in (("LEAST_WORDS", 500), ("ROWS", 5), ("INDEXED", 2000), ("MEETINGS", 300), ("PAIRS", 3)):
        monkeypatch.setattr(overlaps, name, value)
    rng = random.Random(8)
    base = ["".join(rng.choices("ABCDEFGH", k=300)) for _ in range(2)]
    rows = []
    for i in range(60):
        size = rng.choice((50, 75, 110, 160, 230, 300))
        at = rng.randrange(301 - size)
        rows.append((i, f"{i:02}{base[i % 2][at : at + size]}"))
    single = spark.createDataFrame(rows, "id long, seq string")
    _, blocks = overlaps.packed_blocks(single, similarity._code_batches(4), 0.2, 0.1)
    found = overlaps.counted_pairs(single, similarity._code_batches(4), lambda text: similarity.word_codes(text, 4), 0.2, 0.1)
    assert blocks > 12 and found.rdd.getNumPartitions() < 2 * blocks
    got = {tuple(sorted((r.id, r.other))): r.shared for r in found.where("shared / (own + theirs - shared) >= 0.2").collect()}
    want = brute(rows, 4, 0.2)
    assert got == want and any(len(rows[a][1]) > 2.3 * len(rows[b][1]) for a, b in want)


@pytest.mark.parametrize("least", [0.2, 0.63])
def test_each_two_blocks_that_fit_meet_once(monkeypatch, least):
    monkeypatch.setattr(overlaps, "INDEXED", 30)
    packs = [overlaps.Pack(i, 10 * i, 10 * i + 12, 10, str(i)) for i in range(1, 60)]
    met = [(y, x) for indexed, asked, _ in overlaps.read_lists(packs, least) for y in indexed for x in asked]
    fit = {(y, x) for y in range(59) for x in range(59) if packs[x].high >= packs[y].low and packs[y].high >= packs[x].low * least}
    assert len(met) == len(set(met)) and fit <= set(met)
    for indexed, asked, far in overlaps.read_lists(packs, least):
        assert len(asked) <= overlaps.BLOCKS_READ
        assert not far or min(packs[x].low for x in asked) >= overlaps.far_off(least) * max(packs[y].high for y in indexed)


def test_holders_are_counted_in_pieces(spark, monkeypatch):
    # before, every word of every sequence was a row of its own
    monkeypatch.setattr(similarity, "WORDS_AT_ONCE", 20)
    rows = [(i, text) for i, text in enumerate(["ABCABCD", "BCDEFGH", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "AB", "XYZABCé"] * 3)]
    single = spark.createDataFrame(rows, "id long, seq string")
    got = similarity.kmer_holders(single, 3)
    want = Counter(similarity._word_code(word) for _, text in rows for word in {text[i : i + 3] for i in range(len(text) - 2)})
    assert {r.word % 2**64: r.df for r in got.collect()} == want
    rate = sum(n * n for n in want.values()) / sum(want.values()) ** 2
    assert similarity.word_chance(single, 3) == pytest.approx(rate, rel=1e-12) == similarity.chance_rate(got)
    assert similarity.word_chance(single.where("id < 0"), 3) == 0.0
    monkeypatch.setattr(similarity, "ONE_ROUND", 0)
    assert similarity.word_chance(single, 3) == pytest.approx(rate, rel=1e-12)


def test_words_are_the_same_from_texts_with_and_without_other_letters(spark):
    text = "".join(random.Random(3).choices("ABCDEFGH", k=200))
    rows = [(1, text), (2, f"é{text}"), (3, f"{text}é")]
    for k in (5, 9):
        got = similarity.similar_pairs(spark.createDataFrame(rows, "id long, seq string"), k, 0.8).collect()
        assert {tuple(sorted((r.id, r.center))): r.shared for r in got} == brute(rows, k, 0.8)


def test_steps_hold_words_far_apart():
    lists = [([5, 70_000, 4_000_000], [0, 65_534, 65_535, 131_070]), ([1], []), ([], [4_194_303, 0, 0])]
    packed = [[overlaps._packed(np.array(part, np.int64)) for part in parts] for parts in lists]
    column = pa.array([b"", *[np.concatenate(parts).tobytes() for parts in packed]], pa.binary()).slice(1)
    words, sizes = overlaps._unpacked(column, np.array([len(held) for held, _ in packed]))
    assert words.tolist() == [word for parts in lists for part in parts for word in sorted(part)]
    assert sizes.tolist() == [[len(held), len(rest)] for held, rest in lists]


def test_common_codes_of_many_lists():
    rng = np.random.default_rng(4)
    for size, spread in ((1, 3), (40, 60), (3000, 5000), (3000, 2**63)):
        lists = [np.unique(rng.integers(0, spread, rng.integers(1, size + 1), dtype=np.uint64)) for _ in range(9)]
        lists += [lists[0], lists[0][:1], np.unique(np.concatenate([lists[0], lists[1]]))]
        want = [len(set(lists[0].tolist()) & set(other.tolist())) for other in lists]
        assert overlaps.commons(lists[0], lists) == want == [overlaps.common(lists[0], other) for other in lists]


def test_components_read_their_edges_once(spark):
    count = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long").mapInArrow(seen, "src long, dst long")
    assert {r.component for r in cluster.connected_components(edges).collect()} == {0}
    assert count.value == 20


def test_next_stops_near_and_far_in_a_tile(spark):
    # on the forward strand the stop after place 1 is near or far, and its mirror image on the reverse strand
    rows, want = [], {}
    for i, codons in enumerate((1, tiles.NEAR // 3 - 1, tiles.NEAR // 3, tiles.NEAR // 3 + 1, 500)):
        text = f"{'GCC' * codons}TAAGCCGCC"
        rows += [(f"f{i}", text), (f"r{i}", text[::-1].translate(str.maketrans("ACGT", "TGCA")))]
        want |= {f"f{i}": 3 * codons + 1, f"r{i}": len(text) - 3 * codons - 2}
    cut = tiles.contig_tiles(spark.createDataFrame(rows, "contig_id string, nt string"))
    places = [(name, 1 if name[0] == "f" else len(text) - 2, name[0] == "r") for name, text in rows]
    got = tiles.next_stops(spark.createDataFrame(places, "contig_id string, codon long, backward boolean"), cut)
    assert {r.contig_id: r.found for r in got.collect()} == want
