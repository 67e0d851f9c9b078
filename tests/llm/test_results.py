"""Results against SQL, brute force, exact round trips and planted cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import cases
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from checking import DATA, compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from seqtables.llm import buckets, decontaminate, exact_dedup, graph, language, line_dedup, mixing, near_dedup, secrets, subword, token_files, urls
from seqtables.llm.queries import ORACLES, QUERIES

FOLDER = f"{DATA}/sf0.001"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    table = pq.read_table(f"{FOLDER}/documents.parquet")
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


def _shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def _roots(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_are_exact(spark, docs):
    sets = {i: _shingles(t) for i, t in docs.items()}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = _roots(links, docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op7_near_dedup"](spark, FOLDER).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in docs}


def test_family_of_edited_copies(spark):
    """Copies of one text with more and more edits, some linked only through others, beside texts with a common passage."""
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, hot, rows = draw(150), draw(60), []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(150), i // 6):
            words[k] = draw(1)[0]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(hot + draw(50 + i % 7))) for i in range(60)]
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table).collect()} == _roots(links, sets)


def test_posterior_bounds_miss_few_links():
    least = near_dedup.least_matches(0.75)
    assert len(least) == near_dedup.BATCHES and least == sorted(least)
    n, m = near_dedup.BATCH, least[0]
    missed = sum(math.comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m))
    assert missed < 1e-5


def test_block_pairs_cover_all_pairs_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 3)
    rows = [(7, i, 10, 10, i + 1, i if i % 3 else 0) for i in range(20)]
    state = spark.createDataFrame(rows, "bucket long, id long, size long, common long, rank int, component long")
    dealt = collections.defaultdict(lambda: ([], []))
    for r in buckets._dealt(state).collect():
        key = (r.left, r.right)
        if r.mine == r.left:
            dealt[key][0].append((r.id, r.component))
        if r.mine == r.right:
            dealt[key][1].append((r.id, r.component))
    met = {frozenset((a, b)) for x, y in dealt.values() for a, c in x for b, d in y if c != d}
    assert met == {frozenset((a, b)) for (_, a, *_, c), (_, b, *_, d) in itertools.combinations(rows, 2) if c != d}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    want = _roots(links, {x for pair in links for x in pair})
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: r for i, r in want.items() if i not in alone}


def _line_set(line):
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def test_fuzzy_lines(spark, docs):
    lines = [(i, n, line.strip(" \t\r\x0b\x0c").lower()) for i, t in docs.items() for n, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    distinct = sorted({x[2] for x in lines})
    sets = [_line_set(x) for x in distinct]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = _roots(links, range(len(sets)))
    first, gone = {}, collections.Counter()
    for i, n, line in sorted(lines):
        root = of[distinct.index(line)]
        if root in first:
            gone[i] += 1
        first.setdefault(root, (i, n))
    got = {r.doc_id: r for r in QUERIES["op6_line_dedup"](spark, FOLDER).collect()}
    assert {i: r.n_dropped for i, r in got.items()} == {i: gone[i] for i in docs}
    kept = [(i, n, line) for i, n, line in sorted(lines) if first[of[distinct.index(line)]] == (i, n)]
    for i, r in got.items():
        assert [x.strip(" \t\r\x0b\x0c").lower() for x in r.text.split("\n") if x.strip(" \t\r\x0b\x0c")] == [x for j, _, x in kept if j == i]


def test_secrets_base(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, FOLDER).collect()}
    key = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    assign = re.compile(key + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for i, text in docs.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert found[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(found[i].spans.split(","))


def test_field_learns_and_adds_spans(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    value = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32))
    rows = [(i, " ".join([word(), word(), 'token = "' + value() + '"', word(), word()]) if i % 2 else " ".join(word() for _ in range(9))) for i in range(80)]
    hidden = value()
    rows.append((1000, f"{word()} tokens = {hidden} {word()}"))  # no pattern matches the plural
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = secrets.fit(secrets.training_windows(docs.where("doc_id < 1000"), "text", "doc_id", ()))
    found = {r.doc_id: r for r in secrets.find_secrets(docs, field, facts=()).collect()}
    at = rows[-1][1].index(hidden)
    assert found[1000].n_assign == 0 and f"crf:{at}:{at + 32}" in found[1000].spans
    assert all(r.n_crf == 0 for i, r in found.items() if i < 1000 and i % 2 == 0)


def test_pruned_decoding_is_the_best_path():
    rng = np.random.default_rng(4)
    tokens = [str(t) for t in rng.choice(["a", "bb", "=", "x9Y8z7", "token", "(("], 7)]
    names = {n for i in range(7) for n in secrets._names(tokens, i)}
    field = secrets.Field({n: rng.normal(0, 2, 3) for n in names}, rng.normal(0, 0.5, (3, 3)))
    emit = np.stack([field.score(secrets._names(tokens, i)) for i in range(7)])
    value = lambda p: sum(emit[i, t] for i, t in enumerate(p)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p))
    best = max(itertools.product(range(3), repeat=7), key=value)
    assert tuple(secrets.Tagger(field).tags(tokens, [])) == best


def test_language_accuracy_and_fusion(spark):
    rows = QUERIES["op1_language_id"](spark, FOLDER).collect()
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    of_docs = [r for r in rows if r.doc_id is not None]
    assert sum(r.language == labels[r.doc_id] for r in of_docs) >= 0.99 * len(of_docs) and all(r.accepted for r in of_docs)
    languages, model = language.fit_text_model(spark.read.parquet(f"{FOLDER}/documents.parquet"), "text", "lang", "doc_id")
    known = [(i, t, None, None, "d", f"h{labels[i]}") for i, t in docs_of(spark)]
    asked = [(-1, "", None, None, "d", "hde"), (-2, None, None, None, None, None), (-3, "\x01\x02" * 400, None, None, None, None)]
    table = spark.createDataFrame(known + asked, "doc_id long, text string, declared string, suffix string, domain string, host string")
    found = {r.doc_id: r for r in language.identify(table, languages, model).collect() if r.doc_id < 0}
    assert found[-1].language == "de" and found[-1].accepted  # the host alone decides
    assert found[-2].language is None and not found[-2].accepted


def docs_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def test_rules_and_urls(spark):
    got = {r.page_id: r for r in urls.judge(cases.pages(spark)).collect() if r.page_id is not None}
    assert (got[0].rule, got[0].verdict) == ("example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block")
    assert got[1].rule is None and got[1].verdict == "block"  # it links to a blocked host more than it is trusted
    assert (got[4].host, got[4].path) == ("", "")


def test_token_files_round_trip(spark, docs, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3)
    written = token_files.write_token_files(table, str(tmp_path / "flat"))
    coder = token_files.encoder(token_files.VOCABULARY)
    want = {i: len(coder.encode_ordinary(t)) for i, t in docs.items()}
    for block in (1 << 20, 97):
        counted = token_files.scan_token_files(written.select("path"), block=block)
        got = {r.doc_id: r.n_tokens for r in written.join(counted, ["path", "ordinal"]).collect()}
        assert got == want


def test_scan_stitches_blocks(spark, tmp_path):
    ids = np.array([5, 5, 9, 9, 5, 5, 5, 5, 5, 9, 5], token_files.TOKEN)
    (tmp_path / "a").write_bytes(ids.tobytes())
    (tmp_path / "b").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in "ab"], "path string")
    for block in (1, 2, 3, 4, 100):
        rows = sorted((r.ordinal, r.first, r.n_tokens, r.ended) for r in token_files.scan_token_files(paths, end=9, block=block).collect())
        assert rows == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 5, True), (3, 10, 1, False)]


def test_cuckoo_filter_grows_and_deletes():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    shard = exact_dedup.Shard()
    for at in range(0, 3000, 250):
        shard.insert(digests[at : at + 250], list(range(at, at + 250)), [1] * 250)
    assert shard.resizes > 0 and shard.filter.contains(exact_dedup._stacked(digests)).all() and len(shard.content) == 3000
    strange = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(3000)]
    assert shard.filter.contains(exact_dedup._stacked(strange)).mean() < 0.01
    shard.insert(digests[:10], list(range(5000, 5010)), [1] * 10)
    assert shard.content[digests[0]] == [5000, 2]
    assert shard.delete(digests[:10], [1] * 10) == [] and shard.delete(digests, [1] * 3000) == digests
    assert not shard.content and not shard.filter.slots.any()


def test_index_updates(spark):
    digest = lambda t: F.unhex(F.sha2(F.col(t), 256))
    rows = lambda pairs: spark.createDataFrame(pairs, "doc_id long, t string").select("doc_id", digest("t").alias("digest"))
    index = exact_dedup.build(rows([(1, "a"), (2, "a"), (3, "b")]), shards=2)
    index = exact_dedup.update(index, 2, inserts=rows([(4, "c"), (9, "b")]))
    index = exact_dedup.update(index, 2, deletes=rows([(4, "c"), (2, "a")]))
    live = {(r.keep_id, r.live) for r in exact_dedup.content(index).collect()}
    assert live == {(2, 1), (9, 2)}
    kept = exact_dedup.survivors(rows([(1, "a"), (3, "b"), (9, "b")]), index)
    assert {r.keep_id for r in kept.collect()} == {1, 9}


def test_flow_over_overlapping_sources():
    sizes = [("a", 100), ("b", 50), (None, 30)]
    targets = mixing.share_out(sizes)
    assert abs(sum(targets.values()) - 270) < 1e-9 and all(targets[k] <= 2 * n + 1e-9 for k, n in sizes)
    plan = mixing.route([(("a",), 60), (("a", "b"), 40), (("b",), 10)], {"a": 80.0, "b": 50.0})
    assert sum(plan.routed.values()) == 130 and plan.taken[0] + plan.taken[1] + plan.taken[2] == 130
    assert plan.taken == [80, 40, 10] or sum(max(0, t - n) for t, n in zip(plan.taken, (60, 40, 10))) == 20  # fewest repeats


def test_mix_takes_the_flow(spark):
    rows = [(i, ["a"] if i % 3 else ["a", "b"], 1 + i % 17) for i in range(300)] + [(999, ["b", None], 40), (1000, [], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, n long")
    out = mixing.mix(docs, F.col("sources"), F.col("n"), mixing.seeded_order(F.col("doc_id"))).collect()
    assert len(out) == 302 and all(0 <= r.taken <= 2 * r.n for r in out)
    again = mixing.mix(docs.repartition(7), F.col("sources"), F.col("n"), mixing.seeded_order(F.col("doc_id"))).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    assert next(r.taken for r in out if r.doc_id == 1000) == 0


def test_base_scores(spark, docs):
    tokens = {i: WORD.findall(t.translate(FOLD)) + ["\n"] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in QUERIES["op10_subword_score"](spark, FOLDER).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-4
        assert r.score < 0


def test_lattice_sums_all_segmentations():
    names = [subword.START + b"a", subword.START, b"a", b"b", b"ab", b"ba", b"aba"]
    logs = [math.log(p) for p in (0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.05, 0.15)]
    trie: dict = {}
    for i, name in enumerate(names):
        node = trie
        for byte in name:
            node = node.setdefault(byte, {})
        node[-1] = i
    pieces = subword.Pieces(trie, logs)

    def cuts(rest):
        return [[]] if not rest else [[i, *more] for i, n in enumerate(names) if rest.startswith(n) for more in cuts(rest[len(n) :])]

    for word in (b"a", b"abab", b"babaab"):
        every = cuts(subword.START + word)
        chances = [math.exp(sum(logs[i] for i in c)) for c in every]
        assert abs(subword.word_log(word, pieces) - math.log(sum(chances))) < 1e-12
        into = [0.0] * 8
        subword.expect(word, 3.0, pieces, into)
        for i in range(7):
            assert abs(into[i] - 3 * sum(p * c.count(i) for p, c in zip(chances, every)) / sum(chances)) < 1e-9


def test_decontamination_tolerates_substitutions(spark):
    words = cases.PASSAGE.split()
    spoiled = [w if i not in (6, 12) else "other" for i, w in enumerate(words)]
    half = "clean words before it " + " ".join(words[4:18]) + " and clean words after it"
    rows = [(1, " ".join(spoiled)), (2, half), (3, "the lazy dog while nothing else of that passage occurs in this text at all"), (4, None)]
    found = decontaminate.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), cases.bench_items(spark))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (2, 0)}


def test_masks_meet_every_tolerated_substitution():
    for n in range(9, decontaminate.WINDOW + 1):
        spare = n * (100 - decontaminate.PERCENT) // 100
        for bad in itertools.combinations(range(n), spare):
            places = ((mask, at) for mask in decontaminate.MASKS for at in range(n - mask[-1]))
            assert any(not any(at + k in bad for k in mask) for mask, at in places), (n, bad)


def test_decontamination_against_alignment_without_seeds(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(4000))
    items = [[word() for _ in range(n)] for n in (6, 8, 9, 10, 12, 13, 20, 40)]
    docs = []
    for trial in range(240):
        item = items[trial % len(items)]
        passage = list(item)
        for at in rng.sample(range(len(item)), rng.randrange(0, 1 + len(item) // 3) if len(item) > 8 else 0):
            passage[at] = word()
        first = rng.randrange(0, 1 + max(0, len(item) - 13))
        docs.append([word() for _ in range(rng.randrange(0, 9))] + passage[first:] + [word() for _ in range(rng.randrange(0, 9))])
    want = {}
    for i, d in enumerate(docs):
        for j, g in enumerate(items):
            width = min(len(g), decontaminate.WINDOW)
            equal = [
                sum(d[a + k] == g[b + k] for k in range(width)) for a in range(len(d) - width + 1) for b in range(len(g) - width + 1)
            ]
            if equal and 100 * max(equal) >= decontaminate.PERCENT * width:
                want[i, j] = max(equal)
    assert len(want) > 100
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{key} long, text string")
    got = decontaminate.contaminations(table(docs, "doc_id"), table(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id): r.n_equal for r in got} == want


def test_pipeline(spark):
    last = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert last.columns[: len(docs.columns)] == docs.columns
    rows = last.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert len({r.text for r in rows}) == len(rows)
    lines = collections.Counter(x.strip().lower() for r in rows for x in r.text.split("\n") if x.strip())
    assert max(lines.values()) == 1
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert not any(item in " ".join(r.text.lower().split()) for r in rows for item in items)


def test_line_keys_follow_the_shingles(spark):
    rows = [(f"{a} plain line number {a} with some words in it", i) for i, a in enumerate(("one", "two"))]
    table = spark.createDataFrame(rows, "line string, k1 long")
    got = table.select(F.size(line_dedup._shingles("line")).alias("n"), "line").collect()
    assert all(r.n == len(_line_set(r.line)) for r in got)


def test_lines_are_compared_by_all_their_characters(spark):
    grams = lambda x: {x[i : i + 9] for i in range(max(1, len(x) - 8))}
    rng = random.Random(3)
    lines = ["https://www.example.com/a/report-2019.pdf", "https://www.example.com/b/photo.jpg", "2023-01-01\talice", "2023-01-02\tbob"]
    for alphabet in ("的一是不了人我在有他这中大来上国", "abcdefghij", "ab \t𝄞"):
        for n in (5, 9, 30, 120, 300):
            base = "x" + "".join(rng.choices(alphabet, k=n)) + "x"
            lines += [base, base[:-2] + "yx", base[: n // 2] + "z" + base[n // 2 :], "".join(rng.choices(base, k=n)) + "x"]
    lines = sorted(set(lines))
    sets = [grams(x) for x in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links
    of = _roots(links, range(len(lines)))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.deduplicate_lines(docs).where("n_left = 1").collect()}
    assert got == set(of.values())


def test_verdicts_do_not_depend_on_rounding(spark):
    many = 30_000  # links that a host's mass is split among: what reaches far.com is under 5e-10
    rows = [
        (0, "https://b.spam.net/", ""),
        (1, "https://heavy.com/", "www.b.spam.net www.light.com " * many),
        (2, "https://light.com/", "www.b.spam.net"),
        (3, "https://far.com/", "www.light.com"),
        (4, "https://alone.com/", ""),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].distrust == 0.0 and got[3].trust == 0.0
    assert [got[i].verdict for i in range(5)] == ["block", "block", "block", "block", "allow"]


def test_words_that_share_beginnings_score_as_alone():
    pieces = subword.load()
    words = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 20, b"a" * (subword.LONG + 5), "日本語".encode(), "日本".encode(), b"\x00\xff", b"abc"]
    got = {at: (ahead[-1], [list(x) for x in ends]) for at, ends, ahead in subword.lattices(words, pieces)}
    assert got == {at: (subword.word_log(w, pieces), subword._edges(subword.START + w, pieces.trie)) for at, w in enumerate(words)}
    sums, alone = [0.0] * len(pieces.logs), [0.0] * len(pieces.logs)
    for at, ends, ahead in subword.lattices(words, pieces):
        subword._backward(ends, ahead, at + 1.0, pieces.logs, sums)
    for at, word in enumerate(words):
        subword.expect(word, at + 1.0, pieces, alone)
    assert max(abs(a - b) for a, b in zip(sums, alone)) < 1e-6


def test_texts_are_cut_alike_in_batches():
    texts = ["  A b\tc\x0bd\x0ce\rf\n", "", None, "x Y y  z Äb\u0085q", "a\x1cb \x1fc", "a a A", "w" * 3_000_000, "one " * 700_000]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.chunked_array([texts[:3], texts[3:]]), pa.array([], pa.string()), pa.nulls(2, pa.string())):
        sizes, names, codes = subword._cut(column)
        names, at = names.to_pylist(), 0
        for size, text in zip(sizes.tolist(), column.to_pylist(), strict=True):
            assert [names[c] for c in codes[at : at + size]] == subword.words_of(text)
            at += size
        assert at == len(codes)
