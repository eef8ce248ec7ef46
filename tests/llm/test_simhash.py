import re

import numpy as np
import pytest
import xxhash

from weft.llm import _graph, queries, simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=4):
    """fingerprint -> smallest number of its component, by brute force."""
    fps = np.unique(np.array(fps, np.uint64))
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius) for f in fps]
    while True:
        then = np.array([label[x].min() for x in near])
        if (then == label).all():
            return {int(f): int(k) for f, k in zip(fps, label, strict=True)}
        label = then


def check(rows, docs):
    fps = {i: plain_print(t) for i, t in docs}
    label = plain_components(list(fps.values()))
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", least[label[f]]) for i, f in fps.items()}


def test_op2_on_a_whole_table(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op2_simhash(spark, at).collect(), docs)


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "One TWO three", "a b c d", "a  b\tc\nd e\x0bf\x0cg\rh", "É é\xa0x \x1f y", "w " * 70_000, "ab cd ef gh " * 3])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x y z"), (3, "x y z"), (None, "x y z"), (None, "alone here"), (4, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fp string, node int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.row_id, r.fp): r.component for r in got}
    signed = {t: int(np.uint64(plain_print(t)).view(np.int64)) for _, t in rows}
    assert by[(1, 0)] == by[(2, 0)] == 1
    assert by[(3, signed["x y z"])] == by[(None, signed["x y z"])] == 3
    assert by[(None, signed["alone here"])] is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n, spread", [(3000, 2), (3000, 40), (400, 64), (5000, 3)])
def test_links_are_those_of_brute_force(spark, n, spread):
    rng = np.random.default_rng(n + spread)
    centres = rng.integers(0, 1 << 63, 3 + n // 200, np.uint64)
    fps = centres[rng.integers(0, len(centres), n)]
    for _ in range(spread):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.6).astype(np.uint64)
    nodes = spark.createDataFrame([(int(f),) for f in np.unique(fps).view(np.int64)], "fp long")
    got = {r.node: r.component for r in simhash.link(nodes).collect()}
    label = plain_components(fps)
    want: dict[int, list] = {}
    for f, k in label.items():
        want.setdefault(k, []).append(int(np.uint64(f).view(np.int64)))
    assert {x: min(group) for group in want.values() for x in group} == {int(x): got.get(int(x), int(x)) for x in np.unique(fps).view(np.int64)}


def test_the_tree_prunes(monkeypatch):
    """Of the pairs of a shard, the triangle bounds leave a part to compare, and all links are among them."""
    compared = []
    plain = simhash._outright
    monkeypatch.setattr(simhash, "_outright", lambda fp, a, b, radius: compared.append(len(a) * len(b)) or plain(fp, a, b, radius))
    rng = np.random.default_rng(3)
    unrelated = rng.integers(0, 1 << 63, 2000, np.uint64)
    close = unrelated[:8].repeat(250)
    for _ in range(8):
        close = close ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    for fp, most in ((unrelated, 0.7), (np.unique(close), 0.35)):
        compared.clear()
        found = simhash._within(fp, np.arange(len(fp)), 4)
        assert sum(compared) < most * len(fp) ** 2
        got = {(min(i, j), max(i, j)) for a, b in found for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
        i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}


@pytest.mark.parametrize("shard", [8, 60, 500])
def test_shards_in_cells_and_parts(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
    rng = np.random.default_rng(shard)
    fps = rng.integers(0, 1 << 63, 5, np.uint64)[rng.integers(0, 5, 1500)]
    for _ in range(6):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) * (rng.random(1500) < 0.5).astype(np.uint64)
    fps = np.unique(fps)
    got = {r.node: r.component for r in simhash.link(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")).collect()}
    label = plain_components(fps)
    want: dict[int, list] = {}
    for f, k in label.items():
        want.setdefault(k, []).append(int(np.uint64(f).view(np.int64)))
    assert {x: min(group) for group in want.values() for x in group} == {int(x): got.get(int(x), int(x)) for x in fps.view(np.int64)}


@pytest.mark.parametrize("n", [1, 10**5, 10**7, 10**9, 10**12])
def test_projections_leave_no_pair_out(n):
    masks = simhash.projections(n, 4)
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.component for r in _graph.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {1001: 1000}
    assert _graph.components(edges.limit(0)).count() == 0


def plain_similar(docs, similarity=0.8):
    """doc_id -> smallest id of its component of exact 5-word Jaccard links, by brute force."""
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            small, large = sorted((len(a), len(b)))
            if i < j and label[i] != label[j] and small >= similarity * large and (a == b or len(a & b) >= similarity * len(a | b)):
                new, old = sorted((label[i], label[j]))
                label = {k: new if x == old else x for k, x in label.items()}
    return label


def test_similar_texts_are_those_of_brute_force(spark):
    rng = np.random.default_rng(7)
    docs, vocabulary = [], [f"w{k}" for k in range(5000)]
    for k in range(40):
        words = rng.choice(vocabulary, int(rng.integers(30, 400))).tolist()
        docs.append((k, " ".join(words)))
        for c, part in enumerate((0.01, 0.02, 0.05)):  # up to five shingles change with a word
            new = [w if rng.random() > part else "new" for w in words]
            docs.append((1000 * (c + 1) + k, " ".join(new)))
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  TWO"), (9005, "one three")]
    got = simhash.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = plain_similar(docs)
    assert {r.row_id: r.component for r in got} == want and len(got) == len(docs)
    bits = {i: simhash.fingerprint(t) for i, t in docs}
    assert sum((bits[i] ^ bits[k]).bit_count() > 4 for i, k in want.items()) > 20  # the radius of op2 misses them


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_alike_joins_what_all_pairs_join(similarity):
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, kinds = int(rng.integers(2, 50)), int(rng.integers(3, 80))
        base = [rng.integers(0, kinds, int(rng.integers(0, 40))) for _ in range(4)]
        picked = [x[rng.random(len(x)) > 0.1] for x in (base[k] for k in rng.integers(0, 4, n))]
        sets = [np.unique(np.append(x, rng.integers(0, kinds, int(rng.integers(0, 3))))).astype(np.uint64) for x in picked]
        plain = [set(x.tolist()) for x in sets]
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if len(plain[i] & plain[j]) >= similarity * len(plain[i] | plain[j]) - 1e-9]
        got = simhash.alike(sets, similarity)
        assert set(got) <= set(want) and _labels(n, got) == _labels(n, want)
    assert simhash.alike([np.zeros(0, np.uint64)] * 3, similarity) == [(0, 1), (0, 2)]


def _labels(n, links):
    label = list(range(n))
    for a, b in links:
        new, old = sorted((label[a], label[b]))
        label = [new if x == old else x for x in label]
    return label


def test_a_shared_passage_makes_no_pairs():
    """Texts that share half of their shingles are not compared one by one."""
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.append(common, rng.integers(0, 1 << 63, 300).astype(np.uint64))) for _ in range(1024)]
    compared = []
    ragged = simhash._common.ragged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash._common, "ragged", lambda starts, lengths: compared.append(int(lengths.sum())) or ragged(starts, lengths))
        assert simhash.alike(sets, 0.8) == []
    assert sum(compared) < 1024 * 600  # all pairs would be 300 million elements


def test_a_group_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_TEXTS", 8)
    base = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(40)] + [(100, "another text of a few words"), (None, " ".join(base))]
    got = simhash.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.row_id: r.component for r in got} == {k: 0 for k in range(40)} | {100: 100}
    assert simhash.similar(spark.createDataFrame(docs, "doc_id long, text string").limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies_beyond_four_bits(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    want = plain_similar([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in corpus_pipeline.keep_one(spark, docs, at).collect()} == {i for i, k in want.items() if i == k}
