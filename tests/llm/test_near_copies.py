"""Near copies by wide fingerprints against brute force over all pairs."""

import os
import random

import numpy as np
import pytest
from llm_cases import AWKWARD

from lodestone.llm import common, near_copies


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_pairs(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    return {(rows[i][0], rows[j][0]): s for j in range(len(rows)) for i in range(j) if sets[i] & sets[j] and (s := similarity(sets[i], sets[j])) >= least}


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(rng, n_groups, vocabulary, copies=6):
    """Texts and copies of them with some words changed, from hardly any to too many."""
    rows = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


VOCABULARY = ["".join(random.Random(i).choices("abcdefghij", k=5)) for i in range(4000)]


def test_links_equal_brute_force(spark, small_batches):
    """Of the pairs at 0.8 or more all but three in a hundred are in one component, and no component joins texts that no chain of them does, but for close estimates."""
    rows = edited(random.Random(3), 40, VOCABULARY)
    got = {r.doc_id: r.component_id for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    pairs = brute_pairs(rows)
    caught = [p for p in pairs if got[p[0]] == got[p[1]]]
    assert len(pairs) > 100 and len(caught) >= 0.97 * len(pairs)
    loose = groups(got, brute_pairs(rows, 0.75))
    assert all(loose[i] == loose[c] for i, c in got.items())
    exact = groups(got, pairs)
    assert sum(exact[i] != c for i, c in got.items()) <= 0.02 * len(rows)


def test_verification_drops_what_is_less_similar(spark):
    """Only near the limit: of links that the fingerprints suggest, those below 0.8 go."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [rng.choice(VOCABULARY) for _ in range(300)]
        w = list(base)
        for p in range(10, 10 + 12 * (k % 3 + 5), 12):  # five shingles a change: 0.85 to 0.79
            w[p] = f"changed{k}x{p}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(w))]
    got = {r.doc_id: r.component_id for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = brute_pairs(rows)
    assert 0 < len(pairs) < 60
    wrong = [k for k in range(60) if (got[2 * k + 1] == 2 * k) != ((2 * k, 2 * k + 1) in pairs)]
    assert len(wrong) <= 2


@pytest.mark.parametrize("pairs_at_once", [1 << 21, 10])
def test_forest(monkeypatch, pairs_at_once):
    monkeypatch.setattr(near_copies, "MOST_PAIRS", pairs_at_once)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (6, 4)).astype(np.uint64)
    fps, group = [], []
    for g in range(12):
        for _ in range(20):
            x = base[rng.integers(6)].copy()
            for b in rng.choice(256, int(rng.integers(0, 30)), replace=False).tolist():
                x[b // 64] ^= np.uint64(1 << b % 64)
            fps.append(x)
            group.append(g)
    fps, group = np.array(fps), np.array(group)
    n = len(fps)
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    same = group[:, None] == group[None]
    label, a, b, far = near_copies.near_pairs(group, fps, np.ones(n, bool))
    ij = lambda m: [(i, j) for i, j in zip(*np.nonzero(np.triu(m, 1)), strict=True)]
    sure = groups(range(n), ij(same & (d <= near_copies.SURE)))
    assert label.tolist() == [sure[i] for i in range(n)]
    assert all(d[x, y] == z and near_copies.SURE < z <= near_copies.MOST for x, y, z in zip(a, b, far, strict=True))
    every = groups(range(n), ij(same & (d <= near_copies.MOST)))
    assert groups(range(n), [(i, int(x)) for i, x in enumerate(label) if x != i] + list(zip(a.tolist(), b.tolist(), strict=True))) == every
    assert len(a) == len(set(sure.values())) - len(set(every.values()))


def test_no_similar_pair_is_left_out(spark):
    """Every pair at 0.8 or more is in one component, also if the anchors find few, a nearer link fails, or shingles are frequent."""
    rng = random.Random(11)
    common = [rng.choice(VOCABULARY) for _ in range(30)]
    rows = []
    for k in range(120):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([4, 12, 60, 200]))] + common * (k % 2)
        rows.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    pairs = brute_pairs(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.components(docs, recall=0.05).collect()}
    assert len(pairs) > 100 and [p for p in pairs if got[p[0]] != got[p[1]]] == []


@pytest.mark.parametrize("small", [1, 64])
def test_first_shingles_meet(monkeypatch, small):
    """Every similar pair of different components comes out of some shingle's rows, in groups of either kind."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.append(rng.choice(x, max(1, int(len(x) * 0.95)), replace=False), rng.integers(0, 300, 1).astype(np.uint64))) for x in sets for _ in range(3)]
    component = rng.integers(0, 8, len(sets))
    rows = sorted((int(t), len(x), p, i) for i, x in enumerate(sets) for p, t in enumerate(near_copies.first(x, np.arange(0, 300, 7, dtype=np.uint64))))
    token, n, place, owner = np.array(rows).T
    a, b = near_copies.similar_sizes(token, n, place, component[owner])
    got = {tuple(sorted(x)) for x in zip(owner[a].tolist(), owner[b].tolist(), strict=True)}
    real = [set(x.tolist()) for x in sets]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if component[i] != component[j] and similarity(real[i], real[j]) >= 0.8}
    assert len(want) > 30 and want <= got and all(component[i] != component[j] for i, j in got)


def test_parities_leave_out_no_similar_pair():
    """Parities differ in no more bits than sets do, whatever their sizes, and in too many for a similarity of 0.8 where sets are far apart."""
    rng = np.random.default_rng(7)
    near_pairs, far = 0, []
    for n in [0, 1, 2, 5, 63, 64, 65, 130, 700, 5000] * 8:
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0, 0.5, 0.9, 0.95, 1):
            y = np.concatenate([x[: int(share * n)], rng.integers(0, 1 << 63, int(rng.integers(0, 3 + n * (1 - share)))).astype(np.uint64)])
            p, q, s, t = near_copies.parity(x).tobytes(), near_copies.parity(y).tobytes(), set(x.tolist()), set(y.tolist())
            assert near_copies.differing(p, q) == near_copies.differing(q, p) <= len(s ^ t)
            least = max(near_copies.differing(p, q), abs(len(s) - len(t)))
            if s and t and similarity(s, t) >= 0.8:
                near_pairs += 1
                assert 9 * least <= len(s) + len(t)
            if n > 100 and similarity(s, t) < 0.6:
                far.append(9 * least > len(s) + len(t))
    assert near_pairs > 50 and len(far) > 30 and all(far)


def test_sets_travel_for_likely_pairs_alone(spark, monkeypatch):
    """Of texts that share a passage but are not similar no sets are made and joined, and what is no longer read is gone before the stage ends."""
    rng = random.Random(13)
    passage = [rng.choice(VOCABULARY) for _ in range(100)]
    rows = [" ".join(passage + [rng.choice(VOCABULARY) for _ in range(100)]) for _ in range(150)]
    rows += [rows[0] + " more", rows[7] + " again"]
    sizes, paths = {}, []

    def saved(df, what):
        out = common.saved(df, what)
        sizes.setdefault(what, []).append(out.count())
        paths.append((what, out.inputFiles()[0].removeprefix("file://")))
        return out

    monkeypatch.setattr(near_copies, "saved", saved)
    monkeypatch.setattr(near_copies, "frequent_shingles", lambda texts: np.zeros(0, np.uint64))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.components(docs, recall=0.05).collect()}
    assert {i: c for i, c in got.items() if i != c} == {150: 0, 151: 7}
    assert sizes["near-left"][0] > 5000 and max(sizes["near-sets"]) <= 4
    gone = {what for what, path in paths if not os.path.exists(path)}
    assert gone == {"near-fingerprints", "near-sets"}


def test_salts_change_nothing(spark, monkeypatch):
    rows = edited(random.Random(6), 3, VOCABULARY, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.component_id for r in near_copies.components(docs).collect()}
    monkeypatch.setattr(near_copies, "SALT_ROWS", 20)
    assert {r.doc_id: r.component_id for r in near_copies.components(docs).collect()} == plain


def test_recall_of_the_tables():
    """Pairs with the share of differing bits that similarity 0.8 gives meet at an anchor as often as the plan says."""
    rng = np.random.default_rng(2)
    for classes in (1000, 200_000, 10**9):
        bits, tables = near_copies.plan(classes)
        t = near_copies.sampled_bits(bits, tables)
        assert t.shape == (tables, bits) and all(len(set(x)) == bits for x in t.tolist())
        x = rng.integers(0, 256, (1500, 32), dtype=np.uint8)
        y = x ^ np.packbits(rng.random((1500, 256)) < near_copies.FLIP, axis=1, bitorder="little")
        meet = (near_copies.anchors(x, t) == near_copies.anchors(y, t)).any(axis=1).mean()
        assert near_copies.RECALL - 0.03 < meet


def test_awkward(spark, awkward, no_documents):
    got = near_copies.components(awkward).collect()
    assert len(got) == len(AWKWARD) and near_copies.components(no_documents).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[2] == by[3] == by[1] == {1} and by[6] == {5} and by[5] == {5} and by[None] >= {1}
    kept = near_copies.keep_first(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {1, 4, 5, 7, 8}
    assert near_copies.keep_first(no_documents).count() == 0
