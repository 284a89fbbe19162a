import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrachron.llm import simhash as S
from terrachron.llm.common import components


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


TEXTS = [None, "", " \t\n", "a", "A", "one two", "One Two", "x y z", "é x  y z", "word " * 400, "word " * 400 + "end"]


def test_contract_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab, 120)) for _ in range(30)]
    near = [t + " tail" for t in base[:10]]
    texts = TEXTS + base + near + base[:5]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r[0]: (r[1], r[2]) for r in S.simhash_components(df).collect()}
    want = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: f % (1 << 64) for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == brute_components(want, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).count() == 0
    assert S.near_duplicates(df).count() == 0


@pytest.mark.parametrize("words,radius", [(1, 0), (1, 2), (1, 5), (2, 20), (4, 39)])
@pytest.mark.parametrize("k", [2, 5, 63, 64, 65, 300])
def test_bit_sliced_links_are_all_links(words, radius, k):
    rng = np.random.default_rng(k)
    centre = rng.integers(0, 1 << 63, (3, words), dtype=np.uint64)
    f = centre[rng.integers(0, 3, 2 * k)]
    for i in range(len(f)):
        for b in rng.integers(0, 64 * words, rng.integers(0, max(1, radius) + 2)):
            f[i, b // 64] ^= np.uint64(1 << int(b % 64))
    group = np.repeat([5, 9], k)
    a, b = S.links(f, group, radius)
    fps = {i: int.from_bytes(f[i].astype(">u8").tobytes(), "big") for i in range(2 * k)}
    want = brute_components({i: v for i, v in fps.items() if i < k}, radius) | brute_components(
        {i: v for i, v in fps.items() if i >= k}, radius
    )
    got = {i: i for i in fps} | dict(zip(a.tolist(), b.tolist()))
    assert got == want


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_blocks_lose_no_pair(n):
    rng = np.random.default_rng(0)
    masks = [m[0] % (1 << 64) for m in S.block_masks(n, 2)]
    for _ in range(300):
        flip = 0
        for b in rng.integers(0, 64, 2):
            flip |= 1 << int(b)
        assert any(not m & flip for m in masks)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = {int(x) for x in rng.integers(0, 1 << 12, 900)}
    df = spark.createDataFrame([(i, i) for i in rows], "id long, w0 long")
    got = S.link(df, S.block_masks(10, 2), 2, 1)
    roots = {r[0]: r[1] for r in components(got).collect()}
    want = brute_components({i: i for i in rows}, 2)
    assert {i: roots.get(i, i) for i in rows} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}


def test_near_duplicates_finds_edited_copies(spark):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(2000)]
    base = [list(rng.choice(vocab, 250)) for _ in range(40)]
    rows, want = [], {}
    for i, w in enumerate(base):
        rows.append((2 * i, " ".join(w)))
        if i < 20:
            e = list(w)
            e[100] = "edit"
            rows.append((2 * i + 1, " ".join(e)))
            want[2 * i + 1] = 2 * i
        want[2 * i] = 2 * i
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[1] for r in S.near_duplicates(df, recall=0.99).collect()} == want


def shingle_set(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, w, share):
    """w with a passage rewritten, so that the share of the five-word shingles of both that is common is about this."""
    n = len(w) - 4
    k = max(1, round(n - 2 * share * n / (1 + share)) - 4)
    at = int(rng.integers(0, len(w) - k))
    return w[:at] + [f"n{x}" for x in rng.integers(0, 10**9, k)] + w[at + k :]


def test_near_duplicates_below_the_similarity_stay(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        w = [f"v{x}" for x in rng.integers(0, 5000, 250)]
        for _ in range(3):  # a chain, each step at about 0.75
            rows.append((len(rows), " ".join(w)))
            w = edited(rng, w, 0.75)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(jaccard(shingle_set(rows[i][1]), shingle_set(rows[i + 1][1])) < 0.8 for i in range(len(rows) - 1))
    assert {r[0]: r[1] for r in S.near_duplicates(df).collect()} == {i: i for i in range(len(rows))}


def test_near_duplicates_at_the_similarity_are_found(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    while len(rows) < 1200:
        w = [f"v{x}" for x in rng.integers(0, 10**6, int(rng.choice([12, 40, 120, 300])))]
        e = edited(rng, w, rng.uniform(0.8, 0.85))
        if jaccard(*(shingle_set(" ".join(x)) for x in (w, e))) >= 0.8:
            want |= {len(rows): len(rows), len(rows) + 1: len(rows)}
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(e))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[1] for r in S.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("n", [2, 40, 120])
def test_similar_sets_are_all_found(n):
    rng = np.random.default_rng(n)
    base = [rng.choice(10**6, 50, replace=False) for _ in range(4)]
    sets = []
    for _ in range(n):
        s = base[rng.integers(0, 4)].copy()
        at = rng.choice(50, int(rng.integers(0, 14)), replace=False)
        s[at] = rng.integers(10**6, 10**7, len(at))
        sets.append(np.unique(s[: int(rng.integers(40, 51))]))
    sets += [np.zeros(0, np.int64), base[0]]
    a, b = S.similar(np.concatenate(sets).astype(np.uint64), np.array([len(s) for s in sets]), 0.8)
    want = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    for edges, others in (((a, b), want), (tuple(zip(*want)) or ((), ()), list(zip(a.tolist(), b.tolist())))):
        u = S._Union(len(sets))
        u.join(np.array(edges[0], int), np.array(edges[1], int))
        assert all(u.to[i] == u.to[j] for i, j in others)


def test_large_components_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    w = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    rows = [(i, " ".join(edited(rng, w, 0.95))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "BLOCK_TEXTS", 16)
    assert {r[1] for r in S.near_duplicates(df).collect()} == {0}


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i // 3 + j) % 50}" for j in range(30))) for i in range(90)], "doc_id long, text string")
    a = {tuple(r) for r in S.simhash_components(df.repartition(1)).collect()}
    b = {tuple(r) for r in S.simhash_components(df.repartition(7)).collect()}
    assert a == b


def test_xxhash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components_that_are_not_complete_raise(spark):
    import pytest

    from terrachron.llm.common import components

    chain = spark.range(60).selectExpr("id as a", "id + 1 as b")
    with pytest.raises(RuntimeError, match="not complete"):
        components(chain, max_rounds=1)
    assert components(chain).where("root = 0").count() == 61
