"""Vector codes and near-duplicate vectors against brute force."""

import hashlib
import math

import numpy as np
import pytest

from dwellstat.llm import near_vectors, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, n int, `a.b` int"


def frame(spark, vectors, labels=None, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    labels = [i % 3 for i in range(len(vectors))] if labels is None else labels
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l, 1, 2) for i, v, l in zip(ids, vectors, labels)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_lloyd(x, parts=8, entries=16, rounds=6):
    """Whole scans every round; x holds whole numbers, by key."""
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
    return *nearest(), books


@pytest.mark.parametrize("spread", [0.0003, 0.3])
def test_codes_equal_plain_lloyd(spark, spread):
    """A small spread makes many equal distances and entries that rest early."""
    vectors = np.random.default_rng(3).normal(0, spread, (400, 16)).astype(np.float32)
    code, error, books = plain_lloyd(np.floor(vectors.astype(float) * 4096).astype(np.int64))
    out = {r.vec_id: r for r in vector_codes.encoded(frame(spark, vectors)).collect()}
    total = {l: int(error.sum(1)[np.arange(400) % 3 == l].sum()) for l in range(3)}
    for i in range(400):
        assert out[i].code == "".join(f"{c:02x}" for c in code[i])
        assert (out[i].error, out[i].label_error) == (error[i].sum(), total[i % 3])
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in out.values()} == {digest}


def test_only_moved_entries_are_compared(monkeypatch):
    points = np.random.default_rng(4).integers(-50, 50, (300, 4))
    entries = points[:10].copy()
    first = vector_codes.distances(points, entries)
    after = entries.copy()
    after[[2, 7]] += 3
    moved = (after != entries).any(1)
    compared, plain = [], vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda p, e: compared.append(len(p) * len(e)) or plain(p, e))
    code, distance = vector_codes.reassigned(points, after, moved, first.argmin(1), first.min(1))
    full = plain(points, after)
    assert (code == full.argmin(1)).all() and (distance == full.min(1)).all()
    stale = int(moved[first.argmin(1)].sum())
    assert sum(compared) == stale * 10 + (300 - stale) * 2


def test_codes_of_odd_rows(spark):
    good = np.random.default_rng(5).normal(size=(6, 10)).tolist()
    odd = [None, [], [None] + [1.0] * 9, [math.nan] + [1.0] * 9, [math.inf] * 10, [1e30] * 10, [1.0] * 9]
    df = frame(spark, good + good[:1] + odd, labels=[None] * 14, ids=[0, 1, 2, 3, 4, None, 0] + list(range(10, 17)))
    out = vector_codes.encoded(df).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in out) == [(False, 0), (False, 0), (False, 1), (False, 2), (False, 3), (False, 4), (True, None)]
    # fewer rows than entries: every row is an entry, and ten components fill two of eight parts' places with zeros
    assert {r.error for r in out} == {0} and {r.label_error for r in out} == {0} and {len(r.code) for r in out} == {16}
    assert vector_codes.encoded(df.where("false")).count() == 0


def brute_links(vectors, cosine=0.9):
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = units @ units.T >= cosine
    component = np.arange(len(vectors))
    while True:
        lower = np.array([component[row].min() for row in links])
        if (lower == component).all():
            return links.sum(1) - 1, component
        component = lower


def spread_vectors(n, width, noise, seed):
    """Clusters of several widths around their centres, so that many cosines lie near the least one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    which = rng.integers(0, 12, n)
    out = centres[which] + rng.normal(size=(n, width)) * (noise * (1 + which % 4))[:, None]
    return out.astype(np.float32)


def test_links_against_brute_force(spark):
    """Wide clusters: groups that meet are compared member by member, and links stay exact."""
    vectors = spread_vectors(900, 24, 0.12, 6)
    degree, _ = brute_links(vectors.astype(float))
    out = {r.vec_id: r for r in near_vectors.linked(frame(spark, vectors)).collect()}
    found = np.array([out[i].n_links for i in range(900)])
    assert (found <= degree).all() and degree.sum() > 20000
    assert found.sum() >= 0.9 * degree.sum()


def test_copies_link_without_pairs(spark):
    rng = np.random.default_rng(7)
    near = (rng.normal(size=(1, 32)) + rng.normal(size=(1500, 32)) * 0.02)
    vectors = np.concatenate([near, np.repeat(near[:1], 300, 0), rng.normal(size=(200, 32))]).astype(np.float32)
    degree, component = brute_links(vectors.astype(float))
    out = {r.vec_id: r for r in near_vectors.linked(frame(spark, vectors)).collect()}
    assert [out[i].n_links for i in range(2000)] == degree.tolist()
    assert [out[i].component_id for i in range(2000)] == component.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


@pytest.mark.parametrize("hashes, least", [(3, 0.9), (4, 0.85)])
def test_buckets_keep_their_chance(hashes, least):
    """Pairs of exactly the least cosine share a bucket about as often with more hashes, as tables are added."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + math.sqrt(0.19) * b / np.linalg.norm(b, axis=1)[:, None]
    tables = math.ceil(8 * 2.25 ** (hashes - 3))
    signs = rng.integers(0, 2, (tables, hashes, 3, 64)) * 2 - 1
    x, y = near_vectors.buckets(a, signs), near_vectors.buckets(b, signs)
    met = (x[:, :, :1] == y).any((1, 2)) | (y[:, :, :1] == x).any((1, 2))
    assert met.mean() >= least


def test_sizes_grow_with_the_table():
    assert near_vectors.sized(0, 64) == (3, 8) and near_vectors.sized(10 ** 8, 64)[0] == 3
    assert near_vectors.sized(10 ** 10, 64)[0] == 4 and near_vectors.sized(10 ** 11, 64)[1] > 8


def test_hadamard_is_orthogonal():
    h = near_vectors.hadamard(np.eye(16))
    assert (h @ h.T == 16 * np.eye(16)).all()


def test_links_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    vectors = [v, [2.0, 4.0, 6.0], v, None, [], [0.0] * 3, [math.nan, 1.0, 1.0], [None, 1.0, 1.0], [1.0, 2.0, 3.0, 0.0], [-1.0, -2.0, -3.0], [1e-40, 2e-40, 3e-40], [3e38] * 3]
    ids = [5, 1, 5, 6, 7, 8, 9, 10, 11, 12, None, 13]
    got = sorted(((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.linked(frame(spark, vectors, ids=ids)).collect()), key=str)
    want = [(False, 5, 4, 1, False), (False, 5, 4, 1, False), (False, 1, 4, 1, True), (True, None, 4, 1, False), (False, 13, 4, 1, False)]
    want += [(False, i, 0, i, True) for i in (6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted(want, key=str)
    assert near_vectors.linked(frame(spark, vectors).where("false")).count() == 0
