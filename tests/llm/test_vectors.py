"""The two vector operators against exhaustive search in plain Python."""

import hashlib
import math

import numpy as np
import pytest

from chatterforge.llm import centroids as K
from chatterforge.llm import vector_codes as V
from chatterforge.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error bigint, cluster int, sums array<bigint>, vec string, __label string, __cluster string"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(spark, rows):
    """(vec_id, embedding, label) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", 0, 0, None, "x", "x", "x") for r in rows], SCHEMA)


def lloyd(points, entries, rounds):
    def nearest(x):
        found = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        groups = [[] for _ in entries]
        for x in points:
            groups[nearest(x)[0]].append(x)
        entries = [[sum(c) // len(g) for c in zip(*g)] if g else e for e, g in zip(entries, groups)]
    return entries, [nearest(x) for x in points]


def codes_model(rows, dim):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if good(v) and len(v) == dim]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w, books, found = dim // 8, [], []
    for p in range(8):
        cut = [v[p * w : (p + 1) * w] for _, v, _ in kept]
        e, f = lloyd(cut, cut[:16], 6)
        books.append(e)
        found.append(f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f[n][1] for f in found) for n in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(
        (repr(i), "".join(f"{f[n][0]:02x}" for f in found), errors[n], by_label[label], digest) for n, (i, _, label) in enumerate(kept)
    )


def codes_of(df):
    coded, books = V.compress(df)
    found = V.with_label_error(coded).collect()
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], books.digest()) for r in found), books


def clusters_model(rows):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if good(v) and len(v) == 64]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    kept.sort(key=key)
    e, found = lloyd([v for _, v in kept], [v for _, v in kept[:16]], 3)
    inertia = [sum(d for c, d in found if c == k) for k in range(len(e))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in e]
    return sorted((repr(i), c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (c, d) in zip(kept, found))


def clusters_of(df):
    assigned, told = K.cluster(df)
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in K.with_inertia(assigned, told).collect()), told


def made(seed, n, grid, dim=64):
    """Coarse grids give many equal distances; several groups give the bounds something to prune."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, dim))
    rows = [middles[int(g)] + rng.normal(size=dim) * 0.1 for g in rng.integers(0, 7, n)]
    return [(int(i), [float(np.round(x * grid) / grid) for x in v], int(i) % 3 if i % 5 else None) for i, v in zip(rng.permutation(n), rows)]


@pytest.mark.parametrize("seed,grid", [(1, 1), (2, 2), (3, 4096)])
def test_equal_to_exhaustive_search(spark, seed, grid):
    rows = made(seed, 150, grid)
    df = vectors(spark, rows).repartition(3)
    assert codes_of(df)[0] == codes_model(rows, 64)
    assert clusters_of(df)[0] == clusters_model(rows)


def test_queries_on_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = QUERIES["op11_vector_codes"](spark, sf_dir).collect()
    assert sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found) == codes_model(rows, 64)
    found = QUERIES["op12_centroids"](spark, sf_dir).collect()
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found) == clusters_model(rows)


def test_awkward_rows(spark):
    base, nan, inf = made(4, 40, 2), float("nan"), float("inf")
    bad = [(900, None, 1), (901, [], 1), (902, [nan] * 64, 1), (903, [inf] + [0.0] * 63, None), (904, [None] + [0.0] * 63, 1), (905, [0.5] * 63, 1), (906, [0.5] * 72, 1)]
    odd = [(None, [0.25] * 64, None), (None, [0.25] * 64, 2), (7, base[3][1], 1), (7, base[3][1], 1), (907, [1000.0] * 64, 1), (908, [-0.0] * 64, None)]
    rows = base + bad + odd
    df = vectors(spark, rows).repartition(5)
    assert codes_of(df)[0] == codes_model(rows, 64)
    assert clusters_of(df)[0] == clusters_model(rows)


def test_few_equal_and_no_rows(spark):
    few = [(i, [float(i % 2)] * 64, None) for i in range(5)]
    assert codes_of(vectors(spark, few))[0] == codes_model(few, 64)
    assert clusters_of(vectors(spark, few))[0] == clusters_model(few)
    same = [(i, [0.3] * 64, 1) for i in range(60)]
    assert codes_of(vectors(spark, same))[0] == codes_model(same, 64)
    assert clusters_of(vectors(spark, same))[0] == clusters_model(same)
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 64, 2)]):
        assert codes_of(vectors(spark, rows))[0] == [] and clusters_of(vectors(spark, rows))[0] == []


def test_too_large_components_are_named(spark):
    with pytest.raises(Exception, match="too large for 64-bit distances"):
        V.compress(vectors(spark, [(1, [1e30] * 64, 1)]))


def test_bounds_prune_and_stay_bounds():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-40, 40, (300, 16)) + m for m in (0, 900, 1800, 2700)])
    book = np.stack(np.split(x[[0, 1, 300, 301, 600, 601, 900, 901]], 2, axis=1))
    b = V.Bounds(x, book)
    first = b.measured
    for _ in range(4):
        new = np.stack([V.moved(e, V.summed(b.code[:, p], part, 8)) for p, (e, part) in enumerate(zip(book, np.split(x, 2, axis=1)))])
        shift, book = np.sqrt(V.squared(new, book).astype(float)), new
        b = V.Bounds.kept(b.code, V.rounded_up(b.upper), V.rounded_down(b.lower), shift)
        b.assign(x, book, V.distances(book))
        exact = V.Bounds(x, book)
        assert (b.code == exact.code).all() and (b.upper >= exact.upper * (1 - 1e-9)).all() and (b.lower <= exact.lower * (1 + 1e-9)).all()
    assert b.measured < first / 3


def test_rounding_goes_outwards():
    x = np.array([0.0, 1e-9, 1 / 3, 2049.0, 65503.9, 70000.0, 3e8])
    assert (V.rounded_up(x).astype(float) >= x).all() and (V.rounded_down(x).astype(float) <= x).all()


def test_partial_distances_leave_terms_out(spark):
    rows = made(6, 400, 4096)
    told = clusters_of(vectors(spark, rows))[1]
    assert all(t < 0.6 * told.all_terms for t in told.terms)
