import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chatterforge.llm import paragraph_dedup as P

from .helpers import AWKWARD, SAME, awkward, documents, sha, texts, words


def model(docs, size=5, least=0.8):
    paragraphs, index, root = [], defaultdict(list), []
    for i, t in sorted(docs.items()):
        for n, line in enumerate(t.split("\n")):
            w = words(line)
            if len(w) >= size:
                grams = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
                paragraphs.append((i, n, grams))
                root.append(len(root))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for k, (_, _, grams) in enumerate(paragraphs):
        met = Counter(m for g in grams for m in index[g])
        for m, shared in met.items():
            if shared >= least * (len(grams) + len(paragraphs[m][2]) - shared):
                links.add((m, k))
                a, b = find(k), find(m)
                root[max(a, b)] = min(a, b)
        for g in grams:
            index[g].append(k)
    gone = {i: {} for i in docs}
    for k, (i, n, _) in enumerate(paragraphs):
        if find(k) != k:
            gone[i][n] = paragraphs[find(k)][:2]
    return gone, len(links)


def spelled(gone):
    return {i: ",".join(f"{n}:{a}:{b}" for n, (a, b) in sorted(g.items())) for i, g in gone.items()}


def test_brute_force_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    by_id = texts(spark, folder)
    gone, links = model(by_id)
    assert links > 1000
    rows = P.dedup_paragraphs(documents(spark, folder)).collect()
    found = {r["doc_id"]: r["removed"] for r in rows}
    expected = spelled(gone)
    same = sum(found[i] == expected[i] for i in expected)
    assert same >= 0.995 * len(expected)
    for r in rows:
        dropped = {int(x.split(":")[0]) for x in r["removed"].split(",") if x}
        kept = "\n".join(x for n, x in enumerate(by_id[r["doc_id"]].split("\n")) if n not in dropped)
        assert r["kept_sha256"] == sha(kept) and r["n_removed"] == len(dropped)


def test_tables_too_large_to_broadcast(spark, sf_dir, monkeypatch):
    docs = documents(spark, sf_dir)
    usual = {r["doc_id"]: r["removed"] for r in P.dedup_paragraphs(docs).collect()}
    monkeypatch.setattr(P, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(P, "BROADCAST_BUCKETS", 0)
    assert {r["doc_id"]: r["removed"] for r in P.dedup_paragraphs(docs).collect()} == usual


def test_bands_meet_nearly_all_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        shared = rng.integers(0, 1 << 63, 80, np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 10, np.uint64)]) for _ in range(2))
        met += bool(set(P.band_hashes(a, P.BANDS, P.ROWS)) & set(P.band_hashes(b, P.BANDS, P.ROWS)))
    assert met / 400 > 0.97


@pytest.mark.parametrize("edits", [2, 5])
def test_one_large_group_of_near_copies(spark, monkeypatch, edits):
    """With five edits, most copies are alike, but below the threshold."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(P, "BLOCK_MEMBERS", 40)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone, _ = model(dict(rows))
    assert {r["doc_id"]: r["removed"] for r in P.dedup_paragraphs(docs).collect()} == spelled(gone)


def test_awkward_rows(spark):
    rows = P.dedup_paragraphs(awkward(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    # The null id sorts first, so its paragraph stays.
    assert sorted(r["removed"] for r in rows if r["doc_id"] in (4, 5, 6)) == ["0::0"] * 4
    assert [r["removed"] for r in rows if r["doc_id"] is None] == ["", ""]
    assert [r["n_lines"] for r in rows if r["doc_id"] == 1] == [1]
    assert P.dedup_paragraphs(awkward(spark, [])).count() == 0
    other = [(1, SAME), (1, SAME + "\nother words stand here now"), (1, SAME)]
    found = P.dedup_paragraphs(awkward(spark, other)).collect()
    assert sorted(r["n_removed"] for r in found) in ([0, 0, 1], [0, 1, 1])
