import hashlib
import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chatterforge.llm import simhash as S
from chatterforge.llm.components import connected_components

from .helpers import AWKWARD, LOWER, awkward, documents, texts


def model_print(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def model_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_contract_on_documents(spark, sf_dir):
    prints = {i: model_print(t) for i, t in texts(spark, sf_dir).items()}
    classes = model_components(prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(documents(spark, sf_dir)).collect()}
    assert found == {i: (f"{prints[i]:016x}", classes[i]) for i in prints}


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_every_pair_within_the_radius_meets(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    assert any(((x ^ y) & ~sum(1 << i for i in table)) & (2**64 - 1) == 0 for table in S.covering_tables())


@given(st.text(max_size=200))
@settings(max_examples=200)
def test_fingerprint_model(text):
    text = text.encode("utf-8", "ignore").decode()
    assert S.simhash(text.encode()) == model_print(text)


def test_blocks_do_not_matter(monkeypatch):
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(500)).encode()
    whole = S.simhash(text)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.simhash(text) == whole


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(5):
            values.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [S._signed(v) for v in values]
    edges = S.hamming_edges(spark.createDataFrame([(v,) for v in signed], "fp bigint"))
    labels = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    expected = model_components(dict(zip(values, values)))
    got = {}
    for v in values:
        got.setdefault(labels.get(S._signed(v), S._signed(v)), set()).add(v)
    wanted = {}
    for v, c in expected.items():
        wanted.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_loops_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100), (5, 2), (200, 201), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    for size in (5, 40, 120):
        pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(size)]
        pairs += [(1000, 1002), (1001, 1002)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
        assert found == {x: find(x) for p in pairs for x in p}


def test_awkward_rows(spark):
    rows = S.near_duplicates(awkward(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    same = [r["component_id"] for r in rows if r["doc_id"] in (4, 5, 6)]
    assert same == [4] * 4
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 7)} == {1}
    assert S.near_duplicates(awkward(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = awkward(spark, AWKWARD)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and not {5, 6, 2, 7} & set(ids) and 1 in ids and ids.count(None) == 2
    assert S.keep_one(awkward(spark, [])).count() == 0


def test_rows_of_one_id_with_different_texts_are_different_documents(spark):
    alike = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "one text of its own"), (7, "something else entirely here"), (7, "something else entirely here"), (8, "one text of its own"), (9, alike), (9, alike.replace("w59", "w5x")), (None, alike)]
    kept = sorted(str((r["doc_id"], r["text"])) for r in S.keep_one(awkward(spark, rows)).collect())
    close = S.simhash(alike.encode()) ^ S.simhash(rows[5][1].encode())
    nine = [rows[4], rows[5]] if close.bit_count() > 2 else [min(rows[4:6], key=lambda r: hashlib.md5(r[1].encode()).digest())]
    assert kept == sorted(map(str, [rows[0], rows[1], *nine, rows[6]]))
