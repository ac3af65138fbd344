import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from chatterforge.llm import suffix_dedup as S

from .helpers import AWKWARD, awkward, documents, sha, texts


def model(rows, width=100):
    """rows: (id, text) in order; equal rows get the result of the first."""
    seen, out, done = set(), [], {}
    for i, t in rows:
        if (i, t) not in done:
            b = (t or "").encode()
            covered = bytearray(len(b))
            for p in range(len(b) - width + 1):
                s = b[p : p + width]
                if s in seen:
                    covered[p : p + width] = b"\1" * width
                else:
                    seen.add(s)
            left = bytes(x for x, c in zip(b, covered) if not c)
            done[i, t] = (i, len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), sha(left))
        out.append(done[i, t])
    return out


def result(df):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


def test_contract_on_documents(spark, sf_dir):
    expected = model(sorted(texts(spark, sf_dir).items()))
    assert sum(x[2] for x in expected) > 1000
    assert sorted(result(S.remove_repeats(documents(spark, sf_dir)))) == expected


@pytest.mark.parametrize("hot", [1_000_000, 1])
def test_random_texts_with_small_windows(spark, hot, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(S, "RUN", 50)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(100, "ab" * 80), (101, "a" * 90), (102, "a" * 19)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = S.remove_repeats(docs, width=20, gram=6, hot=hot)
    assert sorted(result(found)) == sorted(model(rows, 20))


def test_long_texts_are_cut_into_chunks(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(3000)).encode()
    monkeypatch.setattr(S, "CHUNK", 256)
    S._powers.cache_clear()
    at, low, high, _ = S.anchors(text, 50, 8)
    starts = sorted(p for a, lo, hi in zip(at, low, high) for p in range(a - hi, a - lo + 1))
    assert starts == list(range(len(text) - 49))
    S._powers.cache_clear()


def test_loser_tree_keeps_order_and_shared_lengths():
    rng = random.Random(1)
    for _ in range(300):
        runs, keys = [], []
        for _ in range(rng.randint(1, 6)):
            run = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12)))
            shared, lengths, rests = S.front_code(run)
            assert S.front_decode(shared, lengths, rests) == run
            runs.append((run, shared))
            keys += run
        order, index, shared = S.merge_runs(runs)
        merged = [runs[r][0][i] for r, i in zip(order, index)]
        assert merged == sorted(keys)
        assert shared == [S.common_prefix(a, b) for a, b in zip([b"", *merged], merged)]


def test_anchors_depend_on_the_window_only():
    rng = np.random.default_rng(3)
    window = bytes(rng.integers(97, 101, 100).tolist())
    offsets = set()
    for n in range(30):
        text = bytes(rng.integers(97, 101, n).tolist()) + window + bytes(rng.integers(97, 101, 40).tolist())
        at, low, high, _ = S.anchors(text)
        offsets |= {a - n for a, lo, hi in zip(at.tolist(), low, high) if a - hi <= n <= a - lo}
    assert len(offsets) == 1


def test_awkward_rows(spark):
    rows = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = result(S.remove_repeats(awkward(spark, AWKWARD)))
    key = lambda r: (str(r[0]), r[1])
    # Rows that repeat a null id follow in the order of their digests; here only one of them has windows.
    assert sorted(found, key=key) == sorted(model(rows), key=key)
    assert S.remove_repeats(awkward(spark, [])).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(awkward(spark, []), width=300)


def test_many_texts_under_one_id(spark):
    """10,000 texts without an id and 10,000 under one: no task gathers them, and repeats are found across them."""
    shared = "".join(random.Random(1).choices("ghijklmnop", k=150))
    text = lambda i: f"{i:06d} " + hashlib.sha256(str(i).encode()).hexdigest() * 3 + (shared if i % 1000 == 0 else "")
    rows = [(None if i < 10_000 else 5, text(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    plan = S.remove_repeats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan and "collect_list(tag" not in plan
    found = S.remove_repeats(df).collect()
    # The digest stands three times in each text, so 128 bytes go; the shared passage goes in all texts but the first.
    assert Counter(r["n_removed"] for r in found) == {128: 19_981, 278: 19}


def test_many_copies_without_an_id(spark):
    rows = [(None, "x" * 300)] * 3000 + [(None, None)] * 3000
    found = Counter((r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    # Each copy is the one document: all but its first 1 byte is covered by strings that start earlier in it.
    assert found == {(300, 299): 3000, (0, 0): 3000}
