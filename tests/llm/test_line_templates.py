import re
from collections import defaultdict

import pytest

from chatterforge.llm import line_templates as L

from .helpers import AWKWARD, SAME, awkward, documents, sha, texts


def tokens(line):
    return [("<*>" if re.search("[0-9]", t) else t) for t in line.strip(" ").split(" ")]


def model(docs, depth=2, min_docs=3, min_tokens=3, exact=False):
    """docs: id -> text; gives id -> dropped line numbers; ``exact``: copies of a first holder keep what it keeps."""
    lines = [(i, n, tuple(tokens(x))) for i, t in docs.items() for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    leaves, rows = defaultdict(set), defaultdict(int)
    for _, _, t in lines:
        leaf = (len(t), t[:depth])
        leaves[leaf].add(t)
        rows[leaf] += 1
    enough = lambda t: (n := sum(x != "<*>" for x in t)) >= min_tokens and 2 * n >= len(t)
    key = {}
    for leaf, forms in leaves.items():
        for f in forms:
            key[f] = f if enough(f) else None
        if len(forms) > 1 and rows[leaf] >= min_docs:
            kept = [next((x for x in {f[p] for f in forms} if 2 * sum(f[p] == x for f in forms) > len(forms)), None) for p in range(leaf[0])]
            for f in forms:
                shape = tuple(x if x == k else "<*>" for x, k in zip(f, kept))
                if enough(shape):
                    key[f] = (leaf, shape)
    where = defaultdict(list)
    for i, n, t in lines:
        if key[t] is not None:
            where[len(t), t[:depth], key[t]].append((i, n, len(t)))
    dropped = {i: [] for i in docs}
    for places in where.values():
        if len({i for i, _, _ in places}) >= min_docs:
            first, line, _ = min(places)
            for i, n, _ in places:
                if n != line or not (i == first or (exact and docs[i] == docs[first])):
                    dropped[i].append(n)
    return {i: sorted(d) for i, d in dropped.items()}


def result(df):
    return {r["doc_id"]: r["dropped_lines"] for r in df.select("doc_id", "dropped_lines").collect()}


@pytest.mark.parametrize("few", [8, 0])
def test_plain_model_on_documents(spark, few, monkeypatch):
    monkeypatch.setattr(L, "FEW_FORMS", few)
    monkeypatch.setattr(L, "BROADCAST_ROWS", L.BROADCAST_ROWS if few else 0)
    folder = "/root/testdata/sf0.01"
    expected = model(texts(spark, folder))
    assert sum(map(len, expected.values())) > 50
    docs = documents(spark, folder)
    found = L.dedup_lines(docs)
    assert result(found) == expected


def test_variable_fields_and_words(spark):
    names = ["anna", "bert", "carl", "dora", "emil", "fred"]
    rows = [(i, f"Text number {n} begins\nuser {n} signed in at 10:0{i} from 10.0.0.{i}\nown words of {n} follow here") for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = model(dict(rows), depth=1)
    assert result(L.dedup_lines(docs, depth=1)) == expected
    assert model({i: t.split("\n")[1] + f"\nline {i}{i} alone and else {'x ' * i}" for i, t in rows}, depth=1)[5] == [0]


def test_the_first_occurrence_stays(spark):
    line = "Licensed under the same old words."
    rows = [(i, f"{' '.join(w * 3 for w in 'abcdefghijklm'[i : i + 8])} is most of this text\n{line}") for i in range(5)]
    rows += [(10 + i, "a first line that is shared\na second line that is shared too") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in L.dedup_lines(docs).collect()}
    assert found[0] == (rows[0][1], []) and found[10] == (rows[5][1], [])
    assert all(found[i] == (rows[i][1].split("\n")[0], [1]) for i in range(1, 5))
    assert all(found[10 + i] == ("", [0, 1]) for i in range(1, 4))
    assert {i: d for i, (_, d) in found.items()} == model(dict(rows))
    assert result(L.dedup_lines(docs, copies=L.EXACT)) == model(dict(rows), exact=True)


def test_awkward_rows(spark):
    docs = awkward(spark, AWKWARD)
    found = L.dedup_lines(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    # SAME stands in the rows of a null id, 4, 5 and 6; the null id comes first.
    kept = lambda i, t: (i, "" if t == SAME and i is not None else t)
    assert sorted(str((r["doc_id"], r["text"])) for r in found.collect()) == sorted(str(kept(i, t)) for i, t in AWKWARD)
    assert sorted(str((r["doc_id"], r["text"])) for r in L.dedup_lines(docs, copies=L.EXACT).collect()) == sorted(str(x) for x in AWKWARD)
    assert L.dedup_lines(awkward(spark, [])).count() == 0
    more = [(i, f"{SAME}\n{'abcdefgh'[i] * 4} is the rest of this text and is longer than the line above it is, by one word or more ok") for i in range(4)]
    dropped = {r["doc_id"]: r["dropped_lines"] for r in L.dedup_lines(awkward(spark, [*more, (3, None), (None, SAME + "\n" + "y " * 50)])).collect() if r["text"]}
    assert dropped == {None: [], 0: [0], 1: [0], 2: [0], 3: [0]}


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = L.dedup_lines(documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_digest_of_what_is_kept(spark, sf_dir):
    from chatterforge.llm.queries import QUERIES

    by_id = texts(spark, sf_dir)
    for r in QUERIES["op9_line_templates"](spark, sf_dir).collect():
        gone = {int(x) for x in r["dropped_lines"].split(",") if x}
        kept = "\n".join(x for i, x in enumerate(by_id[r["doc_id"]].split("\n")) if i not in gone)
        assert r["kept_sha256"] == sha(kept) and r["n_dropped"] == len(gone)


def test_every_document_drops_templates_and_exact_copies_stay_equal(spark):
    head, foot = "the header that all of them carry", "the footer that all of them carry"
    rows = [(i, f"{head}\n{'abcdefgh'[i] * 3} own\n{foot}") for i in range(5)]
    rows += [(10 + i, head) for i in range(3)] + [(20, rows[0][1]), (21, rows[1][1])]
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id bigint, text string")
    assert result(L.dedup_lines(docs)) == result(L.dedup_lines(docs, copies=L.NONE))
    whole = {0: [], **{i: [0, 2] for i in (1, 2, 3, 4, 20, 21)}, 10: [0], 11: [0], 12: [0]}
    assert result(L.dedup_lines(docs, copies=L.NONE)) == whole
    # Document 20 is the text of the first holder, 21 that of a document that drops both lines.
    assert result(L.dedup_lines(docs, copies=L.EXACT)) == {**whole, 20: []}


def test_the_query_spares_no_document(spark, tmp_path):
    from chatterforge.llm.queries import QUERIES

    rows = [(i, f"one line that is the whole of every text\n{'abc'[i]}") for i in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op9_line_templates"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["dropped_lines"] for r in found} == {0: "", 1: "0", 2: "0"}


def test_very_long_texts_are_linear(spark):
    """Three texts of 100,000 lines each, of which a third goes, and a fixed and a varying form stay in the first."""
    import time

    def text(i):
        return "\n".join(("open the same door today" if n % 3 == 0 else f"word{'abc'[i]}x{n}" if n % 3 == 1 else f"one line {i} of text") for n in range(100_000))

    rows = [(i, text(i)) for i in range(3)]
    began = time.time()
    found = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert time.time() - began < 100
    assert len(found[0]["dropped_lines"]) >= 33_333 and set(range(0, 100_000, 3)) <= set(found[1]["dropped_lines"])
    for i, t in rows:
        dropped = set(found[i]["dropped_lines"])
        assert found[i]["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dropped)


def test_digest_is_taken_below_the_lines(spark, capsys):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    L.parsed(docs, 2).explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate") < plan.index("md5(")
