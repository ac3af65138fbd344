from chatterforge.llm import decontaminate as D

from .helpers import AWKWARD, SAME, awkward, documents, sha, texts, words


def model(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = {}
    for doc, text in docs.items():
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                if key in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_contract_on_documents(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    # One item cut short, so that an item smaller than a window is met too.
    items.append((1000, " ".join(words(texts(spark, sf_dir)[0])[5:8])))
    wider = spark.createDataFrame(items, "item_id bigint, text string")
    expected = model(texts(spark, sf_dir), items)
    assert sum(x[4] for x in expected.values()) > 3
    assert result(D.find_contamination(documents(spark, sf_dir), wider)) == expected


def test_joins_give_the_same_as_the_index(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    first = words(texts(spark, sf_dir)[0])
    # Items of fewer words than a window, one of them a single word; ids that are no numbers.
    more = [("short", " ".join(first[5:8])), ("single", first[3]), ("twice", " ".join(first[5:8]))]
    items = bench.selectExpr("cast(item_id as string) item_id", "text").union(spark.createDataFrame(more, "item_id string, text string"))
    docs = documents(spark, sf_dir)
    expected = model(texts(spark, sf_dir), [tuple(r) for r in items.collect()])
    assert result(D.find_contamination(docs, items)) == expected
    assert result(D.find_contamination(docs, items, index_bytes=0)) == expected
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, items, index_bytes=0).collect()}
    assert kept == {doc for doc, row in expected.items() if not row[4]}


def test_joined_windows_at_the_ends_of_texts(spark):
    text = "a b c d e f g h i j k l"
    items = [("1", "a b c d e f g h i j"), ("2", "c d e f g h i j k l"), ("3", "l"), ("4", "a"), ("5", "k l m"), ("6", "a a a a")]
    docs = [(1, text), (2, "l"), (3, "a a a a a"), (4, "m a b"), (5, "k l m k l m"), (6, text)]
    table = spark.createDataFrame(items, "item_id string, text string")
    found = D.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), table, index_bytes=0)
    assert result(found) == model(dict(docs), items)


def test_a_window_without_a_known_word_is_left_out(spark):
    items = spark.createDataFrame([(1, SAME), (2, "never seen here"), (3, "one two unseen")], "item_id bigint, text string")
    keyed = D.keyed_windows(awkward(spark, AWKWARD), items, "text", "item_id", "text", D.WINDOW)
    assert {i for r in keyed.collect() for i in r["items"]} == {"1"}


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, SAME), (1, SAME), (2, None), (None, SAME), (3, "...")], "item_id bigint, text string")
    docs = awkward(spark, AWKWARD)
    for most in (D.INDEX_BYTES, 0):
        rows = D.find_contamination(docs, items, index_bytes=most).collect()
        assert len(rows) == len(AWKWARD)
        assert [r["n_items"] for r in rows if r["doc_id"] == 5] == [1]
        assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2)} == {0}
        none = items.limit(0)
        assert not any(r["contaminated"] for r in D.find_contamination(docs, none, index_bytes=most).collect())
        assert D.find_contamination(awkward(spark, []), items, index_bytes=most).count() == 0


def test_clean_documents_stay(spark):
    items = spark.createDataFrame([(1, SAME)], "item_id bigint, text string")
    docs = awkward(spark, AWKWARD)
    for most in (D.INDEX_BYTES, 0):
        kept = D.drop_contaminated(docs, items, index_bytes=most)
        assert kept.schema == docs.schema
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "7", "8", "9", "None"])
