import corpus_pipeline as C
import pytest

from . import test_byte_bpe, test_decontaminate, test_line_templates, test_simhash
from .helpers import awkward, documents, sha, texts

model = test_byte_bpe.model


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents before the first stage and after each, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    found, docs = [documents(spark, sf_dir)], documents(spark, sf_dir)
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        found.append(docs)
    return found


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_names(spark, stages):
    assert len(C.STAGES) == 5 and len({n for n, _ in C.STAGES}) == 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage_keeps_good_documents(spark, sf_dir, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = by_id(stages[1])
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 1
    assert all(t == texts(spark, sf_dir)[i] for i, t in list(kept.items())[:20])


def test_line_stage(stages):
    before = by_id(stages[1])
    dropped = test_line_templates.model(before, exact=True)
    expected = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dropped[i]) for i, t in before.items()}
    assert by_id(stages[2]) == expected


def test_near_duplicate_stage(stages):
    before = by_id(stages[2])
    classes = test_simhash.model_components({i: test_simhash.model_print(t) for i, t in before.items()})
    assert by_id(stages[3]) == {i: t for i, t in before.items() if classes[i] == i}


def test_decontamination_stage(spark, sf_dir, stages):
    before = by_id(stages[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = test_decontaminate.model(before, items)
    assert by_id(stages[4]) == {i: t for i, t in before.items() if not hit[i][4]}


def test_last_stage_and_run(spark, sf_dir, stages, model):
    import numpy as np

    expected = {}
    for i, t in by_id(stages[4]).items():
        ids = model.encode_ordinary(t)
        expected[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))
    result = lambda df: {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()}
    assert result(stages[5]) == expected
    assert result(C.run(spark, sf_dir)) == expected


def test_empty_table(spark, sf_dir):
    docs = awkward(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_last_stage_has_the_tokens_and_their_places(stages, model):
    import numpy as np

    before = by_id(stages[4])
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(before) and before
    for r in rows:
        text, parts = before[r["doc_id"]], model.decode_tokens_bytes(model.encode_ordinary(before[r["doc_id"]]))
        ids, starts, ends = (np.frombuffer(r[c], "<u4").tolist() for c in ("ids", "starts", "ends"))
        assert ids == model.encode_ordinary(text) and len(starts) == len(ends) == len(ids)
        at = np.cumsum([0, *map(len, parts)]).tolist()
        # The byte place of each character's end.
        ended = np.cumsum([len(c.encode()) for c in text])
        assert starts == np.searchsorted(ended, at[:-1], "right").tolist()
        assert ends == (np.searchsorted(ended, at[1:], "left") + 1).tolist()
