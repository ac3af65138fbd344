import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from chatterforge.llm import byte_bpe as B

from .helpers import AWKWARD, awkward, documents, sha, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_contract_on_documents(spark, sf_dir, model):
    expected = {}
    for i, t in texts(spark, sf_dir).items():
        ids = model.encode_ordinary(t)
        expected[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))
    rows = B.encode(documents(spark, sf_dir), PATH, offsets=False).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == expected


def test_every_character_as_the_reference_tokenizer(model):
    tokenizer, _ = B.load(PATH)
    characters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 17 == 0)]
    wrapped = [f"a{c}b1{c} {c}{c}  {c}!{c}\n" for c in characters]
    for text, found in zip(wrapped, tokenizer.encode_batch_fast(wrapped, add_special_tokens=False)):
        assert found.ids == model.encode_ordinary(text)


def test_special_strings_are_ordinary_text(model):
    tokenizer, _ = B.load(PATH)
    text = "x <|endoftext|> y"
    assert tokenizer.encode(text, add_special_tokens=False).ids == model.encode_ordinary(text)


def test_offsets_cover_the_text_and_split_characters(spark):
    docs = spark.createDataFrame([(1, "ab \U0001f9ffሴ é"), (2, None)], "doc_id bigint, text string")
    _, table = B.load(PATH)
    for row in B.encode(docs, PATH).collect():
        text = "ab \U0001f9ffሴ é" if row["doc_id"] == 1 else ""
        starts, ends, ids = (np.frombuffer(row[c], "<u4").tolist() for c in ("starts", "ends", "ids"))
        assert len(ids) == row["n_tokens"]
        for s, e, i in zip(starts, ends, ids):
            assert table[i] in text[s:e].encode()
        if ids:
            assert starts[0] == 0 and ends[-1] == len(text)
            # A character of several tokens belongs to each of them.
            assert any(b < a for a, b in zip(ends, starts[1:]))


def test_round_trip_and_cut_sequences(spark):
    docs = awkward(spark, AWKWARD)
    tokens = B.encode(docs, PATH)
    back = sorted((str(r["doc_id"]), r["text"]) for r in B.decode(tokens, PATH).collect())
    assert back == sorted((str(i), t or "") for i, t in AWKWARD)
    ids = B.load(PATH)[0].encode("\U0001f9ff", add_special_tokens=False).ids
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, np.array(ids[:1], "<u4").tobytes()), (2, None)], "doc_id bigint, ids binary")
    assert {r["doc_id"]: r["text"] for r in B.decode(cut, PATH).collect()} == {1: "�", 2: ""}
    assert B.encode(awkward(spark, []), PATH).count() == 0


def places(pieces):
    """(start, end) in code points of the byte strings that make up a text, by counting the bytes that begin characters."""
    starts, ends, begun = [], [], 0
    for piece in pieces:
        leads = sum(b & 0xC0 != 0x80 for b in piece)
        starts.append(begun - (piece[0] & 0xC0 == 0x80))
        begun += leads
        ends.append(begun)
    return starts, ends


def test_the_query_gives_digests_of_tokens_and_places(spark, sf_dir, model):
    from chatterforge.llm.queries import QUERIES

    packed = lambda x: sha(np.array(x, "<u4").tobytes())
    expected = {}
    for i, t in texts(spark, sf_dir).items():
        ids = model.encode_ordinary(t)
        pieces = [model.decode_single_token_bytes(x) for x in ids]
        assert b"".join(pieces) == t.encode()
        starts, ends = places(pieces)
        expected[i] = (len(ids), packed(ids), packed(starts), packed(ends), sha(t))
    rows = QUERIES["op4_byte_bpe"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["starts_sha256"], r["ends_sha256"], r["decoded_sha256"]) for r in rows} == expected


def test_places_of_tokens_that_split_characters():
    assert places([b"a", b"\xf0\x9f", b"\xa7\xbf", b"b\xc3", b"\xa9"]) == ([0, 1, 1, 2, 3], [1, 2, 2, 4, 4])
    found = B.character_offsets("a\U0001f9ffb\u00e9".encode(), np.array([1, 2, 2, 2, 1]))
    assert [x.tolist() for x in found] == [[0, 1, 1, 2, 3], [1, 2, 2, 4, 4]]
