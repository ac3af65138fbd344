"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words.  A
document is searched for exact occurrences of any of them:

1. the words of the windows are ordered by rarity, the number of documents that hold them, over all documents;
2. exact containment needs every word of a window, so its necessary prefix under
   that order is its one rarest word: documents are joined with the windows
   on that word only; a window whose rarest word is in no document is left out;
3. the word's place in the window bounds where the window can start, and its
   length bounds where it must end (length and positional filters);
4. the surviving places are verified word by word over the item-sized window.

The windows are a table throughout.  Where their measured size is at most
``INDEX_BYTES`` they are sent to the tasks as one index, and documents are never
shuffled.  Beyond it steps 2 to 4 are joins: documents give the places of rare
words with the words around them, these meet the shapes (offset, length) of the
windows on the word, and the stretches so cut out meet the windows on their text.
Which words are worth a row is told by a bit map of fixed size, so nothing that
is sent grows with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.common import alnum_words, id_text, materialize, sendable, utf8

WINDOW = 10
#: Bytes of the windows as Python objects, up to which they are sent as one index.
INDEX_BYTES = 32 << 20
#: What a window takes in the index beside its own text.
ENTRY_BYTES = 250
#: Bits of the map of words; 8 MiB.
MAP_BITS = 1 << 26
#: Bits of one piece of the map, given by ``bitmap_construct_agg``.
PIECE_BITS = 1 << 15
#: Words counted or remembered before a task passes them on or forgets them.
MOST_WORDS = 500_000
#: Rows of a table of words or texts that is broadcast; its bytes are bounded too.
BROADCAST_ROWS = 200_000


def item_windows(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    """The windows of an item, space-joined; an item of fewer words is one window."""
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def strings(values: Iterable[bytes]) -> pa.Array:
    """UTF-8 texts as an Arrow string column."""
    return pa.array(list(values), pa.binary()).cast(pa.string())


def _window_batches(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch["item_id"].to_pylist(), utf8(batch["text"])):
                found = set(item_windows(alnum_words(text), width))
                ids += [item] * len(found)
                windows += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), strings(windows)], ["item_id", "win"])

    return run


class WordMap:
    """Tells words that are surely not wanted from others, by one bit of their hash."""

    def __init__(self, bits: bytes):
        self.bits, self.wanted, self.other = bits, set(), set()

    def among(self, words: set[bytes]) -> set[bytes]:
        """Those of ``words`` that may be wanted."""
        import xxhash

        new = words - self.wanted - self.other
        if new:
            if len(self.wanted) + len(self.other) >= MOST_WORDS:
                self.wanted, self.other, new = set(), set(), words
            for word in new:
                bit = xxhash.xxh64_intdigest(word, 42) % MAP_BITS
                (self.wanted if self.bits[bit >> 3] >> (bit & 7) & 1 else self.other).add(word)
        return words & self.wanted


def word_map(words: DataFrame):
    """A broadcast map of the column ``word``; ``WordMap`` reads it.  Its size is fixed."""
    bit = F.col("bit")
    pieces = words.select(F.xxhash64("word").bitwiseAND(F.lit(MAP_BITS - 1)).alias("bit")).groupBy(F.floor(bit / PIECE_BITS).alias("piece"))
    bits = bytearray(MAP_BITS // 8)
    for row in pieces.agg(F.bitmap_construct_agg((bit % PIECE_BITS).cast("bigint")).alias("bits")).collect():
        start = row["piece"] * PIECE_BITS // 8
        bits[start : start + PIECE_BITS // 8] = row["bits"]
    return words.sparkSession.sparkContext.broadcast(bytes(bits))


def _count_batches(bits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = WordMap(bits.value), Counter()
        for batch in batches:
            for text in utf8(batch["text"]):
                counts.update(wanted.among(set(alnum_words(text))))
                if len(counts) >= MOST_WORDS:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    return run


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([strings(counts), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def keyed_windows(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, width: int) -> DataFrame:
    """``win, items, word, offset, length``: the windows that can occur, under their rarest words.

    Ties in rarity go to the smaller word; its first place in the window counts.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    pairs = items.where("item_id is not null").mapInArrow(_window_batches(width), "item_id string, win string")
    wins = materialize(pairs.groupBy("win").agg(F.collect_set("item_id").alias("items")))
    words = wins.select("win", F.explode(F.array_distinct(F.split("win", " "))).alias("word"))
    vocabulary = word_map(words.select("word"))
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_count_batches(vocabulary), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = words.join(counts, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rare"))
    parts = F.split("win", " ")
    keyed = wins.join(counted.where("rare.n > 0"), "win").select(
        "win",
        "items",
        F.col("rare.word").alias("word"),
        (F.array_position(parts, F.col("rare.word")) - 1).cast("int").alias("offset"),
        F.size(parts).alias("length"),
    )
    return materialize(keyed)


def sent_index(keyed: DataFrame, most: int):
    """rarest word -> {(its offset, window length) -> {window: item ids}}, broadcast; None where it is too large."""
    entry = F.octet_length("win") + F.octet_length(F.to_json("items")) + ENTRY_BYTES
    if (keyed.agg(F.sum(entry).alias("bytes")).first()["bytes"] or 0) > most:
        return None
    index: dict = {}
    for row in keyed.collect():
        shapes = index.setdefault(row["word"].encode(), {})
        shapes.setdefault((row["offset"], row["length"]), {})[row["win"].encode()] = row["items"]
    return keyed.sparkSession.sparkContext.broadcast(index)


def occurrences(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """(start, end) of each occurring window and the items they belong to."""
    rare = index.keys() & set(words)
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    if rare:
        for place, word in enumerate(words):
            if word in rare:
                for (offset, length), windows in index[word].items():
                    start = place - offset
                    if start >= 0 and start + length <= len(words):
                        owners = windows.get(b" ".join(words[start : start + length]))
                        if owners is not None:
                            spans.append((start, start + length))
                            items.update(owners)
    return spans, items


def _place_batches(bits, width: int) -> Callable:
    """The places of words that may be rare ones, with up to ``width`` - 1 words before and behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordMap(bits.value)
        for batch in batches:
            rows: list[tuple] = []
            for digest, text in zip(batch["digest"].to_pylist(), utf8(batch["text"])):
                words = alnum_words(text)
                wanted = known.among(set(words))
                for place, word in enumerate(words):
                    if word in wanted:
                        first = max(0, place - width + 1)
                        rows.append((digest, place, word, first, b" ".join(words[first : place + width])))
                        if len(rows) >= 10_000:
                            yield _placed(rows)
                            rows = []
            yield _placed(rows)

    return run


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    digest, place, word, first, around = zip(*rows) if rows else ((),) * 5
    columns = [pa.array(digest, pa.string()), pa.array(place, pa.int32()), strings(word), pa.array(first, pa.int32()), strings(around)]
    return pa.RecordBatch.from_arrays(columns, ["digest", "place", "word", "first", "around"])


def joined_hits(texts: DataFrame, keyed: DataFrame, width: int) -> DataFrame:
    """``digest, start, length, items`` of each window that occurs in the texts of a digest, by joins."""
    shapes = materialize(keyed.groupBy("word").agg(F.collect_set(F.struct("offset", "length")).alias("shapes")))
    places = texts.mapInArrow(
        _place_batches(word_map(shapes.select("word")), width), "digest string, place int, word string, first int, around string"
    )
    met = places.join(sendable(shapes, BROADCAST_ROWS), "word").select("digest", "place", "first", "around", F.explode("shapes").alias("shape"))
    words, start = F.split("around", " "), F.col("place") - F.col("shape.offset")
    inside = (start >= F.col("first")) & (start + F.col("shape.length") <= F.col("first") + F.size(words))
    cut = F.array_join(F.slice(words, start - F.col("first") + 1, F.col("shape.length")), " ")
    # Copies of a text give the same rows, which are made one before they move.
    stretches = met.where(inside).select("digest", start.alias("start"), F.col("shape.length").alias("length"), cut.alias("win")).distinct()
    return stretches.join(sendable(keyed.select("win", "items"), BROADCAST_ROWS), "win").select("digest", "start", "length", "items")


def _report(ids: pa.Array, texts: pa.Array, found: Iterable[tuple[int, list, set]]) -> pa.RecordBatch:
    rows: list[list] = [[] for _ in _RESULT]
    for n_words, spans, items in found:
        merged = merge_spans(spans)
        hit, owners = sum(e - s for s, e in merged), sorted(items)
        digest = hashlib.sha256(",".join(owners).encode()).hexdigest()
        for column, value in zip(rows, (n_words, hit, len(owners), digest, hit > 0, [x for span in merged for x in span], owners)):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([ids, texts, *(pa.array(r, k) for r, k in zip(rows, kinds))], ["doc_id", "text", *_RESULT])


def _search_batches(index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = map(alnum_words, utf8(batch["text"]))
            yield _report(batch["doc_id"], batch["text"], ((len(w), *occurrences(w, index.value)) for w in split))

    return run


def _report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, spans, items in zip(utf8(batch["text"]), batch["spans"].to_pylist(), batch["items"].to_pylist()):
            ranges = [(s["start"], s["start"] + s["length"]) for s in spans or ()]
            found.append((len(alnum_words(text)), ranges, set(items or ())))
        yield _report(batch["doc_id"], batch["text"], found)


_RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_ranges", "hit_items"]
_SCHEMA = (
    "doc_id bigint, text string, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
    "contaminated boolean, hit_ranges array<bigint>, hit_items array<string>"
)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching (start, end) spans as maximal runs."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _keep_batches(index, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not occurrences(alnum_words(t), index.value)[0] for t in utf8(batch[text_col])]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """Per document: id, text, word and hit counts, hit word ranges and the items found.

    ``hit_ranges`` holds start, end, start, end ... in words, ``hit_items`` item ids as
    strings, of whatever type they are.  Null and empty texts have no words; very long ones are
    searched whole, one at a time.  Items without an id or without words are not
    searched for.  Repeated documents are returned once each, repeated items count once
    per id.  With an empty benchmark nothing is hit; an empty document table
    gives an empty result.  Other columns are not read.
    """
    texts = id_text(docs, id_col, text_col)
    keyed = keyed_windows(docs, benchmark, text_col, item_col, item_text_col, width)
    index = sent_index(keyed, index_bytes)
    if index is not None:
        return texts.mapInArrow(_search_batches(index), _SCHEMA)
    named = texts.withColumn("digest", F.md5("text"))
    hits = joined_hits(named.select("digest", "text"), keyed, width)
    spans = F.collect_set(F.struct("start", "length")).alias("spans")
    found = materialize(hits.groupBy("digest").agg(spans, F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))
    joined = named.join(sendable(found, BROADCAST_ROWS), "digest", "left").select("doc_id", "text", "spans", "items")
    return joined.mapInArrow(_report_batches, _SCHEMA)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns as they are.

    Null and empty texts hold no window and stay.  Very long texts are searched whole.
    """
    keyed = keyed_windows(docs, benchmark, text_col, item_col, item_text_col, width)
    index = sent_index(keyed, index_bytes)
    if index is not None:
        return docs.mapInArrow(_keep_batches(index, text_col), docs.schema)
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    hit = materialize(joined_hits(texts, keyed, width).select(F.col("digest").alias("__hit")).distinct())
    few = sendable(hit, BROADCAST_ROWS)
    return docs.join(few, digest == few["__hit"], "left_anti")
