"""Near-duplicate paragraphs by MinHash banding, verified exactly.

A paragraph is a line of at least ``SHINGLE`` words (runs of ASCII letters, digits and
non-ASCII characters, A-Z lower-cased).  Two paragraphs are near duplicates when the
Jaccard similarity of their sets of ``SHINGLE``-word shingles is ``SIMILARITY`` or more.

*Equal paragraphs* (same words) are one class from the start and stand for each other
by their 128-bit digest.

*Banding.*  ``BANDS`` bands of ``ROWS`` minima each: a pair at similarity s meets in
1 - (1 - s**ROWS)**BANDS of cases, 0.9996 at 0.8 and more above.  A band's value has 48 bits: what meets by
chance is compared like anything else, so short values cost comparisons and never a wrong result.

*Verification.*  In each band's bucket one paragraph is the pivot and is compared with the others;
pairs that hold become links, and components are taken.  The pivot is the one that meets most
paragraphs in all its buckets: the text that the others were copied from.  Buckets whose
paragraphs then lie in one component are settled, so a bucket of n near copies
costs n comparisons.  In the buckets that are still mixed, paragraphs of
different components are compared too: in blocks of ``BLOCK_MEMBERS`` against each other, so that
no task holds a whole bucket, and only links that join something leave a block.  Every pair
that met in a bucket is thus compared or connected, and no link is lost.

Of every component the first paragraph (smallest id, then line) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterforge.llm.common import alnum_words, id_text, materialize, sendable, utf8
from chatterforge.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 15, 4
#: Bytes of a band's value.
VALUE = 6
SEED = 7
BLOCK_MEMBERS = 1000
#: Documents whose list is broadcast to fetch their paragraphs, and buckets (16 bytes each) that are broadcast
#: to the bands; more are shuffled.
BROADCAST_DOCS = 1_000_000
BROADCAST_BUCKETS = 2_000_000
#: Bytes of either, as JSON: joins with these lists would otherwise move every band of every paragraph.
BROADCAST_BYTES = 64 << 20
#: Bytes of paragraphs that are hashed together.
BLOCK = 1 << 19


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    """A random number for each byte; the space that stands between words counts nothing."""
    codes = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, 256, np.uint64)
    codes[32] = 0
    return codes


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text of words with one space between: a polynomial of its bytes, mixed."""
    data = np.frombuffer(text, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    lengths = np.diff(starts, append=len(data) + 1)
    place = np.arange(len(data)) - np.repeat(starts, lengths)[: len(data)]
    powers = np.cumprod(np.full(lengths.max(), 0x5851F42D4C957F2D, np.uint64))
    found = np.add.reduceat(_byte_codes()[data] * powers[place], starts)
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xFF51AFD7ED558CCD)
    return found ^ found >> np.uint64(29)


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes, as a polynomial of them."""
    n = len(codes) - size + 1
    found = codes[:n].copy()
    for i in range(1, size):
        found *= np.uint64(0x9E3779B97F4A7C15)
        found += codes[i : n + i]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ found >> np.uint64(32)


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a paragraph's shingles, sorted."""
    return np.unique(gram_hashes(word_hashes(text), size))


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def band_values(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For the set of hashes from each start to the next, one value for each band, with the band's number above it.

    Equal minima give equal values; a minimum has 32 bits.
    """
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    moved, mixed = np.empty_like(short), np.zeros((len(starts), bands), np.uint64)
    for i, (factor, shift) in enumerate(zip(*_permutations(bands * rows))):
        np.multiply(short, factor, out=moved)
        np.add(moved, shift, out=moved)
        band = mixed[:, i // rows]
        band ^= np.minimum.reduceat(moved, starts)
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    bits = np.uint64(8 * VALUE)
    return (mixed >> (np.uint64(64) - bits) | np.arange(bands, dtype=np.uint64) << bits).view(np.int64)


def band_hashes(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """The values of one set."""
    return band_values(hashes, np.zeros(1, np.int64), bands, rows)[0].tolist()


def signatures(texts: list[bytes], size: int, bands: int, rows: int) -> list[bytes]:
    """The number of distinct shingles and the packed band values of each paragraph."""
    lengths = np.array([t.count(b" ") + 1 for t in texts])
    ends = np.cumsum(lengths)
    grams = gram_hashes(word_hashes(b" ".join(texts)), size)
    # Shingles that would reach from one paragraph into the next are none.
    whole = np.ones(len(grams) + size - 1, bool)
    for back in range(1, size):
        whole[ends - back] = False
    grams = grams[whole[: len(grams)]]
    counts = lengths - size + 1
    starts = np.cumsum(counts) - counts
    owners = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((grams, owners))
    grams, fresh = grams[order], np.ones(len(grams), np.uint32)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    sizes = np.add.reduceat(fresh, starts, dtype="<u4")
    values = band_values(grams, starts, bands, rows).astype("<i8").view(np.uint8).reshape(len(texts), bands, 8)
    signed = np.hstack([sizes.view(np.uint8).reshape(-1, 4), values[:, :, :VALUE].reshape(len(texts), -1)])
    return [row.tobytes() for row in signed]


def paragraphs(text: bytes, size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(line number, digest, words with one space between) of each paragraph."""
    for number, line in enumerate(text.split(b"\n")):
        words = alnum_words(line)
        if len(words) >= size:
            joined = b" ".join(words)
            yield number, hashlib.blake2b(joined, digest_size=16).digest(), joined


def _paragraph_batches(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed: dict[bytes, bytes] = {}
            waiting: dict[bytes, bytes] = {}
            columns: list[list] = [[] for _ in range(4)]

            def sign() -> None:
                signed.update(zip(waiting, signatures(list(waiting.values()), size, bands, rows) if waiting else ()))
                waiting.clear()

            held = 0
            for doc, digest, text in zip(batch["doc_id"].to_pylist(), batch["digest"].to_pylist(), utf8(batch["text"])):
                for number, key, words in paragraphs(text, size):
                    if key not in signed and key not in waiting:
                        waiting[key] = words
                        held += len(words)
                    for column, value in zip(columns, (doc, digest, number, key)):
                        column.append(value)
                    if held >= BLOCK:
                        sign()
                        held = 0
            sign()
            columns.append([signed[key] for key in columns[3]])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "digest", "line", "key", "sig"])

    return run


def _band_batches(bands: int) -> Callable:
    """One row per band of each distinct paragraph, with the number of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            signed = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(n, 4 + bands * VALUE)
            sizes = np.ascontiguousarray(signed[:, :4]).view("<u4").ravel().astype(np.int32)
            values = np.zeros((n * bands, 8), np.uint8)
            values[:, :VALUE] = signed[:, 4:].reshape(n * bands, VALUE)
            values[:, VALUE:] = np.tile(np.arange(bands, dtype="<u2"), n).view(np.uint8).reshape(-1, 2)
            places = np.repeat(np.arange(n), bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view("<i8").ravel()), batch["key"].take(pa.array(places)), pa.array(sizes[places])], ["bucket", "key", "size"]
            )

    return run


def _shingle_batches(size: int) -> Callable:
    """The shingle sets of the wanted paragraphs of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for wanted, text in zip(batch["keys"].to_pylist(), utf8(batch["text"])):
                left = set(wanted)
                for _, key, words in paragraphs(text, size):
                    if key in left:
                        left.discard(key)
                        keys.append(key)
                        sets.append(shingles(words, size).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "grams"])

    return run


def _jaccard_batches(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(shared >= least * (len(a) + len(b) - shared))
            yield batch.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return run


def _compare_block(least: float) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (k.as_py() for k in key[1:])
        keys, components, chunks = (table[n].to_pylist() for n in ("key", "component", "chunk"))
        sets = [np.frombuffer(g, "<u8") for g in table["grams"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        theirs = [i for i, c in enumerate(chunks) if c == high]
        grams = np.concatenate([sets[i] for i in theirs] or [np.zeros(0, "<u8")])
        owners = np.repeat(np.array(theirs, np.int64), sizes[theirs] if theirs else 0)
        order = np.argsort(grams, kind="stable")
        grams, owners = grams[order], owners[order]
        root = {c: c for c in components}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links: list[tuple] = []
        for x in (i for i, c in enumerate(chunks) if c == low):
            left, right = np.searchsorted(grams, sets[x], "left"), np.searchsorted(grams, sets[x], "right")
            counts = right - left
            at = np.repeat(left - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            shared = np.bincount(owners[at], minlength=len(sets))
            for y in np.flatnonzero((shared > 0) & (shared >= least * (sizes + sizes[x] - shared))).tolist():
                a, b = find(components[x]), find(components[y])
                if a != b:
                    root[a] = b
                    links.append((keys[x], keys[y]))
        return pa.table([pa.array([p[i] for p in links], pa.binary()) for i in (0, 1)], ["src", "dst"])

    return run


def near_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``node, component`` of the paragraphs that are linked; ``members`` is bucket, key, size, turn."""
    first = members.groupBy("bucket").agg(F.min(F.struct("turn", "key", "size")).alias("first"))
    # Sets whose sizes are too unlike cannot be similar, and are not fetched for each other.
    alike = F.least("size", "pivot_size") >= least * F.greatest("size", "pivot_size")
    pairs = (
        members.join(first.select("bucket", F.col("first.key").alias("pivot"), F.col("first.size").alias("pivot_size")), "bucket")
        .where((F.col("key") != F.col("pivot")) & alike)
        .select(F.least("key", "pivot").alias("src"), F.greatest("key", "pivot").alias("dst"))
        .distinct()
    )
    met = pairs.join(sets.select(F.col("key").alias("src"), F.col("grams").alias("x")), "src").join(
        sets.select(F.col("key").alias("dst"), F.col("grams").alias("y")), "dst"
    )
    near = materialize(met.select("src", "dst", "x", "y").mapInArrow(_jaccard_batches(least), "src binary, dst binary"))
    labels = connected_components(near)
    labelled = members.join(labels, members["key"] == labels["node"], "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    rest = labelled.join(mixed.where("low <> high").select("bucket", chunks.alias("chunks")), "bucket").join(sets, "key")
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    # Each block is met by each other one once.
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("other", "chunks")
    more = materialize(blocks.groupBy("bucket", "low", "high").applyInArrow(_compare_block(least), "src binary, dst binary"))
    return connected_components(near.unionByName(more))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for text, gone in zip(utf8(batch["text"]), batch["gone"].to_pylist()):
            drop = {g["line"]: g for g in gone or ()}
            lines = text.split(b"\n")
            kept = b"\n".join([x for i, x in enumerate(lines) if i not in drop])
            spelled = ",".join(f"{i}:{'' if g['first_id'] is None else g['first_id']}:{g['first_line']}" for i, g in sorted(drop.items()))
            for column, value in zip(rows, (len(lines), len(drop), spelled, hashlib.sha256(kept).hexdigest())):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(r, k) for r, k in zip(rows, kinds))], ["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"])


def dedup_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed, kept_sha256`` for every row of ``docs``.

    ``removed`` lists line:id:line of each removed paragraph and of the paragraph that
    stays for it.  Shorter lines are never removed.  A null text counts as empty, with
    one empty line.  A very long text is cut into its lines in one task; a very long line is one paragraph, whose
    shingles are hashed at once (about 40 bytes for one of its own).  Rows equal in id and text are one document and get the same
    result; a null id sorts first.  Other columns are not read; an empty table gives an
    empty result.
    """
    texts = id_text(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    found = texts.mapInArrow(_paragraph_batches(size, bands, rows), "doc_id bigint, digest bigint, line int, key binary, sig binary")
    place = F.struct("doc_id", "digest", "line")
    # One row per distinct paragraph and task moves; the signature goes with the first of them.
    firsts = found.groupBy("key").agg(F.min(F.struct(place.alias("place"), F.col("sig"))).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.select("key", "first.place", "first.sig", "n"))
    banded = firsts.select("key", "sig").mapInArrow(_band_batches(bands), "bucket bigint, key binary, size int")
    shared = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = sendable(shared, BROADCAST_BUCKETS, BROADCAST_BYTES)
    # Whoever meets most others is compared with them first.
    turn = -F.sum("n").over(Window.partitionBy("key"))
    members = materialize(banded.join(shared, "bucket").select("bucket", "key", "size", turn.alias("turn")))
    wanted = members.select("key").distinct().join(firsts, "key").groupBy("place.doc_id", "place.digest").agg(F.collect_list("key").alias("keys"))
    wanted = materialize(wanted.select(F.col("doc_id").alias("wanted_id"), F.col("digest").alias("wanted_digest"), "keys"))
    few = sendable(wanted, BROADCAST_DOCS, BROADCAST_BYTES)
    same = texts["doc_id"].eqNullSafe(few["wanted_id"]) & (texts["digest"] == few["wanted_digest"])
    sets = texts.join(few, same).select("text", "keys").mapInArrow(_shingle_batches(size), "key binary, grams binary")
    sets = materialize(sets.dropDuplicates(["key"]))
    labels = near_links(members, sets, least)
    classes = firsts.join(labels, firsts["key"] == labels["node"], "left").select("key", "place", "n", "component")
    heads = classes.where("component is not null").groupBy("component").agg(F.min("place").alias("head"))
    repeated = classes.join(heads, "component", "left").select("key", F.coalesce("head", "place").alias("head"), "n", "component").where("n > 1 or component is not null")
    repeated = materialize(repeated.select("key", "head"))
    lines = texts.mapInArrow(_line_batches(size), "doc_id bigint, digest bigint, line int, key binary")
    gone = (
        lines.join(repeated, "key")
        .where(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("digest") == F.col("head.digest")) & (F.col("line") == F.col("head.line"))))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
        .agg(F.collect_set(F.struct("line", F.col("head.doc_id").alias("first_id"), F.col("head.line").alias("first_line"))).alias("gone"))
    )
    met = texts["doc_id"].eqNullSafe(gone["gone_id"]) & (texts["digest"] == gone["gone_digest"])
    return texts.join(gone, met, "left").select("doc_id", "text", "gone").mapInArrow(
        _cut_batches, "doc_id bigint, n_lines bigint, n_removed bigint, removed string, kept_sha256 string"
    )


def _line_batches(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for doc, digest, text in zip(batch["doc_id"].to_pylist(), batch["digest"].to_pylist(), utf8(batch["text"])):
                for number, key, _ in paragraphs(text, size):
                    for column, value in zip(columns, (doc, digest, number, key)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "digest", "line", "key"])

    return run
