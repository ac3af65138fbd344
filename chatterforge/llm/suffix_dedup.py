"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a ``WIDTH``-byte string that covers it also starts earlier (in a smaller
document, or earlier in the same one).

*Which texts.*  Of texts that are equal as a whole only the earliest is looked at: every
window of a later one starts earlier in it, so all of the later one goes.

*Which suffixes.*  Each window of ``WIDTH`` bytes is represented by its anchor: the
place of the smallest hash among its ``GRAM``-byte strings, leftmost on ties.  Equal windows have
their anchors at the same offset, so two windows are equal if and only if the
suffixes at their anchors agree to the right far enough and the bytes before them agree too.
Consecutive windows mostly share an anchor, which leaves about 3 suffixes per 100
bytes.  Suffixes whose first ``GRAM`` bytes occur once in the corpus leave at once.

*Sorting.*  Tasks sort the suffixes they hold, fold equal ones into the earliest, and
front-code the run: each key is the length of the prefix shared with the one before
and the rest.  Runs are exchanged by the hash of the first ``GRAM`` bytes, and combined by a
loser tree that carries the known common prefixes along: two heads are compared
by these lengths first, and byte by byte only beyond them.

*Deciding.*  In the merged order, suffixes that share at least ``WIDTH - o`` bytes are
neighbours.  For each offset o, those among them with the same o bytes before the
anchor are occurrences of one window; all but the earliest are repeats.

A ``GRAM``-byte string found more than ``HOT`` times is not gathered in one place: each
window around it becomes a suffix of its own, exchanged by the hash of all its bytes.
Equal ones are folded within a run first, so a group is never larger than the number of runs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterforge.llm.common import utf8

WIDTH = 100
GRAM = 32
#: Occurrences of a GRAM-byte string from which its windows are exchanged one by one.
HOT = 100_000
#: Suffixes of one run, about 400 bytes each in the worker.
RUN = 100_000
#: Text bytes looked at together.
CHUNK = 1 << 18
#: Shards for each shuffle partition.
SHARDS = 4

#: The key of rows without an id.
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(CHUNK + WIDTH + 1, _BASE, np.uint64)
    down = np.full(CHUNK + WIDTH + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _anchors_of(data: bytes, width: int, gram: int) -> tuple[np.ndarray, ...]:
    up, down = _powers()
    n = len(data)
    summed = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=summed[1:])
    m = n - gram + 1
    grams = _mixed((summed[gram:] - summed[:m]) * down[:m])
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    least = (grams & np.uint64(_MASK ^ 0xFFFFFF)) | np.arange(m, dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    at = anchor[first]
    return at, at - last, at - first, grams[at].view(np.int64)


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, least offset, largest offset, hash) of every anchor of a text.

    The offsets are those from the windows' starts to the anchor they share.
    """
    parts = [
        (at + start, low, high, gram_hash)
        for start in range(0, max(len(data) - width + 1, 0), CHUNK)
        for at, low, high, gram_hash in [_anchors_of(data[start : start + CHUNK + width - 1], width, gram)]
    ]
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchor_batches(width: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            for key, tag, text in zip(batch["key"].to_pylist(), batch["tag"].to_pylist(), utf8(batch["text"])):
                if (key, tag) == before:
                    continue
                before = key, tag
                at, low, high, gram_hash = anchors(text, width, gram)
                # Copies inside one document are met here already; only the hash and the place travel.
                places = (at << 16) | (low << 8) | high
                for column, values in zip(columns, (np.full(len(at), key), np.full(len(at), tag), gram_hash, places)):
                    column.append(values)
            if columns[0]:
                arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "tag", "gram", "place"])

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (8 * n - differ.bit_length()) >> 3


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared lengths, rest lengths and rests of sorted keys of at most 255 bytes."""
    shared, rests, before = bytearray(), [], b""
    for key in keys:
        n = common_prefix(before, key)
        shared.append(n)
        rests.append(key[n:])
        before = key
    return bytes(shared), bytes(map(len, rests)), b"".join(rests)


def front_decode(shared: bytes, lengths: bytes, rests: bytes) -> list[bytes]:
    keys, at, before = [], 0, b""
    for n, more in zip(shared, lengths):
        before = before[:n] + rests[at : at + more]
        at += more
        keys.append(before)
    return keys


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[int], list[int], list[int]]:
    """Merge front-coded sorted runs with a loser tree that knows common prefixes.

    Each run is its keys and, for each, the length shared with the one before.
    Gives for the merged order the run, the index in it, and the length shared with
    the key before.  Every node keeps the loser of its match with its prefix
    length in common with the winner; all contenders on a winner's path thus
    know their prefix in common with the last output, and equal lengths are compared from
    there on only.
    """
    size = 1
    while size < len(runs):
        size *= 2
    done = b""
    keys: list = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    heads = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known length becomes that with the winner."""
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = known[a]
        shared = n + common_prefix(x[n:], y[n:])
        if x[shared:] < y[shared:] or (shared == len(x) == len(y) and a < b):
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        nexts = []
        for i in range(level):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = loser
            nexts.append(w)
        winners = nexts
    w = winners[0]
    out_run, out_index, out_shared = [], [], []
    while keys[w] is not None:
        out_run.append(w)
        out_index.append(heads[w])
        out_shared.append(known[w])
        done = runs[w]
        heads[w] += 1
        if heads[w] < len(done[0]):
            keys[w], known[w] = done[0][heads[w]], done[1][heads[w]]
        else:
            keys[w] = None
        node = (size + w) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1
    return out_run, out_index, out_shared


#: Columns of a front-coded run: for each suffix its document (id, tag), place, offset range
#: and the bytes before its anchor; all packed.
_RUN_SCHEMA = (
    "shard int, shared binary, lengths binary, rests binary, low binary, high binary, befores binary, "
    "ids binary, tags binary, places binary, key bigint, tag bigint, start bigint, stop bigint"
)
_RUN_FIELDS = pa.schema(
    [
        ("shard", pa.int32()),
        *((n, pa.binary()) for n in ("shared", "lengths", "rests", "low", "high", "befores", "ids", "tags", "places")),
        *((n, pa.int64()) for n in ("key", "tag", "start", "stop")),
    ]
)


def fold_run(suffixes: list[tuple], width: int) -> tuple[list[tuple], list[tuple]]:
    """Sort suffixes and keep the earliest of equal ones; the windows of the others are repeats."""
    suffixes.sort()
    kept, repeats, before = [], [], None
    for s in suffixes:
        if before is not None and s[:5] == before[:5]:
            repeats.append((s[5], s[6], s[7] - s[4], s[7] - s[3] + width))
        else:
            kept.append(s)
            before = s
    return kept, repeats


def joined_ranges(ranges: list[tuple]) -> list[tuple]:
    """(id, tag, start, stop) ranges, those that touch within a document made one."""
    joined: list[tuple] = []
    for k, t, b, e in sorted(ranges):
        if joined and joined[-1][:2] == (k, t) and b <= joined[-1][3]:
            joined[-1] = (k, t, joined[-1][2], max(e, joined[-1][3]))
        else:
            joined.append((k, t, b, e))
    return joined


def pack_run(suffixes: list[tuple], width: int) -> pa.RecordBatch:
    """Front-coded blocks of one run, one per shard, and the repeats found inside the run."""
    kept, repeats = fold_run(suffixes, width)
    rows = []
    for shard, group in groupby(kept, key=lambda s: s[0]):
        part = list(group)
        shared, lengths, rests = front_code([s[1] for s in part])
        rows.append(
            {
                "shard": shard,
                "shared": shared,
                "lengths": lengths,
                "rests": zlib.compress(rests, 1),
                "low": bytes(s[3] for s in part),
                "high": bytes(s[4] for s in part),
                "befores": zlib.compress(b"".join(s[2] for s in part), 1),
                "ids": np.array([s[5] for s in part], "<i8").tobytes(),
                "tags": np.array([s[6] for s in part], "<i8").tobytes(),
                "places": np.array([s[7] for s in part], "<i8").tobytes(),
            }
        )
    rows += [{"key": k, "tag": t, "start": b, "stop": e} for k, t, b, e in joined_ranges(repeats)]
    return pa.RecordBatch.from_pylist(rows, _RUN_FIELDS)


def _run_batches(width: int, shards: int) -> Callable:
    """A suffix is (shard, key, bytes before, low, high, id, tag, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes: list[tuple] = []
        before = None
        for batch in batches:
            for key, tag, text, found in zip(
                batch["key"].to_pylist(), batch["tag"].to_pylist(), utf8(batch["text"]), batch["found"].to_pylist()
            ):
                if (key, tag) == before:
                    continue
                before = key, tag
                for f in found:
                    if f["tag"] != tag:
                        continue
                    at, low, high = f["place"] >> 16, f["place"] >> 8 & 255, f["place"] & 255
                    if f["hot"]:
                        for p in range(at - high, at - low + 1):
                            window = text[p : p + width]
                            shard = int.from_bytes(hashlib.blake2b(window, digest_size=4).digest(), "big") % shards
                            suffixes.append((shard, window, b"", 0, 0, key, tag, p))
                    else:
                        suffixes.append((f["shard"], text[at : at - low + width], text[at - high : at], low, high, key, tag, at))
                if len(suffixes) >= RUN:
                    yield pack_run(suffixes, width)
                    suffixes = []
        if suffixes:
            yield pack_run(suffixes, width)

    return run


def repeated_windows(shared: np.ndarray, low: np.ndarray, high: np.ndarray, befores: list[bytes], rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest offset of the repeated windows of each suffix; -1 where there are none.

    ``shared`` are the lengths in common in sorted order, ``rank`` the order of the places.
    """
    n, depth = len(shared), int(high.max(initial=0))
    before = np.zeros((n, depth), np.uint8)
    for i, b in enumerate(befores):
        before[i, depth - len(b) :] = np.frombuffer(b, np.uint8)
    weights = np.array([pow(_BASE, i, 1 << 64) for i in range(1, depth + 1)], np.uint64)
    hashes = np.zeros((n, depth + 1), np.uint64)
    np.cumsum((before[:, ::-1].astype(np.uint64) + np.uint64(1)) * weights, axis=1, out=hashes[:, 1:])
    least, largest = np.full(n, -1), np.full(n, -1)
    for o in range(depth + 1):
        chosen = np.flatnonzero((low <= o) & (o <= high))
        if len(chosen) < 2:
            continue
        group = np.cumsum(shared < width - o)[chosen]
        order = np.lexsort((rank[chosen], hashes[chosen, o], group))
        group, left, chosen = group[order], hashes[chosen, o][order], chosen[order]
        same = np.concatenate([[False], (group[1:] == group[:-1]) & (left[1:] == left[:-1])])
        # The first of each group, to compare the bytes behind the hashes with.
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(chosen))))
        later = np.flatnonzero(same)
        x, y = chosen[later], chosen[first[later]]
        x = x[(before[x, depth - o :] == before[y, depth - o :]).all(1)]
        largest[x] = o
        least[x] = np.where(least[x] < 0, o, least[x])
    return least, largest


def merged_shard(blocks: list[dict], width: int) -> pa.RecordBatch:
    """The repeated byte ranges that the runs of one shard show together."""
    runs, columns = [], {n: [] for n in ("low", "high", "ids", "tags", "places")}
    befores, offsets = [], [0]
    for b in blocks:
        runs.append((front_decode(b["shared"], b["lengths"], zlib.decompress(b["rests"])), b["shared"]))
        before = zlib.decompress(b["befores"])
        high = np.frombuffer(b["high"], np.uint8).astype(np.int64)
        columns["low"].append(np.frombuffer(b["low"], np.uint8).astype(np.int64))
        columns["high"].append(high)
        for name in ("ids", "tags", "places"):
            columns[name].append(np.frombuffer(b[name], "<i8"))
        ends = np.cumsum(high)
        befores += [before[s:e] for s, e in zip((ends - high).tolist(), ends.tolist())]
        offsets.append(offsets[-1] + len(high))
    run, index, shared = merge_runs(runs)
    order = np.array(offsets)[run] + np.array(index)
    low, high, ids, tags, places = (np.concatenate(columns[n])[order] for n in columns)
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((places, tags, ids))] = np.arange(len(order))
    least, largest = repeated_windows(np.array(shared), low, high, [befores[i] for i in order.tolist()], rank, width)
    x = np.flatnonzero(largest >= 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(v) for v in (ids[x], tags[x], places[x] - largest[x], places[x] - least[x] + width)], ["key", "tag", "start", "stop"]
    )


def _merge_batches(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks = None, []
        for batch in batches:
            found = batch.filter(pa.compute.is_null(batch["shard"])).select(["key", "tag", "start", "stop"])
            if found.num_rows:
                yield found
            for row in batch.filter(pa.compute.is_valid(batch["shard"])).to_pylist():
                if row["shard"] != shard and blocks:
                    yield merged_shard(blocks, width)
                    blocks = []
                shard = row["shard"]
                blocks.append(row)
        if blocks:
            yield merged_shard(blocks, width)

    return run


def _cut_batches(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for tag, text, first, found in zip(*(batch[n].to_pylist() for n in ("tag", "text", "first", "found"))):
                text = text.encode()
                spans = joined_ranges([(0, 0, f["start"], f["stop"]) for f in found or () if f["tag"] == tag])
                if not first:
                    spans = [(0, 0, 0, len(text))] if len(text) >= width else []
                kept, at = [], 0
                for _, _, start, stop in spans:
                    kept.append(text[at:start])
                    at = stop
                left = b"".join([*kept, text[at:]])
                flat = [x for s in spans for x in s[2:]]
                for column, value in zip(rows, (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), flat)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(r, k) for r, k in zip(rows, kinds))], _RESULT)

    return run


_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """Per row of ``docs``: bytes, bytes removed, maximal removed runs, digest of the rest, and the runs.

    ``removed`` holds start, stop, start, stop ... in bytes.  Null texts count as empty.
    Rows equal in id and text are one document, and each gets its result; rows
    that repeat an id with another text follow in the order of their digests.  A null
    id sorts before all others, and the least id that 64 bits hold counts as null.  A very long text is one row that is read whole; its suffixes are
    dealt to shards like those of others.  Other columns are not read; an empty table gives
    an empty result.  ``width`` is at most 255 and larger than ``gram``.
    """
    if not 1 < gram < width <= 255:
        raise ValueError("need 1 < gram < width <= 255")
    spark = docs.sparkSession
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A document is an id and a digest, so that many texts under one id, or without any, are dealt like others.
    document = ["key", "tag"]
    named = named.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("tag"), "text")
    # One exchange of the texts, by document, serves all readings, as each needs the same columns.
    texts = named.repartition(*document)
    earliest = texts.groupBy(F.md5("text").alias("digest")).agg(F.min(F.struct(*document)).alias("e"))
    earliest = earliest.select("e.key", "e.tag", F.lit(True).alias("first")).distinct()
    texts = texts.join(earliest, document, "left").withColumn("first", F.coalesce("first", F.lit(False)))
    # Rows that are one document stand side by side, so that one of them is searched; all get the result.
    searched = texts.where("first").sortWithinPartitions(*document)
    placed = searched.select("key", "tag", "text").mapInArrow(_anchor_batches(width, gram), "key bigint, tag bigint, gram bigint, place bigint")
    counted = placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("n > 1")
    found = counted.groupBy(*document).agg(
        F.collect_list(
            F.struct(F.col("tag"), "place", F.pmod("gram", F.lit(shards)).cast("int").alias("shard"), (F.col("n") > hot).alias("hot"))
        ).alias("found")
    )
    runs = texts.where("first").join(found, document).sortWithinPartitions(*document).select("key", "tag", "text", "found").mapInArrow(_run_batches(width, shards), _RUN_SCHEMA)
    by_shard = F.coalesce("shard", F.pmod(F.hash("key", "start"), F.lit(shards)))
    dealt = runs.repartition(by_shard).sortWithinPartitions("shard")
    ranges = dealt.mapInArrow(_merge_batches(width), "key bigint, tag bigint, start bigint, stop bigint")
    gathered = ranges.groupBy(*document).agg(F.collect_list(F.struct("tag", "start", "stop")).alias("found"))
    own_id = F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")
    return texts.join(gathered, document, "left").select(own_id, "tag", "text", "first", "found").mapInArrow(
        _cut_batches(width), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>"
    )
