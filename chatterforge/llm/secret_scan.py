"""Secret scan by a trigram inverted index.

From each rule's pattern follows a Boolean query over trigrams: a disjunction of conjunctions of trigrams, one of which
every match must hold.  The index is a table of postings for each shard of documents.  The queries are answered by
uniting and intersecting postings, and only texts that an answer names are searched with the pattern
itself.  A rule from whose pattern no trigram follows is searched for in every text.

Trigrams are taken from UTF-8 bytes with A-Z lower-cased.  Texts are known by a 128-bit digest, so that equal texts are
verified alike wherever they stand.  Texts do not move: a shard is what one task reads, candidates
are sent to the texts where their size is bounded, and found places are joined by digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as ops
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.common import LOWER_TABLE, sendable, utf8
from chatterforge.runtime import delete_folder, materialize, scratch_folder


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters; others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(pattern: str) -> str:
    """Each ASCII letter of a pattern as a class of both its cases."""
    return re.sub(r"[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", pattern)


# The base kinds.  A run of at least 32 hexadecimal digits is what
# "runs of hexadecimal digits, of which those of 32 and more count" finds.
BASE = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Public formats of credentials.
ADDED = (
    Rule("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]+", 0, 40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", f"{either_case('bearer')}" + r"\x20[A-Za-z0-9._~+/-]+", 0, 27),
    Rule("url_login", r"(https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)
RULES = BASE + ADDED

# --- Boolean queries -------------------------------------------------------

#: A query is a set of sets of trigrams: a match holds all trigrams of one of them.  This one asks for nothing.
ANYTHING = frozenset([frozenset()])
#: Strings that a stretch of a pattern may stand for, characters of a class that are told apart, alternatives of a query.
#: Beyond these, the query asks for less, which is weaker but still right.
MOST_STRINGS, MOST_CLASS, MOST_ALTERNATIVES = 256, 8, 256


def trigrams(text: bytes) -> frozenset[int]:
    folded = text.translate(LOWER_TABLE)
    return frozenset(a << 16 | b << 8 | c for a, b, c in zip(folded, folded[1:], folded[2:]))


def least_sets(sets: Iterable[frozenset[int]]) -> frozenset[frozenset[int]]:
    """Without alternatives that ask for all that another one asks for, and more."""
    kept: list[frozenset[int]] = []
    for s in sorted(set(sets), key=len):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept)


def either(a: frozenset, b: frozenset) -> frozenset:
    found = least_sets([*a, *b])
    return found if len(found) <= MOST_ALTERNATIVES else ANYTHING


def both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return min(a, b, key=len)
    return least_sets(x | y for x in a for y in b)


def of_strings(strings: frozenset[bytes]) -> frozenset:
    return least_sets(trigrams(s) for s in strings)


def _characters(items: list) -> frozenset[bytes] | None:
    """The characters of a class, or None for a class of many or all others."""
    found: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            found.add(chr(value))
        elif op is ops.RANGE and value[1] - value[0] < MOST_CLASS:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    folded = frozenset(c.encode().translate(LOWER_TABLE) for c in found)
    return folded if len(folded) <= MOST_CLASS else None


def _of(node: tuple) -> tuple[frozenset[bytes] | None, frozenset]:
    """(all strings that the node matches, lower-cased, or None; what any match asks for)."""
    op, value = node
    if op is ops.LITERAL:
        return frozenset([chr(value).encode().translate(LOWER_TABLE)]), ANYTHING
    if op is ops.IN:
        return _characters(value), ANYTHING
    if op is ops.SUBPATTERN:
        if value[1] & re.IGNORECASE:
            raise ValueError("spell a rule without flags, with either_case for letters of both cases")
        return _of_sequence(value[3])
    if op is ops.BRANCH:
        strings, query = frozenset(), None
        for branch in value[1]:
            found, asked = _of_sequence(branch)
            strings = strings | found if strings is not None and found is not None and len(strings | found) <= MOST_STRINGS else None
            query = asked if query is None else either(query, asked)
        return strings, query
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        found, asked = _of_sequence(inner)
        if most == 1 and found is not None:
            return found | {b""}, ANYTHING
        return None, asked if least else ANYTHING
    if op is ops.AT:
        return frozenset([b""]), ANYTHING
    return None, ANYTHING


def _of_sequence(nodes: Iterable[tuple]) -> tuple[frozenset[bytes] | None, frozenset]:
    run, whole, query = frozenset([b""]), True, ANYTHING
    for node in nodes:
        strings, asked = _of(node)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query, whole = both(both(query, of_strings(run)), asked), False
        run = frozenset([b""]) if strings is None else strings
    return (run, both(query, of_strings(run))) if whole else (None, both(query, of_strings(run)))


@lru_cache(maxsize=256)
def query_of(pattern: str) -> frozenset:
    """The trigrams that a match of a pattern must hold; ``ANYTHING`` where none follow.

    Patterns whose flags change what a letter means are refused.
    """
    tree = parser.parse(pattern)
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        raise ValueError("spell a rule without flags, with either_case for letters of both cases")
    return _of_sequence(tree)[1]


# --- The index -------------------------------------------------------------

#: Pairs of document and trigram, and documents, that a shard holds at most (but for its last document).
SHARD_PAIRS, SHARD_DOCS = 1 << 21, (1 << 16) - 1
#: Bytes of a long text that are looked at together.
STRETCH = 1 << 22
#: The row of a shard that holds the digests of its documents.
DIRECTORY = -1
INDEX = "shard bigint, trigram int, docs binary"


def distinct_trigrams(text: bytes) -> np.ndarray:
    """The distinct trigrams of a text of any length, in order."""
    found = [np.empty(0, np.int32)]
    for start in range(0, max(len(text) - 2, 0), STRETCH):
        b = np.frombuffer(text[start : start + STRETCH + 2].translate(LOWER_TABLE), np.uint8).astype(np.int32)
        found.append(np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]))
    return found[1] if len(found) == 2 else np.unique(np.concatenate(found))


def shard_rows(shard: int, of_docs: list[np.ndarray], digests: list[bytes]) -> pa.RecordBatch:
    """A row for each trigram with the numbers of its documents, as gaps of 16 bits; first the directory."""
    keys = np.concatenate([(t.astype(np.int64) << 16) | i for i, t in enumerate(of_docs)])
    keys.sort()
    trigram, doc = (keys >> 16).astype(np.int32), (keys & 0xFFFF).astype(np.int32)
    starts = np.flatnonzero(np.diff(trigram, prepend=-2))
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    ends = 2 * np.append(starts, len(doc)).astype(np.int64)
    lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(gaps.astype(np.uint16))])
    docs = pa.concat_arrays([pa.array([b"".join(digests)], pa.binary()), lists.cast(pa.binary())])
    names = pa.array(np.append(np.int32(DIRECTORY), trigram[starts]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), shard)), names, docs], ["shard", "trigram", "docs"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, pairs = TaskContext.get().partitionId() << 32, 0
    of_docs, digests = [], []
    for batch in batches:
        for text, digest in zip(utf8(batch["text"]), batch["digest"].to_pylist()):
            of_docs.append(distinct_trigrams(text))
            digests.append(digest)
            pairs += len(of_docs[-1])
            if pairs >= SHARD_PAIRS or len(digests) >= SHARD_DOCS:
                yield shard_rows(shard, of_docs, digests)
                shard, pairs, of_docs, digests = shard + 1, 0, [], []
    if digests:
        yield shard_rows(shard, of_docs, digests)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(text.alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def build_index(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Write the index of all texts, each trigram of each, to a folder; rows of a file are ordered by shard and trigram.

    It answers queries of any rules, later ones too.
    """
    _keyed(docs, text_col).mapInArrow(_index, INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def _places(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, np.uint16), dtype=np.int64)


def answer(query: frozenset, postings: dict[int, np.ndarray]) -> np.ndarray:
    """The documents of a shard that hold all trigrams of one of the query's alternatives."""
    found = [np.empty(0, np.int64)]
    for wanted in query:
        lists = sorted((postings.get(t, found[0]) for t in wanted), key=len)
        some = lists[0]
        for other in lists[1:]:
            if not len(some):
                break
            some = np.intersect1d(some, other, assume_unique=True)
        found.append(some)
    return np.unique(np.concatenate(found))


def _answers(queries: list[tuple[int, frozenset]]):
    def run(rows: pa.Table) -> pa.Table:
        by_trigram = dict(zip(rows["trigram"].to_pylist(), rows["docs"].to_pylist()))
        directory = by_trigram.pop(DIRECTORY)
        postings = {t: _places(g) for t, g in by_trigram.items()}
        asked: dict[bytes, list[int]] = {}
        for number, query in queries:
            for i in answer(query, postings).tolist():
                named = asked.setdefault(directory[16 * i : 16 * i + 16], [])
                if number not in named:
                    named.append(number)
        return pa.table({"digest": pa.array(list(asked), pa.binary()), "rules": pa.array(list(asked.values()), pa.list_(pa.int32()))})

    return run


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``digest, rules``: the texts that may hold matches, with the numbers of the rules.  Rules that ask for nothing are not among them."""
    queries = [(i, query_of(r.pattern)) for i, r in enumerate(rules)]
    queries = [(i, q) for i, q in queries if q != ANYTHING]
    wanted = sorted({t for _, q in queries for s in q for t in s})
    if not wanted:
        return index.sparkSession.createDataFrame([], "digest binary, rules array<int>")
    rows = index.where(F.col("trigram").isin([DIRECTORY, *wanted]))
    named = rows.groupBy("shard").applyInArrow(_answers(queries), "digest binary, rules array<int>")
    # Equal texts have equal rules in every shard.
    return named.groupBy("digest").agg(F.first("rules").alias("rules"))


# --- Verification ----------------------------------------------------------


def places(rule: Rule, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _verify(rules: tuple[Rule, ...], everywhere: list[int], keep: list[str]):
    """Places of the rules that a row names, or else of those that are searched for everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch["rules"].to_pylist() if "rules" in batch.schema.names else [everywhere] * batch.num_rows
            found = []
            for data, numbers in zip(utf8(batch["text"]), named):
                text = data.decode()
                found.append([{"start": s, "kind": i, "end": e} for i in numbers for s, e in places(rules[i], text)])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(found, _SPANS)], [*keep, "found"])

    return run


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    index: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, spans`` of every row: kind, start and end (code points, end exclusive) by start, then by the order of rules.

    Null and empty texts have no spans; very long ones are indexed in stretches that overlap and searched whole.
    Repeated rows and null ids are returned as they are, other columns are not read, and an empty
    table gives an empty result.  ``index`` may be one that :func:`build_index` made of a table that
    holds these texts; without it, one is made in the shared folder and deleted afterwards.
    """
    spark = docs.sparkSession
    folder = None
    if index is None:
        folder = scratch_folder(spark, "trigrams")
        index = build_index(docs, folder, text_col)
    keyed = _keyed(docs, text_col)
    some = sendable(materialize(candidates(index, rules)), 500_000)
    if folder is not None:
        delete_folder(spark, folder)
    everywhere = [i for i, r in enumerate(rules) if query_of(r.pattern) == ANYTHING]
    # Of equal texts each is verified where it stands, and one of the equal answers is kept.
    verified = keyed.join(some, "digest").mapInArrow(_verify(rules, [], ["digest"]), f"digest binary, found {SPANS}")
    verified = materialize(verified.where(F.size("found") > 0).groupBy("digest").agg(F.first("found").alias("more")))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    searched = rows.mapInArrow(_verify(rules, everywhere, ["doc_id", "digest"]), f"doc_id {kind}, digest binary, found {SPANS}")
    joined = searched.join(sendable(verified, 500_000), "digest", "left")
    spans = F.array_sort(F.concat("found", F.coalesce("more", F.array().cast(SPANS))))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    told = F.transform(spans, lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", told.alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
