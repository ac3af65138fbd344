"""The elements of JSON arrays in files of any size, which are split where they are read.

Spark reads the text between quotation marks as rows, so a file is split at any of them and no row is longer than a
string of the file or what stands between two.  Whether a row is inside a string, and how deeply it is nested,
depends on all rows before it.  A first pass over the stretches of the files (what Spark reads as one) takes from each how
many quotation marks and how much depth it adds, for both ways in which it may begin.  From these few numbers
follow the states at all borders, and a second pass cuts the stretches at the commas of the array.  An element within a
stretch is complete; pieces of those that cross borders are joined, and only these are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterforge.runtime import materialize

BOM = "﻿"
#: Stretches whose states are sent to all tasks; with more, rows are dealt out by stretch.
SENT = 100_000
_SIDE = "struct<depth:bigint,low:bigint,opens:array<struct<row:bigint,depth:bigint,low:bigint>>>"
_EDGES = f"file string, block bigint, flips boolean, even {_SIDE}, odd {_SIDE}, head string, tail string"
_PIECES = "file string, block bigint, n bigint, whole boolean, text string"


def _rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, value``: what stands between quotation marks, in the order of the file."""
    raw = spark.read.option("lineSep", '"').text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, block, batch) of rows that belong to one stretch."""
    for batch in batches:
        blocks, files = batch["block"].to_numpy(), batch["file"]
        changes = np.flatnonzero((blocks[1:] != blocks[:-1]) | ~np.asarray(pc.equal(files[1:], files[:-1]))) + 1
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(blocks)]):
            yield files[a].as_py(), int(blocks[a]), batch.slice(a, b - a)


def _real_quotes(values: pa.Array) -> np.ndarray:
    """Whether the quotation mark after each row is one, or part of a string because an odd number of backslashes precedes it."""
    real = np.ones(len(values), bool)
    ends = np.flatnonzero(np.asarray(pc.ends_with(values, "\\")))
    if len(ends):
        real[ends] = ~np.asarray(pc.match_substring_regex(values.take(pa.array(ends)), r"(^|[^\\])(\\\\)*\\$"))
    return real


def _depths(values: pa.Array) -> np.ndarray:
    ups = np.asarray(pc.count_substring(values, "{")) + np.asarray(pc.count_substring(values, "["))
    return (ups - np.asarray(pc.count_substring(values, "}")) - np.asarray(pc.count_substring(values, "]"))).astype(np.int64)


#: The array of an object stands under this key, at depth 1.
KEY = "messages"


class _Edge:
    """What a stretch adds, for either way to begin: outside of strings or inside.

    A side has the depth that the stretch adds, the lowest depth after a row, and the rows where an array of the
    wanted key opens, each with the depth there and the lowest one from there on.
    """

    def __init__(self, file: str, block: int):
        self.file, self.block, self.odd, self.rows, self.head, self.tail = file, block, 0, 0, None, None
        self.sides = [{"depth": 0, "low": 0, "opens": []} for _ in range(2)]

    def add(self, values: pa.Array) -> None:
        if self.head is None:
            self.head = re.sub(rf"[\s{BOM}]+", "", (values[0].as_py() or "")[:4096])[:64]
        real = _real_quotes(values)
        inside = (self.odd + np.cumsum(real) - real) % 2
        own = _depths(values)
        # A key and the array that it opens: the row before is the key, this one a colon and a bracket.
        opens = np.flatnonzero(np.asarray(pc.match_substring_regex(values, r"^\s*:\s*\[")))
        named = [i for i in opens.tolist() if (values[i - 1].as_py() if i else self.tail) == KEY]
        for start, side in enumerate(self.sides):
            outside = (inside + start) % 2 == 0
            after = side["depth"] + np.cumsum(own * outside)
            for o in side["opens"]:
                o["low"] = min(o["low"], int(after.min()))
            for i in named:
                if outside[i]:
                    side["opens"].append({"row": self.rows + i, "depth": int(after[i] - own[i]), "low": int(after[i:].min())})
            side["low"] = min(side["low"] if self.rows else int(after[0]), int(after.min()))
            side["depth"] = int(after[-1])
        self.odd = (self.odd + int(real.sum())) % 2
        self.rows += len(values)
        last = values[-1].as_py() or ""
        self.tail = last if len(last) <= 64 else ""

    def row(self) -> dict:
        return {"file": self.file, "block": self.block, "flips": self.odd == 1, "even": self.sides[0], "odd": self.sides[1], "head": self.head, "tail": self.tail}


_SIDE_FIELDS = pa.struct([("depth", pa.int64()), ("low", pa.int64()), ("opens", pa.list_(pa.struct([("row", pa.int64()), ("depth", pa.int64()), ("low", pa.int64())])))])
_EDGE_FIELDS = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("flips", pa.bool_()), ("even", _SIDE_FIELDS), ("odd", _SIDE_FIELDS), ("head", pa.string()), ("tail", pa.string())]
)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edge = None
    for file, block, batch in _stretches(batches):
        if edge is None or (edge.file, edge.block) != (file, block):
            if edge is not None:
                yield pa.RecordBatch.from_pylist([edge.row()], _EDGE_FIELDS)
            edge = _Edge(file, block)
        edge.add(batch["value"])
    if edge is not None:
        yield pa.RecordBatch.from_pylist([edge.row()], _EDGE_FIELDS)


def _states(edges: DataFrame) -> DataFrame:
    """How each stretch begins: ``inside`` a string, ``depth``, ``closed`` (the array has ended); and of its file the array's ``base`` depth, where it opens, whether all closes."""
    whole = Window.partitionBy("file")
    order = whole.orderBy("block")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    known = edges.withColumn("inside", F.coalesce(F.sum(F.col("flips").cast("int")).over(above), F.lit(0)) % 2 == 1)
    known = known.withColumn("side", F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")))
    known = known.withColumn("depth", F.coalesce(F.sum("side.depth").over(above), F.lit(0)))
    is_list = F.min_by("head", "block").over(whole).startswith("[")
    known = known.withColumn("base", F.when(is_list, 1).otherwise(2))
    outer = F.filter("side.opens", lambda o: F.col("depth") + o["depth"] == 1)
    found = F.when(F.size(outer) > 0, F.array_min(F.transform(outer, lambda o: F.struct(o["row"].alias("row"), o["low"].alias("low")))))
    # A key whose bracket comes first in the next stretch: the row before that is the key.
    crossing = (F.lag("tail").over(order) == KEY) & ~F.col("inside") & (F.col("depth") == 1) & F.col("head").startswith(":[")
    zero = F.lit(0).cast("bigint")
    opens = F.when(is_list, F.when(F.col("block") == 0, F.struct(zero.alias("row"), zero.alias("low"))))
    opens = opens.when(crossing, F.struct(zero.alias("row"), F.col("side.low").alias("low"))).otherwise(found)
    known = known.withColumn("opens", F.when(opens.isNotNull(), F.struct("block", opens["row"].alias("row"), opens["low"].alias("low"))))
    known = known.withColumn("open", F.min("opens").over(whole))
    low = F.when(F.col("block") == F.col("open.block"), F.col("open.low")).when(F.col("block") > F.col("open.block"), F.col("side.low"))
    # The array of an object is followed by a key or the object's end, so a row ends below its depth.
    known = known.withColumn("end", F.min(F.when((F.col("base") == 2) & (F.col("depth") + low < 2), F.col("block"))).over(whole))
    balanced = (F.sum("side.depth").over(whole) == 0) & (F.sum(F.col("flips").cast("int")).over(whole) % 2 == 1)
    return known.select(
        "file", "block", "inside", "depth", F.coalesce(F.col("block") > F.col("end"), F.lit(False)).alias("closed"), "base",
        F.col("open.block").alias("open_block"), F.col("open.row").alias("open_row"), balanced.alias("balanced"),
    )


class _Cutter:
    """Cuts one stretch.  ``n`` counts the commas of the array so far; -1 is what stands before the array, -2 after it."""

    def __init__(self, file: str, state: dict):
        self.file, self.state = file, state
        self.inside, self.depth, self.base = state["inside"], state["depth"], state["base"]
        self.rows, self.n, self.parts, self.whole = 0, 0, [], False
        self.opened = state["open_block"] is not None and state["block"] > state["open_block"]
        self.closed = state["closed"] or (self.opened and self.depth < self.base)
        self.out: list[dict] = []

    def _emit(self, n: int, whole: bool) -> None:
        if self.parts:
            self.out.append({"file": self.file, "block": self.state["block"], "n": n, "whole": whole, "text": "".join(self.parts)})
        self.parts = []

    def _number(self) -> int:
        return -2 if self.closed else self.n if self.opened else -1

    def add(self, values: pa.Array, first_of_file: bool) -> None:
        real = _real_quotes(values)
        inside = (int(self.inside) + np.cumsum(real) - real) % 2
        own = _depths(values) * (inside == 0)
        depth = self.depth + np.cumsum(own) - own
        texts = values.to_pylist()
        # Only rows outside of strings that reach the level of the array can hold its commas and brackets.
        lowest = np.asarray(pc.count_substring_regex(values, r"[}\]]"))
        near = np.flatnonzero((inside == 0) & (depth - lowest <= self.base))
        done = 0
        for i in near.tolist():
            self._plain(texts, done, i, first_of_file)
            self._outside(texts[i], int(depth[i]), self.rows + i, first_of_file and i == 0)
            done = i + 1
        self._plain(texts, done, len(texts), first_of_file)
        self.rows += len(texts)
        self.depth += int(own.sum())
        self.inside = bool((int(self.inside) + int(real.sum())) % 2)

    def _plain(self, texts: list[str], a: int, b: int, first_of_file: bool) -> None:
        if a < b:
            self.parts.append(('' if first_of_file and a == 0 else '"') + '"'.join(texts[a:b]))

    def _outside(self, text: str, depth: int, row: int, first: bool) -> None:
        start = 0
        if not first:
            self.parts.append('"')
        else:
            text = text.removeprefix(BOM)
        opens = not self.opened and self.state["open_block"] == self.state["block"] and self.state["open_row"] == row
        for at, c in enumerate(text):
            if c in "[{":
                depth += 1
                if opens and c == "[" and depth == self.base:
                    self.parts.append(text[start : at + 1])
                    self._emit(-1, False)
                    start, self.opened, self.whole, opens = at + 1, True, True, False
            elif c in "]}":
                depth -= 1
                if self.opened and not self.closed and depth < self.base:
                    self.parts.append(text[start:at])
                    self._emit(self.n, self.whole)
                    start, self.closed = at, True
            elif c == "," and depth == self.base and self.opened and not self.closed:
                self.parts.append(text[start:at])
                self._emit(self.n, self.whole)
                start, self.n, self.whole = at + 1, self.n + 1, True
        self.parts.append(text[start:])

    def end(self) -> list[dict]:
        """The piece that goes on in the next stretch, and how many commas there were."""
        self._emit(self._number(), False)
        self.out.append({"file": self.file, "block": self.state["block"], "n": self.n, "whole": None, "text": None})
        return self.out


_PIECE_FIELDS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for file, block, batch in _stretches(batches):
        fresh = cutter is None or (cutter.file, cutter.state["block"]) != (file, block)
        if fresh:
            if cutter is not None:
                yield pa.RecordBatch.from_pylist(cutter.end(), _PIECE_FIELDS)
            cutter = _Cutter(file, {k: batch[k][0].as_py() for k in ("block", "inside", "depth", "closed", "base", "open_block", "open_row")})
        cutter.add(batch["value"], fresh and block == 0)
        yield pa.RecordBatch.from_pylist(cutter.out, _PIECE_FIELDS)
        cutter.out = []
    if cutter is not None:
        yield pa.RecordBatch.from_pylist(cutter.end(), _PIECE_FIELDS)


def read_elements(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(``file, pos, json`` of the array's elements, ``file, json`` of what stands around the array).

    A file is a JSON array, or an object with an array under ``messages``; the object's other members are what
    stands around.  An error names the first file that is neither, or whose brackets and strings do not close.
    """
    rows = _rows(spark, path)
    states = materialize(_states(rows.mapInArrow(_edges, _EDGES)))
    bad = states.where("not balanced or open_block is null").select("file").distinct().orderBy("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: expected a list of messages, or an object that holds one")
    met = states.drop("balanced").withColumnsRenamed({"file": "__file", "block": "__block"})
    same = (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))
    few = states.count() <= SENT
    if few:
        placed = rows.join(F.broadcast(met), same)
    else:
        # Dealt out by stretch, each of which is read by one task either way.
        numbered = rows.withColumn("__at", F.monotonically_increasing_id())
        placed = numbered.join(met, same).repartition("file", "block").sortWithinPartitions("file", "block", "__at")
    pieces = materialize(placed.select("file", "block", "value", "inside", "depth", "closed", "base", "open_block", "open_row").mapInArrow(_cut, _PIECES))
    above = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    commas = pieces.where("text is null").select(F.col("file").alias("__file"), F.col("block").alias("__block"), "n")
    offsets = commas.select("__file", "__block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__offset"))
    offsets = F.broadcast(offsets) if few else offsets
    numbered = pieces.where("text is not null and n >= 0").join(offsets, same).withColumn("pos", F.col("n") + F.col("__offset"))
    bare = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    complete = numbered.where("whole").select("file", "pos", bare(F.col("text")).alias("json"))
    parts = numbered.where("not whole").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "whole", "text"))).alias("parts"))
    joined = parts.select("file", "pos", bare(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("json"))
    around = pieces.where("n < 0").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", F.abs("n").alias("n"), "text"))).alias("parts"))
    around = around.select("file", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("json"))
    return complete.unionByName(joined).where("json <> ''"), around
