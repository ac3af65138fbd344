"""Line dedup with a log-template tree, in DataFrame operations only.

*Parsing.*  Every line is cut into tokens at spaces; a token with a digit is a
variable field and becomes ``<*>``.  A line descends a tree of fixed depth: its
token count, then its first ``DEPTH`` tokens, name its leaf.

*Templates.*  Lines of a leaf that agree after masking are one form.  In a leaf
that holds several forms, a token stays in the template where more than half
of the leaf's forms have it at that place, else it becomes ``<*>`` too.  A template
counts when at least ``MIN_TOKENS`` of its tokens, and half of them, are fixed.

*Dropping.*  A template found in at least ``MIN_DOCS`` documents is dropped wherever
it occurs but for its first occurrence (smallest id, then line).  ``copies`` says
what else keeps a template: with ``NONE`` nothing does; with ``EXACT`` a document
whose whole text is that of the first holder keeps the lines that the first holder
keeps, and no others, so that equal texts stay equal.

Only hashes, ids and line numbers are shuffled for the counts.  The counts are
summed before they move, so a line that a third of all documents have is one
row per task.  Texts stay where they are read while the list of dropped lines is small
enough to be sent to them, and move once where it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.common import id_text, materialize, sendable

DEPTH = 2
MIN_DOCS = 3
MIN_TOKENS = 3
FIELD = "[^ ]*[0-9][^ ]*"
WILD = "<*>"
NONE, EXACT = "none", "exact"
#: Forms of a leaf that are looked at together in one row.
FEW_FORMS = 8
#: Rows of a table that is broadcast, if it has few enough bytes too; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def masked_line(line: Column) -> Column:
    """A line with its variable fields masked."""
    bare = F.trim(line)
    return F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, FIELD, WILD)).otherwise(bare)


def token_count(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def wild_count(masked: Column) -> Column:
    return ((F.length(masked) - F.length(F.replace(masked, F.lit(WILD), F.lit("")))) / len(WILD)).cast("int")


def counts(n: Column, n_fixed: Column, min_tokens: int) -> Column:
    """Whether a template has enough fixed tokens."""
    return (n_fixed >= min_tokens) & (n_fixed * 2 >= n)


def parsed(docs: DataFrame, depth: int, *more: Column) -> DataFrame:
    """One row per line that is not blank: its document, place, size, leaf and form."""
    # The digest is taken once for a text, below the lines.
    known = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    lines = known.select("doc_id", "digest", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    masked = lines.select("doc_id", "digest", "line_no", masked_line(F.col("line")).alias("masked")).where("masked <> ''")
    n = token_count(F.col("masked"))
    return masked.select(
        "doc_id",
        "digest",
        "line_no",
        n.alias("n"),
        (n - F.when(F.contains("masked", F.lit(WILD)), wild_count(F.col("masked"))).otherwise(0)).alias("n_fixed"),
        F.xxhash64(n, F.substring_index("masked", " ", depth)).alias("leaf"),
        F.xxhash64("masked").alias("form"),
        *more,
    )


def leaf_templates(lines: DataFrame, leaves: DataFrame, min_tokens: int) -> DataFrame:
    """``leaf, form, template`` for the forms that share a template with fewer fixed tokens.

    ``lines`` has leaf, form and masked.
    """
    forms = lines.select("leaf", "form", "masked").join(sendable(leaves, BROADCAST_ROWS), "leaf").groupBy("leaf", "form", "n_forms").agg(F.first("masked").alias("masked"))
    forms = materialize(forms.select("leaf", "form", "n_forms", F.split("masked", " ").alias("tokens")))
    # A leaf of few forms is decided in one row, a larger one by counts over its tokens.
    few = forms.where(F.col("n_forms") <= FEW_FORMS).groupBy("leaf").agg(F.collect_list(F.struct("form", "tokens")).alias("all"))
    alike = lambda t, i: F.size(F.filter("all", lambda f: F.get(f["tokens"], i) == t)) * 2 > F.size("all")
    shape = lambda tokens: F.transform(tokens, lambda t, i: F.when(alike(t, i), t).otherwise(F.lit(WILD)))
    small = few.select("leaf", F.explode(F.transform("all", lambda f: F.struct(f["form"].alias("form"), shape(f["tokens"]).alias("shape")))).alias("s"))
    large = forms.where(F.col("n_forms") > FEW_FORMS)
    places = large.select("leaf", "n_forms", F.posexplode("tokens").alias("place", "token"))
    common = places.groupBy("leaf", "place", "token", "n_forms").agg(F.count(F.lit(1)).alias("n")).where("n * 2 > n_forms")
    # At most one token can be in more than half of the forms at a place.
    common = common.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("common"))
    shaped = large.join(common, "leaf").select(
        "leaf",
        "form",
        F.transform("tokens", lambda t, i: F.when(F.element_at("common", i) == t, t).otherwise(F.lit(WILD))).alias("shape"),
    )
    shaped = shaped.unionByName(small.select("leaf", "s.form", "s.shape"))
    n_fixed = F.size(F.filter("shape", lambda t: t != WILD))
    return shaped.where(counts(F.size("shape"), n_fixed, min_tokens)).select("leaf", "form", F.xxhash64("shape").alias("template"))


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines of these numbers, which are sorted: the stretches between them, so it is linear in both."""

    def stretches(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda i: i + 1))
        ends = F.concat(dropped, F.array(F.size(lines)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))

    # The lines are split once, as the one element of an array.
    return F.array_join(F.get(F.transform(F.array(F.split(text, "\n")), stretches), F.lit(0)), "\n")


def repeated_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, copies: str = NONE
) -> DataFrame:
    """``doc_id, digest, lines``: the lines to drop."""
    lines = materialize(parsed(docs, depth))
    forms = materialize(lines.groupBy("leaf", "form", "n", "n_fixed").agg(F.count(F.lit(1)).alias("rows")))
    leaves = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_forms"), F.sum("rows").alias("rows"))
    leaves = materialize(leaves.where((F.col("n_forms") > 1) & (F.col("rows") >= min_docs)).select("leaf", "n_forms"))
    shapes = materialize(leaf_templates(parsed(docs, depth, F.col("masked")), leaves, min_tokens))
    own = F.when(counts(F.col("n"), F.col("n_fixed"), min_tokens), F.col("form"))
    named = forms.join(shapes, ["leaf", "form"], "left").select("leaf", "form", "rows", F.coalesce("template", own).alias("key")).where("key is not null")
    often = named.groupBy("leaf", "key").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= min_docs)
    keys = materialize(named.join(often.select("leaf", "key"), ["leaf", "key"]).select("leaf", "form", "key"))
    # Only lines of templates with rows enough are left; documents are counted among these.
    found = materialize(lines.join(sendable(keys, BROADCAST_ROWS), ["leaf", "form"]).select("leaf", "key", "doc_id", "digest", "line_no"))
    held = found.groupBy("leaf", "key", "doc_id", "digest").agg(F.min("line_no").alias("line_no"))
    kept = held.groupBy("leaf", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "digest", "line_no")).alias("first"))
    kept = sendable(materialize(kept.where(F.col("n_docs") >= min_docs).select("leaf", "key", "first")), BROADCAST_ROWS)
    first = (F.col("digest") == F.col("first.digest")) & (F.col("line_no") == F.col("first.line_no"))
    if copies != EXACT:
        first = first & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return (
        found.join(kept, ["leaf", "key"])
        .where(~first)
        .groupBy("doc_id", "digest")
        .agg(F.collect_set("line_no").alias("lines"))
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    copies: str = NONE,
) -> DataFrame:
    """``docs`` with the kept text in ``text_col`` and the dropped line numbers in ``dropped_lines``.

    Lines end at ``\\n`` and are numbered from 0.  Blank lines are never dropped.
    A null text stays null and drops nothing; an empty one stays empty.  Rows
    that repeat one id with different texts are different documents; equal rows
    are treated alike and count once.  A null id sorts before all others.  A very long text or line is
    looked at whole.  All
    other columns are returned as they are, unless one is named
    ``dropped_lines``, which is replaced.  An empty table gives an empty result.
    """
    if copies not in (NONE, EXACT):
        raise ValueError(f"copies must be {NONE} or {EXACT}")
    found = repeated_lines(id_text(docs, id_col, text_col), depth, min_docs, min_tokens, copies)
    # Names that no column of the table has.
    spare = "_" * (1 + max(len(c) for c in docs.columns))
    id_name, digest_name, found_name = (spare + n for n in ("id", "digest", "found"))
    lists = found.select(F.col("doc_id").alias(id_name), F.col("digest").alias(digest_name), F.array_sort("lines").alias(found_name))
    lists = sendable(materialize(lists), BROADCAST_ROWS)
    same = docs[id_col].cast("bigint").eqNullSafe(lists[id_name]) & (
        F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))) == lists[digest_name]
    )
    met = docs.join(lists, same, "left")
    text = F.col(f"`{text_col}`").cast("string")
    dropped = F.coalesce(F.col(found_name), F.array().cast("array<int>"))
    kept = F.when(F.size("dropped_lines") > 0, without_lines(text, F.col("dropped_lines"))).otherwise(text)
    columns = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "dropped_lines"]
    return met.withColumn("dropped_lines", dropped).select(*columns, "dropped_lines")
