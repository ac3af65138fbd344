r"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

*Protected entities* are the e-mail addresses, IP addresses, card and phone
numbers that fixed patterns find.  Personal values hardly ever repeat, so an entity is looked at on
three levels: its kind, its group (mail domain, first half of an IP address, first digits of a number), and
its value.  *Disclosing terms* are runs of letters and digits, of any length, that stand outside of entities and give such a class
away; the parts of an address say nothing of the words that they are made of.
With n(c), n(t) and n(c, t) different texts that hold class c, term t and both, of N in all, and p the lower
end of the one-sided 95 % Wilson interval of n(c, t) / n(t),

    PMI(c; t) = log(p N / n(c)),    IC(c) = log(N / n(c)).

PMI would reach IC if it were certain that the term never stands without the class.  A term is treated where p is at
least ``SURE``: it gives the class away more often than not.  From PMI / IC of ``GENERALISE`` on it
is replaced by its class, the kind that it gives away most; from ``REMOVE`` on it is cut.  The bound takes
the place of a least count: three texts are the fewest that can pass, sixteen are needed for a cut where a class is in a
sixtieth of all texts.  Texts are counted once however often they are copied.

The pattern matches come from ``split`` and ``regexp_extract_all``, whose pieces
alternate; all loops inside the patterns are possessive, so that long runs of digits
or dots need no stack, and ``\G`` lets a match begin where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.common import id_text, materialize, sendable

# What counts as each kind of personal data.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text without any match of the kind fails.
PRESENT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
}
TERM = r"[\p{L}\p{N}]++"
GENERALISE, REMOVE = 0.8, 0.95
#: Quantile of the interval, and the least lower bound of a term's share of texts with the class.
Z, SURE = 1.645, 0.5
#: Elements that a running fold goes through before it starts a new list.
CHUNK = 128
#: Rows of a table (about 100 bytes each) that is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, what ``join`` makes of those before it, from 0.

    Lists grow by copying, so the array is gone through in chunks, and only the totals of the chunks in one go.
    """
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def folded(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: join(a, x)))
        starts = F.aggregate(totals, F.array(zero), lambda seen, x: F.concat(seen, F.array(join(F.element_at(seen, -1), x))))
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))
        within = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("seen")), step)["seen"]
        return let(starts, lambda first: F.flatten(F.transform(chunks, lambda c, i: within(c, F.get(first, i)))))

    cut = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(CHUNK)), lambda i: F.slice(v, i, CHUNK))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), folded)).otherwise(none))


def match_spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches as spans in code points."""
    pieces = F.arrays_zip(F.split(text, F.lit(pattern), -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    size = lambda p: (F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("bigint")

    def span(p: Column, at: Column) -> Column:
        begin = at + F.length(p["gap"])
        return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(p["hit"])).alias("end"), p["hit"].alias("value"))

    placed = let(pieces, lambda ps: F.zip_with(ps, running(F.transform(ps, size), lambda a, x: a + x), span))
    return F.filter(placed, lambda s: s["value"].isNotNull())


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check: every second digit from the right is doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str) -> Callable[[Column], Column]:
    """Whether a span of this kind holds a possible value."""
    return lambda span: _possible(kind, span["value"])


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _possible(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The protected entities of a text, by kind and then by start."""
    parts = []
    for kind in KINDS:
        found = F.filter(match_spans(text, PATTERNS[kind], kind), valid(kind))
        parts.append(F.when(PRESENT[kind](text), found).otherwise(F.array().cast(SPAN)))
    return F.concat(*parts)


def entity_classes(span: Column) -> Column:
    """The classes of an entity: its kind, its group and its value."""
    kind, value = span["kind"], span["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    group = (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.left(digits, F.lit(6)))
        .otherwise(F.left(digits, F.lit(4)))
    )
    return F.array(kind, F.concat(kind, F.lit("|g|"), group), F.concat(kind, F.lit("|v|"), value))


def text_terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def outside(text: Column, base: Column) -> Column:
    """The text with a space in the place of each entity."""
    gaps = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("tag")))
    return F.when(F.size(base) == 0, text).otherwise(let(F.array_sort(gaps), lambda spans: _replaced(text, spans)))


def lower_bound(n: Column, of: Column) -> Column:
    """The lower end of the Wilson interval of the share ``n / of``."""
    share, z = n / of, F.lit(Z)
    spread = z * F.sqrt(share * (1 - share) / of + z * z / (4 * of * of))
    return (share + z * z / (2 * of) - spread) / (1 + z * z / of)


def disclosing_terms(texts: DataFrame, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """``term, disclosure, kind`` of the terms to treat, and ``digest, terms`` of the texts that hold them.

    ``texts`` has text, digest and base.  Terms are taken, here and in all counts, from what stands outside of entities.
    """
    holders = texts.where(F.size("base") > 0).groupBy("digest").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    texts = texts.select("digest", outside(F.col("text"), F.col("base")).alias("text"))
    holders = materialize(holders.select(outside(F.col("text"), F.col("base")).alias("text"), F.array_distinct(F.flatten(F.transform("base", entity_classes))).alias("classes")))
    known = holders.select(F.explode("classes").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_c"))
    # No share of fewer texts has a lower bound of SURE.
    fewest = Z * Z * SURE / (1 - SURE)
    terms = text_terms(F.col("text"))
    both = holders.select("classes", F.explode(terms).alias("term")).select(F.explode("classes").alias("class"), "term")
    together = materialize(both.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= fewest))
    wanted = sendable(materialize(together.select("term").distinct()), BROADCAST_ROWS)
    # Each of m copies of a text counts 1 / m, so that the counts are summed where the texts are read.
    copies = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("m")))
    n = F.lit(copies.count())
    several = sendable(materialize(copies.where("m > 1")), BROADCAST_ROWS)
    weighed = texts.join(several, "digest", "left").select((1 / F.coalesce("m", F.lit(1))).alias("weight"), F.explode(terms).alias("term"))
    n_t = weighed.join(wanted, "term").groupBy("term").agg(F.round(F.sum("weight"), 3).alias("n_t"))
    met = together.join(n_t, "term").join(known, "class").where(F.col("n_c") < n).withColumn("p", lower_bound(F.col("n_ct"), F.col("n_t")))
    rated = met.where(F.col("p") >= SURE).select(
        "term",
        (F.log(F.col("p") * n / F.col("n_c")) / F.log(n / F.col("n_c"))).alias("d"),
        F.substring_index("class", "|", 1).alias("kind"),
    )
    worst = rated.groupBy("term").agg(F.max(F.struct("d", "kind")).alias("worst")).where(F.col("worst.d") >= least)
    risky = materialize(worst.select("term", F.col("worst.d").alias("disclosure"), F.col("worst.kind").alias("kind")))
    placed = texts.select("digest", F.explode(terms).alias("term")).join(sendable(risky, BROADCAST_ROWS), "term").distinct()
    held = placed.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("disclosure", "kind")))).alias("terms"))
    return risky, held


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span, sorted by start, replaced by its tag; one that begins inside an earlier one goes with it."""

    def piece(s: Column, at: Column) -> Column:
        gap = text.substr((at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0)).cast("int"))
        return F.when(s["end"] > at, F.concat(gap, s["tag"])).otherwise(F.lit(""))

    ends = F.transform(spans, lambda s: s["end"])
    pieces = F.array_join(F.zip_with(spans, running(ends, F.greatest), piece), "")
    last = F.array_max(ends)
    return F.concat(pieces, text.substr((last + 1).cast("int"), F.greatest(F.length(text) - last, F.lit(0)).cast("int")))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with every entity replaced by its kind, and disclosing terms by their class or by nothing."""
    cut = lambda s, tag: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag.alias("tag"))
    named = F.transform(base, lambda s: cut(s, F.concat(F.lit("<"), s["kind"], F.lit(">"))))
    more = F.transform(added, lambda s: cut(s, F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("<"), s["of"], F.lit(" term>")))))
    spans = F.array_sort(F.concat(named, more))
    return F.when((F.size(base) == 0) & (F.size(added) == 0), text).otherwise(let(spans, lambda found: _replaced(text, found)))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """``doc_id, text, base, added, sanitised`` for every row of ``docs``.

    ``base`` are the protected entities, ``added`` the occurrences of disclosing
    terms outside them (kind ``generalised`` or ``removed``, and ``of``, the kind of entity they give away), both with start
    and end in code points; ``sanitised`` is the text with both replaced.  A null text counts as
    empty and has no spans; a very long one is looked at whole; repeated rows are returned each and count as one text;
    null ids are returned as they are; columns other than the two named are not
    read.  An empty table gives an empty result.
    """
    texts = id_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5("text"))).withColumn("base", base_spans(F.col("text")))
    _, held = disclosing_terms(texts, generalise)
    met = texts.join(sendable(materialize(held), BROADCAST_ROWS), "digest", "left")
    risk = lambda s: F.element_at("terms", F.lower(s["value"]))
    hits = F.filter(match_spans(F.col("text"), TERM, "term"), lambda s: F.map_contains_key("terms", F.lower(s["value"])))
    apart = F.filter(hits, lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    added = F.transform(
        apart,
        lambda s: F.struct(
            F.when(risk(s)["disclosure"] >= remove, "removed").otherwise("generalised").alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            risk(s)["kind"].alias("of"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,of:string>>")
    met = met.withColumn("added", F.when(F.col("terms").isNotNull(), added).otherwise(none))
    return met.select("doc_id", "text", "base", "added", sanitised(F.col("text"), F.col("base"), F.col("added")).alias("sanitised"))


def spell(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_report(found: DataFrame) -> DataFrame:
    """Counts, digest and spelled spans of :func:`sanitise`'s rows."""
    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    added = F.concat(*[F.filter("added", of_kind(k)) for k in ("generalised", "removed")])
    spelled = F.array_join(F.filter(F.array(*[F.when(F.size(x) > 0, spell(x)) for x in (F.col("base"), added)]), lambda x: x.isNotNull()), ",")
    return found.select(
        "doc_id", *counts, F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spelled.alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256")
    )
