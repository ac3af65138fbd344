import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatterforge.llm import pii_disclosure as P

from .helpers import AWKWARD, awkward, documents, sha, texts

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def model(text):
    spans, counts = [], Counter()
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                good = 13 <= len(digits) <= 19 and luhn(digits)
            else:
                good = kind == "email" or 9 <= len(digits) <= 15
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
                counts[kind] += 1
    return [*(counts[k] for k in KINDS), sha(",".join(spans))], ",".join(spans)


def check(rows, by_text):
    for r in rows:
        head, spans = by_text(r)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]] == head
        assert r["spans"].startswith(spans)


def test_contract_on_documents(spark, sf_dir):
    by_id = texts(spark, sf_dir)
    rows = P.span_report(P.sanitise(documents(spark, sf_dir))).collect()
    assert len(rows) == len(by_id) and sum(r["n_email"] for r in rows) > 0
    check(rows, lambda r: model(by_id[r["doc_id"]]))


HARD = [
    "a@b.c_d@e.f x@y z@w.q.r.s@t.u",
    "....@a.b a@b..c a@-.- %+@a.b-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.000255.1.0 1.2.3 1.2.3.4444444444444",
    "4111 1111-1111 1111 4111  1111 41111111111111111111111 4111-1111-1111-1111-",
    "+1 (234) 555-6789 +12345678 +1..........2 +1 2 3 4 5 6 7 8 9 ++123456789 +123456789+123456789",
    "é" * 5 + "x.y@mail.com \U0001f600 a@b.c",
    "7" * 5000 + " " + "1." * 5000 + " a@" + "b." * 3000 + " " + "x" * 20000,
    None,
    "",
]
pieces = st.sampled_from(["a", "@", ".", "1", "23", "255", "256", "+", "-", " ", "(", ")", "4111111111111111", "é", "_", "%", "\n"])


@pytest.fixture(scope="module")
def hard_rows(spark):
    made: list[str] = []

    @given(st.lists(pieces, max_size=40))
    @settings(max_examples=400, database=None)
    def collect(parts):
        made.append("".join(parts))

    collect()
    return [*HARD, *made]


def test_patterns_on_hard_texts(spark, hard_rows):
    docs = spark.createDataFrame(list(enumerate(hard_rows)), "doc_id bigint, text string")
    rows = P.span_report(P.sanitise(docs, generalise=2.0)).collect()
    check(rows, lambda r: model(hard_rows[r["doc_id"]]))


def planted():
    """Texts of which some name a person beside an address: the person's name and nickname give the address away."""
    common = "plain words that every text holds here"
    rows = [(i, f"{common} Li, agent x9, writes from boss{i}@corp.example about {'abcdefghijklmnopqrst'[i]}") for i in range(20)]
    rows += [(100 + i, f"{common} nothing else but t{i}") for i in range(400)]
    rows += [(600, f"{common} only LI is named"), (601, f"{common} x9 again"), (602, rows[0][1]), (603, rows[0][1])]
    return rows


def test_terms_that_give_an_entity_away(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in P.sanitise(docs).collect()}
    spelled = {r["doc_id"]: r["spans"] for r in P.span_report(P.sanitise(docs)).collect()}
    kinds = {(a["value"].lower(), a["kind"], a["of"]) for r in found.values() for a in r["added"]}
    # Names of any length and with digits; li and x9 are in 21 texts, 20 of them with an address, so the class is less certain.
    assert kinds == {(w, "removed", "email") for w in ("agent", "writes", "from", "about")} | {("li", "generalised", "email"), ("x9", "generalised", "email")}
    at = rows[-4][1].index("LI")
    assert spelled[600] == f"generalised:{at}:{at + 2}" and found[600]["sanitised"] == rows[-4][1].replace("LI", "<email term>")
    assert found[0]["sanitised"] == "plain words that every text holds here <email term>,  <email term>,   <email>  a"
    assert all(not found[100 + i]["added"] for i in range(400)) and spelled[602] == spelled[0]


def test_a_term_beside_few_entities_is_left(spark):
    rows = [(i, f"shared words and rare{i // 2} beside me{i}@corp{i}.example") for i in range(20)] + [(30 + i, f"shared words of text {i} x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {a["value"] for r in P.sanitise(docs).collect() for a in r["added"]} == {"and", "beside"}


def test_parts_of_addresses_are_no_terms(spark):
    """Words that addresses are made of stay where they stand by themselves; a name beside the addresses goes."""
    rows = [(i, f"call for Quixana{'' if i % 2 else ' now'}: me{i}@corp{i}.example or +1 555 010 {1000 + i}") for i in range(40)]
    rows += [(100 + i, f"words for text {i} or now") for i in range(600)]
    rows += [(900, "for example tea at 555 or 010"), (901, "Quixana drinks tea")]
    found = {r["doc_id"]: r for r in P.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[900]["added"] == [] and found[900]["sanitised"] == rows[-2][1]
    assert [a["value"] for a in found[901]["added"]] == ["Quixana"]
    texts_, bases = P.F.col("text"), P.base_spans(P.F.col("text"))
    df = spark.createDataFrame([("a@b.cx +1 234 567 8901y",), ("no entity",), ("1.2.3.4",), ("",)], "text string")
    assert [r[0] for r in df.select(P.outside(texts_, bases)).collect()] == ["   y", "no entity", " ", ""]


def test_running_folds_over_chunks(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1000)),)], "v array<bigint>")
    for join, expected in ((lambda a, x: a + x, [sum(range(i)) for i in range(1000)]), (P.F.greatest, [max(0, i - 1) for i in range(1000)])):
        assert [r[0] for r in df.select(P.running(P.F.col("v"), join)).collect()] == [[], [0], expected]


def test_a_term_in_a_copied_text_counts_once(spark):
    rows = [(i, "secret person me@corp.example") for i in range(20)] + [(30 + i, f"other text {i} x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r["added"] == [] for r in P.sanitise(docs).collect())


def test_awkward_rows(spark):
    rows = P.span_report(P.sanitise(awkward(spark, AWKWARD))).collect()
    assert len(rows) == len(AWKWARD) and all(r["spans"] == "" for r in rows)
    assert P.sanitise(awkward(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    df = P.span_report(P.sanitise(documents(spark, sf_dir)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
