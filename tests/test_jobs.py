import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chatterforge.operators import audit, masking, quality, style
from chatterforge.operators.sharegpt import assistant_messages, describe_problem, require_disjoint, split_sample, to_chat_messages
from chatterforge.plans import jobs
from chatterforge.sources import datasets, exports

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def message(i, author, name=None, seconds=0, **more):
    who = {"id": author} | ({"username": name} if name else {})
    return {"id": str(i), "author": who, "content": f"text-{i}", "timestamp": (START + timedelta(seconds=seconds)).isoformat(), **more}


def export(folder, messages, name="export.json", bom=False, **more):
    path = folder / name
    body = json.dumps({"messages": messages, **more} if more else messages, ensure_ascii=False)
    path.write_text(body, encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


def parsed(spark, path, *args, **kwargs):
    messages, summary = jobs.parse_export(spark, path, *args, **kwargs)
    return messages.orderBy("pos").collect(), summary


# ---- exports and speakers ------------------------------------------------------------------------


def test_two_person_export(spark, tmp_path):
    path = export(tmp_path, [message(1, "100", "ann"), message(2, "200", "bob")], bom=True, channel={"name": "c"}, channel_id="7")
    rows, summary = parsed(spark, path, None, "200")
    assert [(r["participant"], r["role"], r["channel_id"]) for r in rows] == [("self", "you", "7"), ("target", "them", "7")]
    assert summary["counts"] == {"self": 1, "target": 1, "other": 0} and summary["channel"] == "c"
    assert summary["participants"] == ["ann", "bob"] and summary["total_messages"] == 2


THREE = [message(1, "100", "ann"), message(2, "300", "cy"), message(3, "200", "bob")]


def test_others(spark, tmp_path):
    path = export(tmp_path, THREE)
    rows, summary = parsed(spark, path, "ann", "bob")
    assert [r["participant"] for r in rows] == ["self", "other", "target"] and summary["speakers"] == ["ann", "bob", "cy"]
    rows, summary = parsed(spark, path, "ann", "bob", others="drop")
    assert [(r["author_id"], r["session_id"]) for r in rows] == [("100", 0), ("200", 1)] and summary["dropped_other_messages"] == 1
    with pytest.raises(ValueError, match="1 more speakers"):
        parsed(spark, path, "ann", "bob", others="error")
    rows, summary = parsed(spark, path, None, "bob")
    assert summary["self"] is None and summary["counts"] == {"self": 0, "target": 1, "other": 2}
    with pytest.raises(ValueError, match="name the target"):
        parsed(spark, path, "ann", None)


def test_names(spark, tmp_path):
    """The closest way in which a reference means somebody counts: id, then name, then name in another case."""
    renamed = [message(1, "u9", "Marlow"), message(2, "u9", "Captain Marlow"), message(3, "u4", "Kurtz")]
    path = export(tmp_path, renamed)
    assert [r["participant"] for r in parsed(spark, path, "captain marlow", "u4")[0]] == ["self", "self", "target"]
    rows, summary = parsed(spark, path, None, " kurtz ")
    assert summary["self"]["name"] == "Marlow" and summary["n_speakers"] == 2
    twins = export(tmp_path, [message(1, "u1", "ÉLISE"), message(2, "u2", "élise"), message(3, "u3", "u1")])
    assert parsed(spark, twins, None, "élise")[1]["target"]["author_id"] == "u2"
    assert parsed(spark, twins, None, "u1")[1]["target"]["author_id"] == "u1"
    with pytest.raises(ValueError, match="2 speakers answer to the target 'Élise'"):
        parsed(spark, twins, None, "Élise")
    with pytest.raises(ValueError, match="nobody .* 'Ivy'; it has u1, ÉLISE, élise"):
        parsed(spark, twins, "Ivy", "u2")
    with pytest.raises(ValueError, match="self and target are both"):
        parsed(spark, twins, "u2", "élise")


def test_missing_author_and_fields(spark, tmp_path):
    path = export(tmp_path, [{"content": "x"}, message(2, "1", "a")])
    with pytest.raises(ValueError, match="Message 0: text without an author"):
        parsed(spark, path, None, "a")
    path = export(tmp_path, [message(1, "1", "a"), message(2, "2", "b", attachments={"url": "v"})])
    with pytest.raises(ValueError, match="Message 1: attachments are no list"):
        parsed(spark, path, None, "a")
    raw = [
        {"content": " "},
        5,
        "word",
        message(1, "1", "a", attachments=["u", {"url": "v"}, {"x": 1}], reference={"messageId": "9"}),
        {"id": 2, "content": 5, "username": "b", "bot": True, "display_name": "B"},
    ]
    rows, summary = parsed(spark, export(tmp_path, raw), None, "b")
    assert [(r["pos"], r["attachments"], r["reply_to"], r["bot"]) for r in rows] == [(3, ["u", "v"], "9", False), (4, [], None, True)]
    assert rows[1]["content"] == "5" and rows[1]["display_name"] == "B" and summary["target"] == {"author_id": None, "name": "b"}
    with pytest.raises(ValueError, match="no message with text"):
        parsed(spark, export(tmp_path, [{"content": ""}]), None, "b")


# ---- filters -------------------------------------------------------------------------------------


def reasons(spark, contents, bot=None, **config):
    rows = [("t", i, c, bot) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "transcript_id string, pos bigint, content string, bot boolean")
    return [r["reason"] for r in quality.classify(df, quality.FilterConfig(**config)).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "config,cases",
    [
        ({}, {"(Redacted)": "deleted_placeholder", "original message removed by a moderator": "deleted_placeholder", "they removed the sofa": None}),
        ({}, {"\t\n": "empty", "/roll 2d6": None, "www.trains.example": None}),
        ({"drop_commands": True}, {"/roll 2d6": "command", ">>help": "command", "/ roll": None, "5/roll": None}),
        ({"drop_url_only": True}, {"www.trains.example  HTTP://b.example/?q": "url_only", "see www.trains.example": None}),
        ({"max_message_chars": 3}, {"four": "oversized", "😀😀😀": None}),
        ({"max_code_blocks": 1}, {"```x``` and ```y```": "code_heavy", "```x\ny```": None}),
        ({"drop_deleted_placeholders": False}, {"(Redacted)": None}),
    ],
)
def test_filter_reasons(spark, config, cases):
    assert reasons(spark, list(cases), **config) == list(cases.values())


def test_filter_order(spark):
    """An earlier reason wins, and only messages that nothing else removes count as repeated."""
    said = ["Ja", " ja ", "nein", "(removed)", "(removed)", "NEIN"]
    gone = "deleted_placeholder"
    assert reasons(spark, said, drop_duplicate_messages=True) == [None, "duplicate_message", None, gone, gone, "duplicate_message"]
    assert reasons(spark, [" ", "(removed)"], bot=True) == ["empty", "bot"]
    assert reasons(spark, ["(removed)", "tea"], bot=True, drop_bots=False) == [gone, None]
    for name in ("max_message_chars", "max_code_blocks"):
        with pytest.raises(ValueError, match=f"{name}=-2"):
            quality.FilterConfig(**{name: -2})


# ---- format and inspect --------------------------------------------------------------------------


def transcript(folder, sessions=8, turns=4):
    rows = []
    for s in range(sessions):
        for i in range(turns):
            rows.append({"id": f"{s}-{i}", "participant": ("self", "target")[i % 2], "content": f"say {s} {i}", "timestamp": (START + timedelta(days=s, minutes=i)).isoformat()})
    return export(folder, rows, messages_only=True)


def lines(spark, path):
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]


def test_format_dataset(spark, tmp_path):
    messages = exports.read_parsed(spark, transcript(tmp_path))
    config = jobs.FormatConfig(val_ratio=0.125, test_ratio=0.125, system_prompt="be kind")
    manifest = jobs.format_dataset(messages, str(tmp_path / "out"), config)
    assert json.loads((tmp_path / "out_split_manifest.json").read_text()) == manifest
    assert (manifest["turns"], manifest["sessions"], manifest["usable_sessions"]) == (32, 8, 8)
    assert {s: manifest["splits"][s]["samples"] for s in manifest["splits"]} == {"train": 12, "val": 2, "test": 2}
    assert manifest["splits"]["train"]["messages"] == 24 and manifest["filtering"] == {"kept": 32, "removed": 0, "by_reason": {}}
    rows = {s: lines(spark, p) for s, p in manifest["outputs"].items()}
    assert rows["test"][0]["conversations"] == [{"from": "system", "value": "be kind"}, {"from": "human", "value": "say 7 0"}, {"from": "gpt", "value": "say 7 1"}]
    said = {s: {t["value"] for r in rows[s] for t in r["conversations"][1:]} for s in rows}
    assert not said["train"] & said["test"] and not said["train"] & said["val"]
    for split in rows:
        assert jobs.inspect_path(spark, manifest["outputs"][split])["samples"] == len(rows[split])
    again = jobs.format_dataset(messages, str(tmp_path / "out"), jobs.FormatConfig(val_ratio=0, test_ratio=0))
    assert lines(spark, again["outputs"]["val"]) == [] and again["splits"]["train"]["sessions"] == 8
    with pytest.raises(ValueError, match="too few to hold out"):
        jobs.format_dataset(messages.where("pos < 4"), str(tmp_path / "few"))
    with pytest.raises(ValueError):
        jobs.FormatConfig(turn_gap_seconds=10, session_gap_seconds=5)


def test_inspect_parsed(spark, tmp_path):
    rows = [
        {"participant": "self", "content": "hey"},
        {"participant": "target", "content": "see https://a.b"},
        {"participant": "self", "content": "and?"},
        {"participant": "target", "content": "```code```", "attachments": ["u"]},
        {"participant": "other", "content": "hm"},
        {"participant": "target", "content": "\U0001f600 ok"},
        {"participant": "self", "content": "  "},
        {"participant": "nobody", "content": "x"},
    ]
    for i, r in enumerate(rows):
        r["timestamp"] = (START + timedelta(minutes=i)).isoformat()
    found = jobs.inspect_path(spark, export(tmp_path, rows, "t.json"))
    assert found["messages"] == {"total": 6, "self": 2, "target": 3, "other": 1, "empty": 1, "invalid": 1}
    assert found["markers"] == {"urls": 1, "code_blocks": 1, "emoji": 1} and found["attachments"] == 1
    assert found["turns"] == {"total": 6, "target": 3, "sessions": 1, "usable_sessions": 1} and found["usable_training_samples"] == 3
    assert found["timestamps"]["coverage"] == 1.0 and found["target_responses"]["count"] == 3


def test_inspect_several_transcripts(spark, tmp_path):
    paths = [export(tmp_path, [{"participant": p, "content": f"{name} {i}"} for i, p in enumerate(who)], f"{name}.json") for name, who in (("x", ["self", "target"]), ("y", ["target"] * 3))]
    messages = exports.read_parsed(spark, paths)
    rows = {r["transcript_id"][-6:]: r for r in jobs.inspect_transcripts(messages).collect()}
    assert {k: (r["total"], r["turns"], r["usable_sessions"], r["count"]) for k, r in rows.items()} == {"x.json": (2, 2, 1, 1), "y.json": (3, 3, 0, 3)}
    with pytest.raises(ValueError, match="inspect_transcripts"):
        jobs.inspect_parsed(messages)


def test_lines_of_part_files(spark, tmp_path):
    """Files are split where they are read; numbers are those of the lines in their files all the same."""
    for name, n in (("b", 400), ("a", 700)):
        (tmp_path / "parts").mkdir(exist_ok=True)
        (tmp_path / "parts" / f"{name}.jsonl").write_text("\r\n".join(json.dumps(f"{name}{i}") if i % 5 else "" for i in range(1, n + 1)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        lines = datasets.read_predictions(spark, str(tmp_path / "parts"))
        assert lines.rdd.getNumPartitions() > 4
        found = sorted((r["file"][-7:], r["line_no"], r["text"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert found == [(f"{f}.jsonl", i, f"{f}{i}") for f, n in (("a", 700), ("b", 400)) for i in range(1, n + 1) if i % 5]


def test_evaluate_and_audit_part_files(spark, tmp_path):
    rows = [json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": t}]}) for t in [*CASUAL, *FORMAL]]
    for folder, items in (("d", rows), ("p", [json.dumps(t) for t in [*CASUAL, *FORMAL]])):
        (tmp_path / folder).mkdir()
        for name, part in (("part-0.jsonl", items[:3]), ("part-1.jsonl", items[3:])):
            (tmp_path / folder / name).write_text("\n".join(part) + "\n")
    path, predictions = str(tmp_path / "d"), {"same": str(tmp_path / "p")}
    found = jobs.evaluate_predictions(spark, path, predictions)
    assert set(found["models"]["same"]["components"].values()) == {1.0} and found["held_out_responses"] == 10
    assert jobs.evaluate_predictions(spark, path, predictions, limit=4)["held_out_responses"] == 4
    info = {r["file"][-12:]: r for r in datasets.file_info(spark, path).collect()}
    assert {f: r["samples"] for f, r in info.items()} == {"part-0.jsonl": 3, "part-1.jsonl": 7} and len({r["sha256"] for r in info.values()}) == 2
    (tmp_path / "d" / "part-1.jsonl").write_text("\n".join(rows[3:9] + [rows[9].replace("Kind", "10.0.0.1 Kind"), rows[0].replace("lol", "10.0.0.1")]))
    (tmp_path / "same").mkdir()
    for sub in ("x", "y"):
        (tmp_path / "same" / sub).mkdir()
        (tmp_path / "same" / sub / "f.jsonl").write_text("\n".join(rows[: 1 + (sub == "y")]))
    both = datasets.file_info(spark, str(tmp_path / "same" / "*")).collect()
    assert sorted(r["samples"] for r in both) == [1, 2]
    report = jobs.audit_dataset(spark, path)
    assert report["samples"] == 11 and [f["sample_no"] for f in report["findings"]] == [11]


def test_inspect_sharegpt(spark, tmp_path):
    row = json.dumps({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]})
    path = tmp_path / "d.jsonl"
    path.write_text(f"{row}\n\n{row}\n{{bad\n[1]\n", encoding="utf-8-sig")
    found = jobs.inspect_path(spark, str(path))
    assert (found["samples"], found["duplicate_samples"], found["invalid_rows"]) == (2, 1, 2)
    assert found["problems"] == ["d.jsonl:4: invalid JSON", "d.jsonl:5: expected a JSON object"]
    assert found["turns_per_sample"] == {"mean": 2.0, "max": 2} and len(found["sha256"]) == 64
    with pytest.raises(ValueError, match="d.jsonl:4: invalid JSON"):
        datasets.read_sharegpt(spark, str(path))
    (tmp_path / "e.jsonl").write_text("")
    empty = jobs.inspect_path(spark, str(tmp_path / "e.jsonl"))
    assert empty["samples"] == 0 and empty["target_responses"] == {"count": 0}
    with pytest.raises(ValueError, match="holds no sample"):
        datasets.read_sharegpt(spark, str(tmp_path / "e.jsonl"))


# ---- samples -------------------------------------------------------------------------------------

SAMPLE = "conversations array<struct<`from`:string,value:string>>"


@pytest.mark.parametrize(
    "turns,problem",
    [
        (None, "expected a conversation"),
        ([("human", "a")], "expected a conversation"),
        ([("human", "a"), ("robot", "b")], "invalid role/content"),
        ([("human", " "), ("gpt", "b")], "invalid role/content"),
        ([("human", None), ("gpt", "b")], "invalid role/content"),
        ([("gpt", "a"), ("gpt", "b")], "require user-to-assistant dialogue"),
        ([("human", "a"), ("human", "b")], "require user-to-assistant dialogue"),
        ([("human", "a"), ("system", "s"), ("gpt", "b")], "require user-to-assistant dialogue"),
        ([("system", "s"), ("gpt", "b")], "require user-to-assistant dialogue"),
        ([("system", "s"), ("human", "a"), ("gpt", "b")], None),
        ([("human", "a"), ("gpt", "b")], None),
    ],
)
def test_describe_problem(spark, turns, problem):
    df = spark.createDataFrame([(turns,)], SAMPLE)
    assert df.select(describe_problem("conversations").alias("p")).first()["p"] == problem


def test_sample_parts_and_overlap(spark):
    a = spark.createDataFrame([([("system", "s"), ("human", "a"), ("gpt", "b")],), ([("human", "c"), ("gpt", "d")],)], SAMPLE)
    context, answer = split_sample("conversations")
    r = a.select(F.size(context).alias("n"), answer.alias("a"), to_chat_messages("conversations").alias("m")).first()
    assert (r["n"], r["a"], [x["role"] for x in r["m"]]) == (2, "b", ["system", "user", "assistant"])
    assert a.select(assistant_messages(to_chat_messages("conversations")).alias("x")).first()["x"] == ["b"]
    require_disjoint(a, a.limit(0))
    with pytest.raises(ValueError):
        require_disjoint(a, a.limit(1))


# ---- audit ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,rule",
    [
        ("my key sk-" + "a1" * 12, "api_credential"),
        ("password: hunter22", "credential_assignment"),
        ("-----BEGIN RSA PRIVATE KEY-----", "private_key"),
        ("write to joe@mail.example", "email"),
        ("call +1 555 123 4567 now", "phone_number"),
        ("host 10.0.0.1 is up", "ip_address"),
        ("see /home/joe/x", "filesystem_path"),
        ("id 123456789012", "long_identifier"),
        ("at https://a.b", "url"),
    ],
)
def test_audit_rules(spark, text, rule):
    df = spark.createDataFrame([(text,), ("nothing to see, version 1.2.3 at 10:30",)], "text string")
    assert {r["rule"] for r in audit.findings(df).collect()} >= {rule}
    assert audit.findings(df.where("text like 'nothing%'")).count() == 0


def test_audit_report(spark, tmp_path):
    say = lambda a, b: json.dumps({"conversations": [{"from": "human", "value": a}, {"from": "gpt", "value": b}]})
    rows = [say("q", "joe@mail.example"), say("q", "joe@mail.example"), say("q", "x" * 30), *[say(f"q{i}", "Same  answer") for i in range(5)]]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(rows))
    report = jobs.audit_dataset(spark, str(path), long_chars=20, repeated=5)
    assert (report["samples"], report["duplicate_samples"], report["long_responses"], report["repeated_strings"]) == (8, 1, 1, 1)
    assert report["categories"] == {"email": {"count": 2, "severity": "medium"}} and report["severity_counts"] == {"medium": 2}
    assert report["findings"][0] == {"rule": "email", "severity": "medium", "sample_no": 1, "role": "gpt", "redacted": "joe************ (16 chars)"}


# ---- style ---------------------------------------------------------------------------------------

CASUAL = ["lol yeah i know", "nah haha", "omg that is so good \U0001f600", "ok ok", "brb food"]
FORMAL = ["Dear colleague, I would like to inform you of the results.", "Furthermore, the committee has decided to proceed.", "Please find the report attached.", "Kind regards.", "We appreciate your patience."]


def corpora(spark, **texts):
    rows = [(c, i, t) for c, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "corpus string, resp_id bigint, text string")


def test_style_scores(spark):
    found = style.evaluate(corpora(spark, ref=CASUAL, same=[*CASUAL, "", None], formal=FORMAL, loud=[t.upper() for t in CASUAL]), "ref")
    same = found["models"]["same"]
    assert set(same["components"].values()) == {1.0} and same["persona_fidelity_score"] == 100.0
    assert (same["responses"], same["empty_responses"], found["held_out_responses"]) == (5, 2, 5)
    assert found["models"]["formal"]["persona_fidelity_score"] < 60
    assert found["models"]["loud"]["components"]["casing_similarity"] < 0.5
    assert found["models"]["loud"]["components"]["length_similarity"] == 1.0
    with pytest.raises(ValueError, match="all responses of blank are blank"):
        style.evaluate(corpora(spark, ref=CASUAL, blank=[" "]), "ref")


def test_fidelity(spark):
    names = list(style.WEIGHTS)
    rows = [("half", *[0.5] * 7), ("tie", *[0.53125] * 7), ("mixed", 1.0, 0.0, 0.25, 0.33333, 0.1, 0.98764, 0.7)]
    df = spark.createDataFrame(rows, ["corpus", *names])
    found = {r["corpus"]: r for r in style.persona_fidelity(df).collect()}
    for corpus, *values in rows:
        fours = [round(v, 4) for v in values]
        assert [found[corpus][n] for n in names] == fours
        assert found[corpus]["persona_fidelity_score"] == round(100 * sum(fours) / 7, 1)
    weighted = style.persona_fidelity(df, {names[0]: 3.0, names[1]: 1.0}).where("corpus = 'mixed'").first()
    assert weighted["persona_fidelity_score"] == 75.0
    for bad in (df.drop(names[0]), df):
        with pytest.raises(ValueError, match="positive weights"):
            style.persona_fidelity(bad, {names[0]: 1.0 if bad is not df else 0.0})
    with pytest.raises(Exception, match="component of the score is null"):
        style.persona_fidelity(df.withColumn(names[2], F.lit(None).cast("double"))).collect()


@pytest.mark.parametrize("width,tried", [(7, 4), (64, 1), (1 << 16, 4)])
def test_leading_terms_by_sketch(spark, monkeypatch, width, tried):
    """Few hash values and few of them tried: all leading terms and their ties are found, with exact counts."""
    import random
    from collections import Counter

    rng = random.Random(width)
    rows = [(c, i, [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(0, 30))]) for i in range(300) for c in ("a", "b", None)]
    rows += [("few", 1, ["x", "y", "y"]), ("none", 1, [])]
    monkeypatch.setattr(style, "TRIED", tried)
    terms = style._exploded(spark.createDataFrame(rows, "corpus string, resp_id bigint, terms array<string>"))
    found = {(r["corpus"], r["term"]): (r["freq"], r["resp_id"]) for r in style.leading_counts(terms, 20, width).collect()}
    for corpus in ("a", "b", None, "few"):
        n, first = Counter(), {}
        for c, i, ts in rows:
            if c == corpus:
                n.update(ts)
                for t in ts:
                    first[t] = min(first.get(t, i), i)
        floor = sorted(n.values())[-20:][0]
        wanted = {(corpus, t): (k, first[t]) for t, k in n.items() if k >= floor}
        assert wanted.items() <= found.items() and all(found[c, t] == (n[t], first[t]) for c, t in found if c == corpus)
    if width > 10_000:
        assert len(found) < len({(c, t) for c, _, ts in rows for t in ts}) / 2


def test_evaluate_predictions(spark, tmp_path):
    rows = [{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": t}]} for t in CASUAL]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(t if i % 2 else {"response": t}) for i, t in enumerate([*CASUAL, "one more"])))
    found = jobs.evaluate_predictions(spark, str(tmp_path / "d.jsonl"), {"tuned": str(tmp_path / "p.jsonl")})
    assert found["models"]["tuned"]["persona_fidelity_score"] == 100.0
    (tmp_path / "few.jsonl").write_text('"one"\n')
    with pytest.raises(ValueError, match="1 predictions for 5"):
        jobs.evaluate_predictions(spark, str(tmp_path / "d.jsonl"), {"x": str(tmp_path / "few.jsonl")})
    assert jobs.evaluate_predictions(spark, str(tmp_path / "d.jsonl"), {"x": str(tmp_path / "few.jsonl")}, limit=1)["held_out_responses"] == 1
    (tmp_path / "bad.jsonl").write_text('"one"\n5\n')
    with pytest.raises(ValueError, match="line 2"):
        datasets.read_predictions(spark, str(tmp_path / "bad.jsonl"))


# ---- masking -------------------------------------------------------------------------------------


def template(start, end, prompt=True, begin=""):
    def render(messages, add_generation_prompt=False):
        body = "".join(f"{start.format(role=m['role'])}{m['content']}{end}" for m in messages)
        return begin + body + (start.format(role="assistant") if add_generation_prompt and prompt else "")

    return render


def bracketed(messages, add_generation_prompt=False):
    """Answers are marked by the end of the question only."""
    return "".join(f"[ASK] {m['content']} [END]" if m["role"] == "user" else f" {m['content']}</s>" for m in messages)


@pytest.mark.parametrize(
    "render,markers",
    [
        (
            template("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", begin="<|begin_of_text|>"),
            ("<|start_header_id|>user<|end_header_id|>\n\n", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
        ),
        (template("<|im_start|>{role}\n", "<|im_end|>\n"), ("<|im_start|>user\n", "<|im_start|>assistant\n")),
        (bracketed, ("[ASK] ", " [END] ")),
        (template("<|im_start|>{role}\n", "<|im_end|>\n", prompt=False), ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n")),
    ],
)
def test_markers_and_spans(spark, render, markers):
    instruction, response = masking.derive_markers(render)
    assert markers[0].endswith(instruction) or instruction.endswith(markers[0])
    assert response.endswith(markers[1][-12:])
    chat = [{"role": r, "content": c} for r, c in (("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"))]
    rows = [(render(chat), ["a1", "a2"]), (render(chat), ["a1"]), (render(chat), ["a1", "zz"]), ("nothing", [])]
    df = spark.createDataFrame(rows, "rendered string, answers array<string>")
    problems = [r["problem"] for r in masking.masking_problems(df, instruction, response).collect()]
    assert problems[0] is None and problems[1].startswith("2 stretches") and "outside" in problems[2] and problems[3] is None
    spans = df.select(masking.masked_spans(F.col("rendered"), instruction, response).alias("s")).first()["s"]
    for s, answer in zip(spans, ("a1", "a2")):
        assert answer in rows[0][0][s["start"] : s["end"]] == s["text"] and "q2" not in s["text"]
    with pytest.raises(ValueError):
        masking.verify_masking(df, instruction, response)


@pytest.mark.parametrize("render", [lambda m, **k: "", lambda m, **k: "fixed", lambda m, **k: "".join(x["content"] * 2 for x in m), template("", "\n"), template("{{}}", "")])
def test_unusable_templates(render):
    with pytest.raises(ValueError):
        masking.derive_markers(render)


# ---- streams -------------------------------------------------------------------------------------


def test_stream_sessions_equal_the_batch(spark, sf_dir, tmp_path):
    from chatterforge.operators.turns import known_time_sessions
    from chatterforge.streaming.sessions import stream_counts, stream_sessions

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    query = stream_sessions(source, ["user_id"], "ts").writeStream.format("memory").queryName("found").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    closed = F.col("end_ts") + F.expr("INTERVAL 1800 SECONDS") < F.lit(last) - F.expr("INTERVAL 10 MINUTES")
    batch = known_time_sessions(events, ["user_id"], "ts").where(closed)
    mine = lambda df: sorted(map(tuple, df.select("user_id", "start_ts", "end_ts", "n").collect()))
    assert mine(spark.table("found").where(closed)) == mine(batch) and batch.count() > 100
    counted = stream_counts(source, ["user_id"], "ts", "1 day").writeStream.format("memory").queryName("days").outputMode("complete").start()
    try:
        counted.processAllAvailable()
    finally:
        counted.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()
