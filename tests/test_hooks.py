"""A user's functions as columns: made once a worker, applied by batches."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from chatterforge.functions import hooks as H
from chatterforge.operators.masking import derive_markers, masked_spans


def template(messages, add_generation_prompt=False):
    return "".join(f"<|{m['role']}|>\n{m['content']}</s>\n" for m in messages)


def noting(folder, make):
    """A maker that leaves a file wherever it is called."""

    def noted():
        os.close(tempfile.mkstemp(dir=folder, prefix=f"{os.getpid()}-")[0])
        return make()

    return noted


def chats(spark, rows):
    data = [(i, None if c is None else [{"role": r, "content": t} for r, t in c]) for i, c in enumerate(rows)]
    return spark.createDataFrame(data, f"id bigint, messages {H.MESSAGES}")


SOME = [[("system", "be kind"), ("user", "a b"), ("assistant", "c")], [], None, [("user", "x y z")], [("user", None)]]


def test_counter_template_and_generator(spark):
    df = chats(spark, SOME)
    words = H.Hook("words", lambda: lambda chat: sum(len((m["content"] or "").split()) for m in chat))
    echo = H.Hook("echo", lambda: lambda chat: chat[-1]["content"].upper() if chat and chat[-1]["content"] else None)
    shown = H.Hook("shown", lambda: template)
    m = F.col("messages")
    rows = df.select("id", H.count_tokens(words, m).alias("n"), H.generate(echo, m).alias("reply"), H.render(shown, m).alias("text")).orderBy("id").collect()
    assert [r["n"] for r in rows] == [5, 0, None, 3, 0]
    assert [r["reply"] for r in rows] == ["C", "", None, "X Y Z", ""]
    assert rows[0]["text"] == "<|system|>\nbe kind</s>\n<|user|>\na b</s>\n<|assistant|>\nc</s>\n" and rows[2]["text"] is None
    with pytest.raises(Exception, match="must render to text"):
        df.select(H.render(H.Hook("none", lambda: lambda chat: None), m)).collect()


def test_a_hook_is_made_once_in_a_worker(spark, tmp_path):
    rows = [[("user", str(i))] for i in range(2000)]
    df = chats(spark, rows).repartition(16)
    hook = H.Hook(f"noted {tmp_path}", noting(str(tmp_path), lambda: lambda chat: len(chat)))
    for _ in range(2):
        assert df.select(F.sum(H.count_tokens(hook, F.col("messages")))).first()[0] == 2000
    workers = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert workers and len(workers) == len(set(workers))


def trimmed(chat, count, budget):
    """The rule, spelled out on a list."""
    chat = list(chat)
    first = 1 if chat and chat[0][0] == "system" else 0
    while count(chat) > budget:
        if len(chat) - first < 3:
            return "too long"
        if [r for r, _ in chat[first : first + 2]] != ["user", "assistant"]:
            return "no pairs"
        del chat[first : first + 2]
    return chat


@pytest.mark.parametrize("budget", [0, 12, 30, 60, 10_000])
def test_trim_with_a_counter_that_does_not_add_up(spark, budget):
    turn = lambda n: [x for i in range(n) for x in (("user", "q" * i), ("assistant", "a" * (n - i)))]
    rows = [[("system", "s" * k)] * (k > 0) + turn(n)[:cut] for k in (0, 5) for n in (0, 1, 4) for cut in (None, -1) if n or cut is None]
    rows += [[("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d" * 20)], [("system", "only")]]
    count = lambda chat: len(template(chat)) // 3 + (len(chat) > 3) * 10
    hook = H.Hook(f"thirds {budget}", lambda: count)
    found = chats(spark, rows).select("id", H.trim(hook, F.col("messages"), budget).alias("t")).orderBy("id").collect()
    for chat, r in zip(rows, found):
        wanted = trimmed(chat, lambda c: count([{"role": r, "content": t} for r, t in c]), budget)
        got = r["t"]["problem"] or [(m["role"], m["content"]) for m in r["t"]["messages"]]
        assert got == wanted, (chat, budget)
    assert chats(spark, [None]).select(H.trim(hook, F.col("messages"), budget)["messages"].alias("m")).first()["m"] is None


def test_spans_of_chats_rendered_as_a_column(spark):
    """A whole table is rendered by its template, and the answers alone keep loss."""
    rows = [[("user", f"q{i}"), ("assistant", f"a{i}"), ("user", "more"), ("assistant", "b" * i)] for i in range(50)]
    instruction, response = derive_markers(template)
    shown = H.render(H.Hook("shown", lambda: template), F.col("messages"))
    found = chats(spark, rows).withColumn("rendered", shown).select("id", "rendered", masked_spans(F.col("rendered"), instruction, response).alias("spans")).orderBy("id").collect()
    for chat, r in zip(rows, found):
        assert [s["text"].split("</s>")[0] for s in r["spans"]] == [t for role, t in chat if role == "assistant"]
        assert all(r["rendered"][s["start"] : s["end"]] == s["text"] for s in r["spans"])
