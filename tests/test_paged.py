"""The paged source over recorded pages: each request is written to a file, as tasks run in other processes."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest

from chatterforge.sources import paged
from chatterforge.sources.paged import IdRange, PageError, Reply, cut, get_page, walk

HISTORY = {"7": [3 * i + 2 for i in range(230)], "8": [10**17 + i * i for i in range(40)], "9": []}


def recorded(log, fails_below=None):
    """A service over HISTORY; below an id, it is down while the file ``down`` exists."""
    history = HISTORY

    def fetch(channel, before, limit):
        with open(f"{log}/requests", "a") as f:
            f.write(f"{channel} {before} {limit}\n")
        if fails_below is not None and before is not None and before < fails_below and Path(f"{log}/down").exists():
            return Reply(403, "secret body")
        ids = [i for i in sorted(history[channel], reverse=True) if before is None or i < before][:limit]
        return Reply(200, json.dumps([{"id": str(i), "content": f"c{i} “é”", "author": {"id": "1"}} for i in ids]))

    return fetch


def requests(log):
    return Path(f"{log}/requests").read_text().splitlines()


def everything():
    return sorted((c, str(i)) for c, ids in HISTORY.items() for i in ids)


OPTIONS = {"channels": "7, 8,9", "limit": "20", "delay": "0", "steps": "5", "tasks": "3"}


def test_batch_read_gives_each_message_once(spark, tmp_path):
    name = paged.register(spark, recorded(tmp_path), "paged_batch")
    df = spark.read.format(name).options(**OPTIONS).load()
    rows = df.collect()
    assert sorted((r["channel_id"], r["id"]) for r in rows) == everything()
    assert all(json.loads(r["json"])["content"] == f"c{r['id']} “é”" for r in rows)
    some = spark.read.format(name).options(**OPTIONS | {"channels": "7", "since": "300"}).load()
    assert sorted(int(r["id"]) for r in some.collect()) == [i for i in HISTORY["7"] if i > 300]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    log.mkdir()
    (log / "down").touch()
    options = OPTIONS | {"channels": "7"}
    name = paged.register(spark, recorded(log, fails_below=300), "paged_stream")
    with pytest.raises(Exception, match="status 403") as failed:
        paged.land(spark, name, options, out, checkpoint)
    assert "secret body" not in str(failed.value)
    before = spark.read.schema(paged.SCHEMA).parquet(out)
    landed = {int(r["id"]) for r in before.collect()}
    assert landed and landed < set(HISTORY["7"]) and min(landed) >= 270
    (log / "down").unlink()
    asked = len(requests(log))
    whole = paged.land(spark, name, options, out, checkpoint)
    assert sorted(int(r["id"]) for r in whole.collect()) == HISTORY["7"]
    # What was committed is not asked for again: all cursors lie below it.
    again = [line.split()[1] for line in requests(log)[asked:]]
    assert again and all(b != "None" and int(b) <= min(landed) for b in again)
    asked = len(requests(log))
    assert paged.land(spark, name, options, out, checkpoint).count() == len(HISTORY["7"])
    assert len(requests(log)) - asked <= 3


def test_landed_pages_are_an_export(spark, tmp_path):
    name = paged.register(spark, recorded(tmp_path), "paged_export")
    landed = paged.land(spark, name, OPTIONS, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    messages = paged.as_export(landed)
    assert sorted((r["transcript_id"], r["id"]) for r in messages.collect()) == everything()
    first = messages.where("transcript_id = '7'").orderBy("pos").first()
    assert (first["id"], first["content"], first["author"]["id"], first["export_channel_id"]) == ("2", "c2 “é”", "1", "7")
    assert paged.as_export(spark.createDataFrame([], paged.SCHEMA)).count() == 0


def test_ranges_cover_all_ids_once():
    for low, high, tasks in [(0, 10, 3), (5, 5, 4), (0, 2, 7), (0, 2**63, 16)]:
        parts = cut("7", low, high, tasks)
        assert len(parts) <= tasks and sum(p.high - p.low for p in parts) == high - low
        assert all(a.high == b.low for a, b in zip(parts, parts[1:]))


def script(*replies):
    left = list(replies)

    def fetch(channel, before, limit):
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return fetch


def test_failures_are_tried_again_and_waits_obeyed():
    waits = []
    fine = Reply(200, '[{"id": "5"}, {"id": 4}]')
    fetch = script(ConnectionError(), Reply(503, ""), Reply(429, '{"retry_after": 1.5}'), TimeoutError(), fine)
    assert [i for i, _ in get_page(fetch, "7", 9, 10, waits.append)] == [5, 4]
    assert waits == [2.0, 4.0, 1.5, 16.0]
    with pytest.raises(PageError, match="5 retries"):
        get_page(script(*[Reply(500, "")] * 6), "7", 9, 10, waits.append)


@pytest.mark.parametrize(
    "reply",
    [
        Reply(404, "x"),
        Reply(200, "no json"),
        Reply(200, '{"id": 1}'),
        Reply(200, '[{"id": "x"}]'),
        Reply(200, '[{"id": "٣"}]'),
        Reply(200, "[3]"),
        Reply(200, '[{"id": "9"}]'),
        Reply(200, '[{"id": "5"}, {"id": "5"}]'),
        Reply(200, '[{"id": "5"}, {"id": "6"}]'),
        Reply(429, "{}"),
        Reply(429, '{"retry_after": 301}'),
        Reply(429, '{"retry_after": "nan"}'),
    ],
)
def test_bad_pages_are_errors(reply):
    with pytest.raises(PageError):
        get_page(script(reply), "7", 9, 10, lambda s: None)


def test_a_walk_stops_at_the_lower_end(tmp_path):
    rows = list(walk(recorded(tmp_path), IdRange("7", 100, 200), 7, 0.0))
    assert [int(i) for _, i, _ in rows] == [i for i in reversed(HISTORY["7"]) if 100 <= i < 200]


@pytest.mark.parametrize("options", [{}, {"channels": "a"}, {"channels": "7,7"}, {"channels": "7", "delay": "nan"}, {"channels": "7", "delay": "-1"}])
def test_bad_options(options):
    with pytest.raises(ValueError):
        paged._Settings(options)


def test_pages_by_http(tmp_path):
    service = recorded(tmp_path)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            from urllib.parse import parse_qs, urlparse

            asked = urlparse(self.path)
            query = parse_qs(asked.query)
            known = self.headers["Authorization"] == "token-of-a-test"
            before = int(query["before"][0]) if "before" in query else None
            reply = service(asked.path.split("/")[-1], before, int(query["limit"][0])) if known else Reply(401, "token-of-a-test")
            self.send_response(reply.status)
            self.end_headers()
            self.wfile.write(reply.body.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/channels/{{channel}}"
        fetch = paged.http_fetch(url, {"Authorization": "token-of-a-test"})
        assert [i for i, _ in get_page(fetch, "7", None, 3)] == [689, 686, 683]
        assert [i for i, _ in get_page(fetch, "7", 8, 10)] == [5, 2]
        with pytest.raises(PageError) as denied:
            get_page(paged.http_fetch(url, {}), "7", None, 3)
        assert "token" not in str(denied.value)
    finally:
        server.shutdown()
        server.server_close()
