"""Message histories behind paged services, as a batch and a streaming source.

A service gives the messages of a channel from the newest to the oldest, so many at a time before a message id.  Any
id does as such a cursor, whether or not a message has it; so the ids of a channel are cut into ranges, and tasks walk
the pages of different ranges side by side.  No page passes through the driver, which asks each channel only once, for
its newest id.  A stream's offset is the cursor that each channel has come down to: a stream that is started again
goes on from there, and a batch that is run again asks for the same ids.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from chatterforge.sources.exports import RAW_MESSAGE

SCHEMA = "channel_id string, id string, json string"
# Failures in a row that are borne, and the longest delay that a service may ask for.
RETRIES = 5
LONGEST_WAIT = 300.0
PAGE = 100


class PageError(RuntimeError):
    """A history that cannot be read further; what was committed before stays as it was."""


class Reply(NamedTuple):
    """The status and the body of one request."""

    status: int
    body: str


#: channel, the id before which messages are wanted (None: the newest), how many -> reply.  Failures of the network are
#: raised as ConnectionError or TimeoutError.
Fetch = Callable[[str, int | None, int], Reply]


class IdRange(InputPartition):
    """The messages of a channel with ``low <= id < high``."""

    def __init__(self, channel: str, low: int, high: int):
        self.channel, self.low, self.high = channel, low, high


def http_fetch(url: str, headers: dict[str, str], timeout: float = 30.0) -> Fetch:
    """Pages by HTTP; ``url`` has a place for ``{channel}``.  Errors name neither headers nor bodies."""

    def fetch(channel: str, before: int | None, limit: int) -> Reply:
        asked = f"{url.format(channel=channel)}?limit={limit}" + (f"&before={before}" if before is not None else "")
        try:
            with urllib.request.urlopen(urllib.request.Request(asked, headers=headers), timeout=timeout) as answer:
                return Reply(answer.status, answer.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            return Reply(e.code, e.read().decode("utf-8", "replace"))
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            raise ConnectionError("no connection") from None

    return fetch


def _pause(reply: Reply | None, failures: int) -> float:
    """Seconds until the next try: what the service asks for, else twice as long each time."""
    if reply is None or reply.status != 429:
        return float(2**failures)
    try:
        wanted = float(json.loads(reply.body)["retry_after"])
    except (ValueError, TypeError, KeyError):
        raise PageError("the service limits its rate without saying for how long") from None
    if not (math.isfinite(wanted) and 0 <= wanted <= LONGEST_WAIT):
        raise PageError(f"the service asks for a delay outside of 0 to {LONGEST_WAIT:.0f} seconds")
    return wanted


def get_page(fetch: Fetch, channel: str, before: int | None, limit: int, sleep: Callable[[float], None] = time.sleep) -> list[tuple[int, dict]]:
    """(id, message) of one page, ids descending and below the cursor."""
    for failures in range(1, RETRIES + 2):
        try:
            reply = fetch(channel, before, limit)
        except (ConnectionError, TimeoutError):
            reply = None
        if reply is not None and reply.status != 429 and not 500 <= reply.status < 600:
            break
        if failures > RETRIES:
            raise PageError(f"channel {channel}: {RETRIES} retries failed, last " + (f"with status {reply.status}" if reply else "without an answer"))
        sleep(_pause(reply, failures))
    if reply.status != 200:
        raise PageError(f"channel {channel}: status {reply.status}")
    try:
        messages = json.loads(reply.body)
    except ValueError:
        raise PageError(f"channel {channel}: a page is no JSON") from None
    if not isinstance(messages, list):
        raise PageError(f"channel {channel}: a page is no list")
    found = []
    for message in messages:
        written = str(message.get("id", "")) if isinstance(message, dict) else ""
        if not (written.isascii() and written.isdigit()):
            raise PageError(f"channel {channel}: a message has no numeric id")
        if before is not None and int(written) >= before:
            raise PageError(f"channel {channel}: pages do not descend")
        before = int(written)
        found.append((before, message))
    return found


def walk(fetch: Fetch, part: IdRange, limit: int, delay: float) -> Iterator[tuple[str, str, str]]:
    """Rows of the messages of a range, page by page from its upper end; one page is held at a time."""
    before = part.high
    while before > part.low:
        page = get_page(fetch, part.channel, before, limit)
        for i, message in page:
            if i < part.low:
                return
            yield part.channel, str(message["id"]), json.dumps(message, ensure_ascii=False)
        if not page:
            return
        before = page[-1][0]
        time.sleep(delay)


def cut(channel: str, low: int, high: int, tasks: int) -> list[IdRange]:
    """At most so many ranges of equal width that make up ``low <= id < high``."""
    width = max(1, -(-(high - low) // tasks))
    return [IdRange(channel, a, min(a + width, high)) for a in range(low, high, width)]


class _Settings:
    def __init__(self, options: dict):
        self.channels = [c.strip() for c in options.get("channels", "").split(",") if c.strip()]
        if not self.channels or any(not (c.isascii() and c.isdigit()) for c in self.channels):
            raise ValueError("channels: numeric ids with commas between them")
        if len(set(self.channels)) < len(self.channels):
            raise ValueError("channels: an id is named twice")
        self.limit = min(max(int(options.get("limit", PAGE)), 1), PAGE)
        self.delay = float(options.get("delay", 0.5))
        if not (math.isfinite(self.delay) and self.delay >= 0):
            raise ValueError("delay: seconds from 0 on")
        self.since = int(options.get("since", -1))
        self.steps, self.tasks = (max(1, int(options.get(name, n))) for name, n in (("steps", 16), ("tasks", 4)))

    def newest(self, fetch: Fetch, channel: str) -> int:
        """The bound above the newest id; that of a channel without messages lies at its lower end."""
        page = get_page(fetch, channel, None, 1)
        return max(page[0][0] if page else self.since, self.since) + 1


class _Reader(DataSourceReader):
    def __init__(self, settings: _Settings, fetch: Fetch):
        self.settings, self.fetch = settings, fetch

    def partitions(self) -> list[IdRange]:
        s = self.settings
        return [r for c in s.channels for r in cut(c, s.since + 1, s.newest(self.fetch, c), s.steps * s.tasks)]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        return walk(self.fetch, partition, self.settings.limit, self.settings.delay)


class _StreamReader(DataSourceStreamReader):
    """Offsets are, for each channel, the cursor and by how much each batch lowers it (ids as text)."""

    def __init__(self, settings: _Settings, fetch: Fetch):
        self.settings, self.fetch, self.first, self.current = settings, fetch, None, None

    def initialOffset(self) -> dict:
        if self.first is None:
            s, self.first = self.settings, {}
            for channel in s.channels:
                high = s.newest(self.fetch, channel)
                self.first[channel] = {"before": str(high), "width": str(max(1, -(-(high - s.since - 1) // s.steps)))}
        return self.first

    def latestOffset(self) -> dict:
        low, now = self.settings.since + 1, self.current or self.initialOffset()
        self.current = {c: {"before": str(max(low, int(o["before"]) - int(o["width"]))), "width": o["width"]} for c, o in now.items()}
        return self.current

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        # A stream that goes on plans its last batch again before anything else.
        self.current = end
        return [r for c in end for r in cut(c, int(end[c]["before"]), int(start[c]["before"]), self.settings.tasks)]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        return walk(self.fetch, partition, self.settings.limit, self.settings.delay)


def register(spark: SparkSession, fetch: Fetch, format_name: str = "paged_messages") -> str:
    """Register a source for ``spark.read`` and ``spark.readStream``; rows are ``channel_id, id, json``.

    Options: ``channels`` (ids with commas); ``limit`` (messages a page, 1 to 100); ``delay`` (seconds after a page);
    ``since`` (only ids above; where ids hold times, that of the channel's beginning saves requests); ``steps`` (batches that
    a stream takes for a history); ``tasks`` (ranges walked side by side, for a channel and a step).

    Messages newer than the first request are left for a later read with ``since``.  A failed request is tried again
    five times.  Pages whose ids do not descend, bodies that are no list of messages and other statuses are errors.
    A channel without messages gives no rows.
    """

    class PagedMessages(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(_Settings(self.options), fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(_Settings(self.options), fetch)

    spark.dataSource.register(PagedMessages)
    return format_name


def land(spark: SparkSession, format_name: str, options: dict[str, str], path: str, checkpoint: str) -> DataFrame:
    """Stream whole histories into a Parquet table; called again after a failure, it goes on where the last batch ended."""
    stream = spark.readStream.format(format_name).options(**options).load()
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(SCHEMA).parquet(path)


def as_export(landed: DataFrame) -> DataFrame:
    """The raw messages of landed pages with the columns of ``read_export``; a channel is one transcript, oldest message first.

    ``pos`` is the id, which orders messages without numbering them.
    """
    attachments = F.to_json(F.try_variant_get(F.try_parse_json("json"), "$.attachments", "variant")).alias("attachments_json")
    found = landed.select(F.col("channel_id").alias("__channel"), F.col("id").cast("bigint").alias("pos"), "json", F.from_json("json", RAW_MESSAGE).alias("m"))
    return found.select(
        F.col("__channel").alias("transcript_id"), "pos", "m.*", attachments, F.col("__channel").alias("export_channel_id"), F.lit("DM").alias("channel_name")
    )
