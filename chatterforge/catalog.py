"""Every registered query with the SQL that gives the same rows.

Conversations are transcripts without times, events a stream of messages with
known times, documents a collection of texts.  Floats are rounded to six places on both
sides, lists are spelled as strings, and every order has a tie-break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterforge.functions import hooks
from chatterforge.functions import text as T
from chatterforge.operators import audit, profiling, style
from chatterforge.operators.identity import collect_participants, label_messages, matches
from chatterforge.operators.masking import masked_spans, masking_problems
from chatterforge.operators.quality import FilterConfig, classify, filter_messages, filter_report
from chatterforge.operators.sharegpt import answers, assistant_messages, conversations, describe_problem, overlap, split_sample, to_chat_messages
from chatterforge.operators.splits import drop_duplicate_samples, split_sessions, split_summary
from chatterforge.operators.style import pair_predictions
from chatterforge.operators.turns import aggregate_turns, known_time_sessions, sessionize
from chatterforge.operators.validation import message_violations
from chatterforge.operators.windows import SESSION, build_windows, placed, trim_history, usable_sessions
from chatterforge.plans import compat
from chatterforge.runtime import materialize, number_rows, sent

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function as a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- tables as conversations -----------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of one transcript per language."""
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("transcript_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses of one corpus per language."""
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("resp_id"), "text")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts without times; system turns are not spoken."""
    return (
        read(spark, sf_dir, "conversations")
        .where("role <> 'system'")
        .select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of four transcripts; the user is the author."""
    n = F.col("user_id") % 3
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("transcript_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"),
        F.col("event_id").cast("string").alias("id"),
        F.when(n == 0, "self").when(n == 1, "target").otherwise("other").alias("participant"),
        F.col("user_id").cast("string").alias("author_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"),
        F.col("event_type").alias("content"),
        F.col("ts").cast("string").alias("timestamp"),
    )


def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and sessions over range partitions, as a transcript is a quarter of all events."""
    return aggregate_turns(stream(spark, sf_dir), spread=True, session_gap_seconds=1800)


def placed_turns(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The turns, or some columns of them, with their places, as a session is a quarter of all events, too."""
    turns = stream_turns(spark, sf_dir)
    return placed(turns.select("transcript_id", "turn_no", "session_id", *columns) if columns else turns)


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(aggregate_turns(chats(spark, sf_dir)))


# ---- their SQL -----------------------------------------------------------------------------------

_WORDS = r"list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*'), lambda w: lower(w))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = _STRIP.format(
    r"regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), "
    r"'[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
)
_KEY = _STRIP.format(r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g')")
_SENTENCES = (
    r"list_filter(list_transform(string_split_regex(regexp_replace({0}, '([.!?…])\s+', '\1' || chr(1), 'g'), '\x01|\n+'), lambda s: "
    + _STRIP.format("s")
    + r"), lambda s: s <> '')"
)
_EMOJI = (
    r"(len(regexp_extract_all({0}, '[\x{{1f000}}-\x{{1faff}}\x{{2600}}-\x{{27bf}}\x{{2b00}}-\x{{2bff}}\x{{fe0f}}]')) "
    r"+ len(regexp_extract_all({0}, '<a?:\w+:\d+>')))"
)
_MARKS = r"""[.,!?;:''"()\[\]{{}}\-_/\\*~`@#&%+=<>|^$…]"""
_URL = r"""(?i)(?:https?://|www\.)[^\s<>"'']+"""

_CHATS = "chats AS (SELECT conv_id AS transcript_id, turn AS pos, CASE role WHEN 'user' THEN 'self' ELSE 'target' END AS participant, " + _CLEAN.format(
    "text"
) + " AS content FROM conversations WHERE role <> 'system'), "
_CHAT_TURNS = (
    _CHATS
    + """cturns AS (SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY pos) - 1 AS turn_no, 0 AS session_id,
  participant, content, pos FROM chats WHERE content <> '')"""
)
_STREAM = """stream AS (SELECT user_id % 4 AS transcript_id, epoch_us(ts) AS pos, event_id::VARCHAR AS id, user_id::VARCHAR AS author_id,
  CASE user_id % 3 WHEN 0 THEN 'self' WHEN 1 THEN 'target' ELSE 'other' END AS participant, event_type AS content, epoch_us(ts) AS us FROM events), """
_STREAM_TURNS = (
    _STREAM
    + """lagged AS (SELECT *, lag(us) OVER w AS lus, lag(participant) OVER w AS lp, lag(author_id) OVER w AS la FROM stream
  WINDOW w AS (PARTITION BY transcript_id ORDER BY pos)),
numbered AS (SELECT *, sum(CASE WHEN participant = lp AND author_id = la AND us - lus <= 300000000 THEN 0 ELSE 1 END)
  OVER (PARTITION BY transcript_id ORDER BY pos) - 1 AS turn_no FROM lagged),
bare AS (SELECT transcript_id, turn_no, arg_min(participant, pos) AS participant, arg_min(author_id, pos) AS author_id,
  string_agg(content, chr(10) ORDER BY pos) AS content, string_agg(id, ',' ORDER BY pos) AS ids, list(id ORDER BY pos) AS source_ids,
  count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM numbered GROUP BY ALL),
tlag AS (SELECT *, lag(end_us) OVER (PARTITION BY transcript_id ORDER BY turn_no) AS before_us FROM bare),
turns AS (SELECT *, sum(CASE WHEN before_us IS NULL OR start_us - before_us > 1800000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY transcript_id ORDER BY turn_no) - 1 AS session_id FROM tlag)"""
)


def _windows_sql(turns: str, width: int, extra: str = "", columns: str = "") -> str:
    """Windows of the last turns: list of structs from the first context turn on."""
    return f"""framed AS (SELECT *, list({{'p': participant, 'c': content{extra}}}) OVER (PARTITION BY transcript_id, session_id ORDER BY turn_no
  ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS h FROM {turns}),
cut AS (SELECT *, list_position(list_transform(h, lambda t: t.p <> 'target'), true) AS f FROM framed),
windows AS (SELECT transcript_id, session_id, turn_no{columns}, h[f:] AS h FROM cut WHERE participant = 'target' AND f > 0)"""


_USABLE = """usable AS (SELECT DISTINCT transcript_id, session_id FROM windows),
ordered AS (SELECT *, row_number() OVER (ORDER BY transcript_id, session_id) - 1 AS session_no, count(*) OVER () AS total FROM usable),
counted AS (SELECT *, greatest(1, floor(total * 0.075::DOUBLE)) AS held FROM ordered),
split AS (SELECT transcript_id, session_id, session_no, CASE WHEN session_no < total - 2 * held THEN 'train'
  WHEN session_no < total - held THEN 'val' ELSE 'test' END AS split FROM counted)"""
_SAMPLES = """samples AS (SELECT w.*, s.split, s.session_no, row_number() OVER (
    PARTITION BY array_to_string(list_transform(h, lambda t: t.p || ':' || t.c), chr(2))
    ORDER BY CASE s.split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, s.session_no, w.turn_no) > 1 AS duplicate
  FROM windows w JOIN split s USING (transcript_id, session_id))"""
_SPELLED = "array_to_string(list_transform(h, lambda t: t.p || ': ' || t.c), chr(10))"


def spelled(history: str = "history"):
    return F.array_join(F.transform(history, lambda t: F.concat_ws(": ", t["participant"], t["content"])), "\n")


# ---- text functions ------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned, length({_CLEAN.format('text')}) AS n FROM documents")
def clean_text(spark, sf_dir):
    cleaned = T.clean_text("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned).alias("cleaned"), F.length(cleaned).cast("bigint").alias("n"))


@query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)")
def word_stats(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", T.word_tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


@query(f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)")
def sentence_stats(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return found.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query(
    f"SELECT page_id, {_EMOJI.format('html')} AS emoji, len(regexp_extract_all(html, '{_URL}')) AS urls, "
    "len(regexp_extract_all(html, '(?s)```.*?```')) AS code_blocks FROM pages"
)
def emoji_url_code_counts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", T.count_emoji("html").alias("emoji"), T.count_urls("html").alias("urls"), T.count_code_blocks("html").alias("code_blocks"))


@query(f"SELECT md5({_KEY.format('text')}) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def norm_dup_key(spark, sf_dir):
    keyed = read(spark, sf_dir, "documents").select("doc_id", F.md5(T.duplicate_key("text")).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Lu}')) AS upper,
  text = lower(text) AND regexp_matches(text, '\p{L}') AS lower_message,
  regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]') AS shouting FROM documents"""
)
def casing_features(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", T.letters("text").alias("letters"), T.upper_letters("text").alias("upper"), T.is_lowercase("text").alias("lower_message"), T.is_shouting("text").alias("shouting")
    )


@query(
    f"""WITH w AS (SELECT {_STRIP.format('text')} AS t FROM documents)
SELECT CASE WHEN length(t) <= 3 THEN repeat('*', length(t)::INT) ELSE left(t, 3) || repeat('*', least(length(t) - 3, 12)::INT) || ' (' || length(t) || ' chars)' END AS redacted,
  count(*) AS n FROM w GROUP BY 1"""
)
def redacted_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(T.redact("text").alias("redacted")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s(i, v) AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 3 THEN 'garbage' WHEN 4 THEN strftime(ts, '%Y-%m-%d') ELSE NULL END FROM events)
SELECT i AS event_id, epoch_us(CASE i % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 4 THEN date_trunc('day', ts) END) AS us FROM s JOIN events ON event_id = i"""
)
def parsed_times(spark, sf_dir):
    n, ts = F.col("event_id") % 6, F.col("ts").cast("timestamp")
    text = (
        F.when(n == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(n == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(n == 3, "garbage")
        .when(n == 4, F.date_format(ts, "yyyy-MM-dd"))
    )
    return read(spark, sf_dir, "events").select("event_id", F.unix_micros(T.parse_iso(text)).alias("us"))


# ---- message filters -----------------------------------------------------------------------------

_ALL = FilterConfig(drop_commands=True, drop_url_only=True, drop_duplicate_messages=True, max_message_chars=8000, max_code_blocks=1)
_DELETED = (
    r"(?i)^(?:\[|<|\()?\s*(?:original\s+)?(?:message\s+)?(?:deleted|removed|redacted)(?:\s+message)?(?:\s+by\s+.+?)?\s*(?:\]|>|\))?$"
    r"|^this message was deleted\.?$"
)
_REASONS = f"""WITH m AS (SELECT lang AS transcript_id, doc_id AS pos, {_CLEAN.format('text')} AS t FROM documents),
r AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '{_DELETED}') THEN 'deleted_placeholder'
  WHEN regexp_matches(t, '^[!/$.;>~%&+\\-]{{1,2}}[A-Za-z][\\w-]*\\b') THEN 'command'
  WHEN {_STRIP.format(f"regexp_replace(t, '{_URL}', '', 'g')")} = '' THEN 'url_only' WHEN length(t) > 8000 THEN 'oversized'
  WHEN len(regexp_extract_all(t, '(?s)```.*?```')) > 1 THEN 'code_heavy' END AS first_reason, {_KEY.format('t')} AS k FROM m),
c AS (SELECT *, coalesce(first_reason, CASE WHEN row_number() OVER (PARTITION BY transcript_id, first_reason, k ORDER BY pos) > 1 THEN 'duplicate_message' END) AS reason FROM r)
"""


@query(_REASONS + "SELECT transcript_id, pos, reason FROM c")
def filter_reasons(spark, sf_dir):
    return classify(documents(spark, sf_dir), _ALL).select("transcript_id", "pos", "reason")


@query(_REASONS + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM c GROUP BY 1")
def filter_reason_counts(spark, sf_dir):
    return filter_report(classify(documents(spark, sf_dir), _ALL))


@query(_REASONS + "SELECT transcript_id, count(*) AS n, sum(pos) AS ids FROM c WHERE reason IS NULL GROUP BY 1")
def kept_messages(spark, sf_dir):
    return filter_messages(documents(spark, sf_dir), _ALL).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("ids"))


# ---- turns, sessions, windows --------------------------------------------------------------------


@query(f"WITH {_STREAM_TURNS} SELECT transcript_id, turn_no, participant, author_id, content, ids, start_us, end_us FROM bare")
def events_turns(spark, sf_dir):
    return aggregate_turns(stream(spark, sf_dir), spread=True).select(
        "transcript_id",
        "turn_no",
        "participant",
        "author_id",
        "content",
        F.array_join("source_ids", ",").alias("ids"),
        F.unix_micros("ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"),
    )


@query(f"WITH {_STREAM_TURNS} SELECT transcript_id, turn_no, session_id FROM turns")
def events_sessions(spark, sf_dir):
    return stream_turns(spark, sf_dir).select("transcript_id", "turn_no", "session_id")


@query(f"WITH {_STREAM_TURNS} SELECT transcript_id, session_id, count(*) AS turns, sum(n) AS messages FROM turns GROUP BY ALL")
def events_session_sizes(spark, sf_dir):
    sized = stream_turns(spark, sf_dir).groupBy(*SESSION)
    return sized.agg(F.count(F.lit(1)).alias("turns"), F.sum(F.size("source_ids")).alias("messages"))


@query(
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(ts) - epoch_us(b) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, s"""
)
def events_sessions_native(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = known_time_sessions(events, ["user_id"], "ts")
    return found.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n")


@query(f"WITH {_CHAT_TURNS} SELECT transcript_id, turn_no, session_id, participant, content FROM cturns")
def conv_turns(spark, sf_dir):
    return chat_turns(spark, sf_dir).select("transcript_id", "turn_no", "session_id", "participant", "content")


@query(f"WITH {_CHAT_TURNS}, {_windows_sql('cturns', 6)} SELECT transcript_id, session_id, turn_no, len(h) AS n, {_SPELLED} AS sample FROM windows")
def windows_w6(spark, sf_dir):
    return build_windows(chat_turns(spark, sf_dir), 6).select(*SESSION, "turn_no", F.size("history").cast("bigint").alias("n"), spelled().alias("sample"))


@query(f"WITH {_STREAM_TURNS}, {_windows_sql('turns', 2)} SELECT transcript_id, session_id, turn_no, len(h) AS n, {_SPELLED} AS sample FROM windows")
def windows_w2(spark, sf_dir):
    return build_windows(placed_turns(spark, sf_dir, "participant", "content"), 2).select(*SESSION, "turn_no", F.size("history").cast("bigint").alias("n"), spelled().alias("sample"))


@query(f"WITH {_STREAM_TURNS}, {_windows_sql('turns', 6)} SELECT transcript_id, count(DISTINCT session_id) AS n FROM windows GROUP BY 1")
def usable_session_counts(spark, sf_dir):
    return usable_sessions(placed_turns(spark, sf_dir, "participant")).groupBy("transcript_id").agg(F.countDistinct("session_id").alias("n"))


@query(
    """WITH c AS (SELECT *, len(string_split(text, ' ')) AS cost, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS s FROM conversations),
w AS (SELECT *, sum(s) OVER b AS nth, sum(cost * s) OVER b AS tail, sum(cost * (1 - s)) OVER (PARTITION BY conv_id) AS sys, sum(s) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW b AS (PARTITION BY conv_id ORDER BY turn DESC)),
f AS (SELECT *, max(CASE WHEN s = 1 AND tail + sys <= 120 AND (n - nth) % 2 = 0 THEN nth END) OVER (PARTITION BY conv_id) AS keep FROM w)
SELECT conv_id, turn FROM f WHERE keep IS NOT NULL AND (s = 0 OR nth <= keep)"""
)
def context_trim(spark, sf_dir):
    cost = F.size(F.split("text", " "))
    said = read(spark, sf_dir, "conversations")
    # Only chats whose newest messages fit can be trimmed to the budget.
    reach = trimmable(said, cost, 120)
    return trim_history(said.join(reach, "conv_id", "left_semi"), cost, 120, ["conv_id"], "turn").select("conv_id", "turn")


def _word_counter():
    """A token counter as a user would bring one: it sees a whole chat."""
    return lambda chat: sum(len(m["content"].split(" ")) for m in chat)


def _tagged():
    """A chat template as a user would bring one."""
    return lambda chat: "".join(f"<|{m['role']}|>{m['content']}</s>" for m in chat)


def whole_chats(spark, sf_dir):
    """``conv_id, messages`` of each conversation, in order."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    found = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("said"))
    return found.select("conv_id", F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query(
    """WITH c AS (SELECT *, len(string_split(text, ' ')) AS cost, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS s FROM conversations),
w AS (SELECT *, sum(s) OVER b AS nth, sum(cost * s) OVER b AS tail, sum(cost * (1 - s)) OVER (PARTITION BY conv_id) AS sys, sum(s) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW b AS (PARTITION BY conv_id ORDER BY turn DESC)),
k AS (SELECT conv_id, max(CASE WHEN s = 1 AND tail + sys <= 120 AND (n - nth) % 2 = 0 THEN nth END) AS keep, sum(1 - s) AS lead FROM w GROUP BY 1)
SELECT conv_id, (keep + lead)::BIGINT AS n_kept, CASE WHEN keep IS NULL THEN 'too long' END AS problem FROM k"""
)
def chats_trimmed(spark, sf_dir):
    """Chats within the budget of a user's own counter."""
    found = whole_chats(spark, sf_dir).select("conv_id", hooks.trim(hooks.Hook("words of a chat", _word_counter), F.col("messages"), 120).alias("t"))
    return found.select("conv_id", F.size("t.messages").cast("bigint").alias("n_kept"), "t.problem").withColumn("n_kept", F.when(F.col("problem").isNull(), F.col("n_kept")))


@query("SELECT conv_id, md5(string_agg('<|' || role || '|>' || text || '</s>', '' ORDER BY turn)) AS rendered, sum(length(text) + length(role) + 8)::BIGINT AS n_chars FROM conversations GROUP BY 1")
def chats_rendered(spark, sf_dir):
    """Chats by a user's own template."""
    found = whole_chats(spark, sf_dir).select("conv_id", hooks.render(hooks.Hook("tags", _tagged), F.col("messages")).alias("r"))
    return found.select("conv_id", F.md5("r").alias("rendered"), F.length("r").cast("bigint").alias("n_chars"))


@query(f"WITH {_CHAT_TURNS} SELECT transcript_id, turn_no, session_id::BIGINT AS session_id, participant, md5(content) AS digest FROM cturns")
def chats_grouped(spark, sf_dir):
    """The short form of turns and sessions, over range partitions."""
    found = compat.group_consecutive_messages(chats(spark, sf_dir), spread=True)
    return found.select("transcript_id", "turn_no", "session_id", "participant", F.md5("content").alias("digest"))


def trimmable(messages: DataFrame, cost, budget: int) -> DataFrame:
    """Chats whose system messages and last one or two spoken ones fit, by the parity of the chat."""
    from pyspark.sql import Window

    back = Window.partitionBy("conv_id", "spoken").orderBy(F.desc("turn"))
    ranked = messages.select("conv_id", "turn", cost.alias("cost"), (F.col("role") != "system").alias("spoken")).withColumn("nth", F.row_number().over(back))
    n = F.count_if("spoken")
    last = F.sum(F.when(~F.col("spoken") | (F.col("nth") == 1), F.col("cost")))
    second = F.coalesce(F.sum(F.when(F.col("spoken") & (F.col("nth") == 2), F.col("cost"))), F.lit(0))
    needed = ranked.groupBy("conv_id").agg(n.alias("n"), last.alias("last"), second.alias("second"))
    return needed.where((F.col("n") > 0) & (F.col("last") + F.when(F.col("n") % 2 == 0, F.col("second")).otherwise(0) <= budget)).select("conv_id")


# ---- splits --------------------------------------------------------------------------------------

_SPLIT = f"WITH {_STREAM_TURNS}, {_windows_sql('turns', 6, extra=chr(44) + ' ' + chr(39) + 'i' + chr(39) + ': source_ids')}, {_USABLE}"


@query(_SPLIT + " SELECT transcript_id, session_id, session_no, split FROM split")
def split_chrono(spark, sf_dir):
    return split_sessions(usable_sessions(placed_turns(spark, sf_dir, "participant"))).select(*SESSION, "session_no", "split").distinct()


def split_windows(spark, sf_dir):
    split = split_sessions(usable_sessions(placed_turns(spark, sf_dir, "participant", "content", "source_ids")))
    places = materialize(split.select(*SESSION, "session_no", "split").distinct())
    windows = build_windows(split).join(sent(places), list(SESSION))
    return split, drop_duplicate_samples(windows, ["session_no", "turn_no"])


@query(_SPLIT + f", {_SAMPLES} SELECT split, session_no, turn_no, duplicate FROM samples")
def split_dedup(spark, sf_dir):
    return split_windows(spark, sf_dir)[1].select("split", "session_no", "turn_no", "duplicate")


@query(
    _SPLIT
    + f""", {_SAMPLES},
k AS (SELECT split, count(DISTINCT session_no) AS sessions FROM split GROUP BY 1),
d AS (SELECT split, count_if(NOT duplicate) AS samples, count_if(duplicate) AS duplicates_removed FROM samples GROUP BY 1),
i AS (SELECT split, transcript_id, unnest(flatten(list_transform(h, lambda t: t.i))) AS id FROM samples WHERE NOT duplicate),
m AS (SELECT split, count(DISTINCT (transcript_id, id)) AS messages FROM i GROUP BY 1)
SELECT split, sessions, coalesce(samples, 0) AS samples, coalesce(messages, 0) AS messages, coalesce(duplicates_removed, 0) AS duplicates_removed
FROM k LEFT JOIN d USING (split) LEFT JOIN m USING (split)"""
)
def split_counts(spark, sf_dir):
    return split_summary(*split_windows(spark, sf_dir))


@query(
    _SPLIT
    + f""", {_SAMPLES}, s AS (SELECT DISTINCT split, {_SPELLED} AS sample FROM samples WHERE NOT duplicate)
SELECT a.split AS a, b.split AS b, count(*) AS n FROM s a JOIN s b ON a.sample = b.sample AND a.split < b.split GROUP BY ALL"""
)
def split_leakage(spark, sf_dir):
    kept = split_windows(spark, sf_dir)[1].where("not duplicate").select("split", F.sha2(spelled(), 256).alias("d")).distinct()
    other = kept.select(F.col("split").alias("b"), "d")
    return kept.join(other, "d").where("split < b").groupBy(F.col("split").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


# ---- ShareGPT ------------------------------------------------------------------------------------


def samples(spark, sf_dir):
    """Whole conversations as samples, whatever they look like."""
    turn = F.struct("turn", F.element_at(F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt", "system", "system")]), F.col("role")).alias("from"), F.col("text").alias("value"))
    whole = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


_SAID = "CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE 'system' END"
_WHOLE = f"whole AS (SELECT conv_id, list({{'f': {_SAID}, 'v': text}} ORDER BY turn) AS c FROM conversations GROUP BY 1)"


@query(
    f"""WITH {_CHAT_TURNS}, {_windows_sql('cturns', 6)}
SELECT transcript_id AS conv_id, turn_no, array_to_string(list_transform(h, lambda t: CASE t.p WHEN 'target' THEN 'gpt' ELSE 'human' END || ': ' || t.c), chr(10)) AS sample FROM windows"""
)
def sharegpt_rows(spark, sf_dir):
    rows = build_windows(chat_turns(spark, sf_dir)).withColumn("c", conversations("history"))
    return rows.select(F.col("transcript_id").alias("conv_id"), "turn_no", F.array_join(F.transform("c", lambda t: F.concat_ws(": ", t["from"], t["value"])), "\n").alias("sample"))


@query(
    f"""WITH {_STREAM_TURNS}, {_windows_sql('turns', 3, extra=", 'l': author_id")}
SELECT transcript_id, turn_no, 'system: be brief' || chr(10) || array_to_string(list_transform(h, lambda t: CASE t.p WHEN 'target' THEN 'gpt: ' ELSE 'human: ' END
  || CASE t.p WHEN 'other' THEN 'user-' || t.l || ': ' ELSE '' END || t.c), chr(10)) AS sample FROM windows"""
)
def sharegpt_labels(spark, sf_dir):
    rows = build_windows(placed_turns(spark, sf_dir, "participant", "content", "author_id", "author_label"), 3).withColumn("c", conversations("history", "be brief", "others"))
    return rows.select("transcript_id", "turn_no", F.array_join(F.transform("c", lambda t: F.concat_ws(": ", t["from"], t["value"])), "\n").alias("sample"))


_PROBLEM = f"""CASE WHEN len(c) < 2 THEN 'expected a conversation' WHEN len(list_filter(c, lambda t: {_STRIP.format('t.v')} = '')) > 0 THEN 'invalid role/content'
  WHEN len(d) = 0 OR d[1].f <> 'human' OR d[-1].f <> 'gpt' OR len(list_filter(d, lambda t: t.f = 'system')) > 0 THEN 'require user-to-assistant dialogue' END"""


@query(f"WITH {_WHOLE}, t AS (SELECT *, CASE WHEN c[1].f = 'system' THEN c[2:] ELSE c END AS d FROM whole) SELECT conv_id, {_PROBLEM} AS problem FROM t")
def sharegpt_problems(spark, sf_dir):
    return samples(spark, sf_dir).select("conv_id", describe_problem("conversations").alias("problem"))


@query(f"WITH {_WHOLE} SELECT conv_id, len(c) - 1 AS context, c[-1].v AS answer, len(list_filter(c, lambda t: t.f = 'gpt')) AS answers FROM whole")
def sample_parts(spark, sf_dir):
    context, answer = split_sample("conversations")
    return samples(spark, sf_dir).select("conv_id", F.size(context).cast("bigint").alias("context"), answer.alias("answer"), F.size(answers("conversations")).cast("bigint").alias("answers"))


@query(
    _SPLIT
    + f""", {_SAMPLES} SELECT session_no, turn_no FROM samples WHERE split = 'train' AND {_SPELLED} IN (SELECT {_SPELLED} FROM samples WHERE split = 'val')"""
)
def train_val_overlap(spark, sf_dir):
    """The training windows that are validation windows too, before equal samples are dropped."""
    every = split_windows(spark, sf_dir)[1]
    # Who said a turn is told apart by more than ShareGPT roles, as the signature of a sample does.
    turns = F.transform("history", lambda t: F.struct(t["participant"].alias("from"), t["content"].alias("value")))
    every = every.withColumn("conversations", turns)
    return overlap(every.where("split = 'train'"), every.where("split = 'val'")).select("session_no", "turn_no")


@query(
    f"""WITH {_WHOLE}, g AS (SELECT array_to_string(list_transform(c, lambda t: t.f || t.v), chr(2)) AS k, count(*) AS n, sum(len(c)) AS t, max(len(c)) AS m FROM whole GROUP BY 1)
SELECT sum(n)::BIGINT AS samples, sum(n - 1)::BIGINT AS duplicate_samples, round(sum(t) / sum(n), 6) AS mean_turns, max(m) AS max_turns FROM g"""
)
def turns_per_sample(spark, sf_dir):
    return profiling.sample_counts(samples(spark, sf_dir)).withColumn("mean_turns", F.round("mean_turns", 6))


@query(
    f"""WITH {_WHOLE}, r AS (SELECT conv_id, array_to_string(list_transform(c, lambda t: '<' || t.f || '>' || t.v), '') AS r, list_filter(c, lambda t: t.f = 'gpt') AS a FROM whole),
p AS (SELECT conv_id, generate_subscripts(string_split(r, '<gpt>'), 1) AS i, r FROM r), q AS (SELECT conv_id, i, r, string_split(r, '<gpt>') AS s FROM p WHERE i > 1),
z AS (SELECT conv_id, i - 1 AS n, length(array_to_string(s[:i - 1], '<gpt>')) + 5 AS start, string_split(array_to_string(s[i:], '<gpt>'), '<human>')[1] AS t FROM q)
SELECT conv_id, n AS span_no, start, start + length(t) AS "end" FROM z"""
)
def masked_answers(spark, sf_dir):
    rendered = F.array_join(F.transform("conversations", lambda t: F.concat(F.lit("<"), t["from"], F.lit(">"), t["value"])), "")
    spans = samples(spark, sf_dir).select("conv_id", F.posexplode(masked_spans(rendered, "<human>", "<gpt>")).alias("i", "s"))
    return spans.select("conv_id", (F.col("i") + 1).cast("bigint").alias("span_no"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(
    f"""WITH {_WHOLE}, r AS (SELECT conv_id, string_split(array_to_string(list_transform(c, lambda t: '<' || t.f || '>' || t.v), ''), '<gpt>') AS s,
  list_reverse(list_filter(list_transform(list_filter(c, lambda t: t.f = 'gpt'), lambda t: t.v), lambda v: length(v) >= 300)) AS a FROM whole),
k AS (SELECT conv_id, a, list_transform(range(2, len(s) + 1), lambda i: string_split(array_to_string(s[i:], '<gpt>'), '<human>')[1]) AS spans FROM r)
SELECT conv_id, CASE WHEN len(spans) <> len(a) THEN len(spans) || ' stretches keep loss, but there are ' || len(a) || ' answers'
  WHEN len(list_filter(range(1, len(a) + 1), lambda i: NOT (trim(a[i]) = '' OR contains(spans[i], a[i])))) > 0 THEN 'an answer lies outside the stretch that keeps loss' END AS problem FROM k"""
)
def masking_checks(spark, sf_dir):
    """Answers in the wrong order, and without short ones: what the check of the masking says of them."""
    rendered = F.array_join(F.transform("conversations", lambda t: F.concat(F.lit("<"), t["from"], F.lit(">"), t["value"])), "")
    given = F.reverse(F.filter(answers("conversations"), lambda a: F.length(a) >= 300))
    chats = samples(spark, sf_dir).select("conv_id", rendered.alias("rendered"), given.alias("answers"))
    return masking_problems(chats, "<human>", "<gpt>").select("conv_id", "problem")


@query(
    f"""WITH {_WHOLE} SELECT conv_id, generate_subscripts(c, 1) - 1 AS message_no,
  CASE unnest(c).f WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE 'system' END AS role, unnest(c).v AS content FROM whole"""
)
def chat_messages(spark, sf_dir):
    said = samples(spark, sf_dir).select("conv_id", F.posexplode(to_chat_messages("conversations")).alias("i", "m"))
    return said.select("conv_id", F.col("i").cast("bigint").alias("message_no"), "m.role", "m.content")


@query(f"WITH {_WHOLE} SELECT conv_id, generate_subscripts(a, 1) - 1 AS answer_no, unnest(a).v AS text FROM (SELECT conv_id, list_filter(c, lambda t: t.f = 'gpt') AS a FROM whole)")
def assistant_texts(spark, sf_dir):
    """The answers once more, read from role and content messages."""
    said = samples(spark, sf_dir).select("conv_id", to_chat_messages("conversations").alias("messages"))
    found = said.select("conv_id", F.posexplode(assistant_messages("messages")).alias("i", "text"))
    return found.select("conv_id", F.col("i").cast("bigint").alias("answer_no"), "text")


@query(
    """WITH n AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS resp_id, text FROM conversations),
r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS resp_id, text FROM conversations WHERE role = 'assistant')
SELECT 'reference' AS corpus, resp_id, text FROM r UNION ALL SELECT 'all turns', resp_id, text FROM n WHERE resp_id < (SELECT count(*) FROM r)"""
)
def predictions_paired(spark, sf_dir):
    """All turns as predictions for the answers, paired by their number; those beyond the last answer are left out."""
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    references = number_rows(said.where("role = 'assistant'"), ["conv_id", "turn"], "ordinal")
    return pair_predictions(references, number_rows(said, ["conv_id", "turn"], "ordinal"), "all turns")


# ---- speakers ------------------------------------------------------------------------------------


def records(spark, sf_dir):
    return stream(spark, sf_dir).withColumns({"identity_key": F.col("author_id"), "display_name": F.col("username")}).drop("participant")


@query("SELECT user_id % 4 AS transcript_id, user_id::VARCHAR AS key, 'user-' || user_id AS names, count(*) AS messages FROM events GROUP BY ALL")
def participants(spark, sf_dir):
    found = collect_participants(records(spark, sf_dir))
    return found.select("transcript_id", "key", F.array_join("names", ",").alias("names"), "messages")


@query(
    """WITH m AS (SELECT user_id % 4 AS transcript_id, epoch_us(ts) AS pos, CASE user_id WHEN 8 THEN 'target' WHEN 4 THEN 'self' ELSE 'other' END AS participant FROM events),
b AS (SELECT *, sum(CASE WHEN participant = 'other' THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY pos) AS session_id FROM m)
SELECT transcript_id, pos, participant, session_id::BIGINT AS session_id FROM b WHERE participant <> 'other'"""
)
def others_drop_boundary(spark, sf_dir):
    return label_messages(records(spark, sf_dir), "4", "8", "drop", spread=True).select("transcript_id", "pos", "participant", "session_id")


@query(
    """WITH m AS (SELECT user_id % 4 AS transcript_id, epoch_us(ts) AS pos, event_id % 9000 AS id, epoch_us(ts) - (event_id % 7) * 60000000 AS us FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, id ORDER BY pos) > 1 AS again,
  us < last_value(us) OVER (PARTITION BY transcript_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM m)
SELECT transcript_id, pos, 'duplicate_id' AS code FROM c WHERE again UNION ALL SELECT transcript_id, pos, 'order' FROM c WHERE back"""
)
def violations(spark, sf_dir):
    messages = stream(spark, sf_dir)
    back = F.timestamp_micros(F.col("pos") - (F.col("id").cast("bigint") % 7) * 60_000_000)
    messages = messages.withColumn("timestamp", back.cast("string")).withColumn("id", (F.col("id").cast("bigint") % 9000).cast("string"))
    return message_violations(messages, spread=True).select("transcript_id", "pos", "code")


@query(
    """SELECT transcript_id, level, n FROM (SELECT user_id % 4 AS transcript_id, 1 AS level, count(DISTINCT user_id) AS n FROM events WHERE user_id = 17 GROUP BY 1
UNION ALL SELECT user_id % 4, 0, count(DISTINCT user_id) FROM events WHERE user_id = 23 GROUP BY 1)"""
)
def speaker_matches(spark, sf_dir):
    """Whom two references mean: a name, and an id."""
    found = materialize(collect_participants(records(spark, sf_dir)))
    mine = [matches(found.where(F.col("transcript_id") == t), ref).select(F.lit(t).cast("bigint").alias("transcript_id"), "level", "n") for t, ref in ((17 % 4, "user-17"), (23 % 4, "23"))]
    return mine[0].unionByName(mine[1])


@query(f"""WITH {_WHOLE} SELECT conv_id, generate_subscripts(a, 1) - 1 AS answer_no, unnest(a).v AS text FROM (SELECT conv_id, list_filter(c, lambda t: t.f = 'gpt') AS a FROM whole)""")
def target_responses(spark, sf_dir):
    return profiling.target_responses(samples(spark, sf_dir)).select("conv_id", F.col("answer_no").cast("bigint").alias("answer_no"), "text")


@query(
    f"""WITH b AS (SELECT lang AS transcript_id, doc_id AS pos, source = 'forum' OR doc_id % 7 = 0 AS bot, {_CLEAN.format("text")} AS t FROM documents)
SELECT transcript_id, pos, CASE WHEN t = '' THEN 'empty' WHEN bot THEN 'bot' WHEN regexp_matches(t, '{_DELETED}') THEN 'deleted_placeholder' END AS reason FROM b"""
)
def filter_bots(spark, sf_dir):
    bot = (F.col("source") == "forum") | (F.col("doc_id") % 7 == 0)
    said = read(spark, sf_dir, "documents").select(F.col("lang").alias("transcript_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), bot.alias("bot"))
    return classify(said).select("transcript_id", "pos", "reason")


#: Messages that the tables do not hold, around a name that they do.
_MADE = ("Message deleted by {0}", "[{0}]", "!play {0}", "see https://a.example/{0}", "https://a.example/{0} www.b.example", "```{0}``` ```x```", "\U0001f600 {0} \u2764\ufe0f <a:wave:12>", "key sk-abcdefghij{0}0123456789", "-----BEGIN RSA PRIVATE KEY----- {0}", "in /home/{0}/notes.txt")
_MADE_ROWS = " UNION ALL ".join(f"SELECT event_id * {len(_MADE)} + {i} AS id, '" + t.replace("{0}", "' || event_type || '") + "' AS text FROM events" for i, t in enumerate(_MADE))


def made(spark, sf_dir):
    """Ten messages of each event, of kinds that the tables lack."""
    texts = F.array(*[F.concat(F.lit(t.split("{0}")[0]), F.col("event_type"), F.lit(t.split("{0}")[1])) for t in _MADE])
    rows = read(spark, sf_dir, "events").select("event_id", F.posexplode(texts).alias("i", "text"))
    return rows.select((F.col("event_id") * len(_MADE) + F.col("i")).alias("id"), "text")


@query(
    f"""WITH m AS ({_MADE_ROWS}) SELECT id, {_EMOJI.format("text")} AS emoji, len(regexp_extract_all(text, '{_URL}')) AS urls, len(regexp_extract_all(text, '(?s)```.*?```')) AS code_blocks,
  regexp_replace(text, '(?s)```.*?```', ' ', 'g') AS bare FROM m"""
)
def made_markers(spark, sf_dir):
    """Emoji, links and code blocks, and texts without code."""
    return made(spark, sf_dir).select("id", T.count_emoji("text").alias("emoji"), T.count_urls("text").alias("urls"), T.count_code_blocks("text").alias("code_blocks"), T.strip_code_blocks("text").alias("bare"))


@query(
    f"""WITH m AS ({_MADE_ROWS}) SELECT id, CASE WHEN regexp_matches(text, '{_DELETED}') THEN 'deleted_placeholder' WHEN regexp_matches(text, '^[!/$.;>~%&+\\-]{{1,2}}[A-Za-z][\\w-]*\\b') THEN 'command'
  WHEN {_STRIP.format(f"regexp_replace(text, '{_URL}', '', 'g')")} = '' THEN 'url_only' WHEN len(regexp_extract_all(text, '(?s)```.*?```')) > 1 THEN 'code_heavy' END AS reason FROM m"""
)
def made_reasons(spark, sf_dir):
    """Deleted messages, commands, bare links and heaps of code among messages of other kinds."""
    said = made(spark, sf_dir).select(F.lit("made").alias("transcript_id"), F.col("id").alias("pos"), F.col("text").alias("content"))
    config = FilterConfig(drop_commands=True, drop_url_only=True, max_code_blocks=1)
    return classify(said, config).select(F.col("pos").alias("id"), "reason")


@query(
    f"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(9) || chr(10) || chr(13) WHEN 2 THEN NULL ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN {_CLEAN.format('text')} = '' THEN 'empty' END AS reason FROM m"""
)
def blank_reasons(spark, sf_dir):
    """Documents of which three in four are made empty, white or null."""
    kind = F.pmod(F.col("doc_id"), F.lit(4))
    blank = F.when(kind == 0, "").when(kind == 1, " \t\n\r").when(kind == 2, F.lit(None)).otherwise(F.col("text"))
    said = read(spark, sf_dir, "documents").select(F.lit("made").alias("transcript_id"), F.col("doc_id").alias("pos"), blank.alias("content"))
    found = classify(said, FilterConfig(drop_deleted_placeholders=False))
    return found.select(F.col("pos").alias("doc_id"), "reason")


@query("SELECT doc_id, md5(replace(coalesce(text, ''), 'en', '[REDACTED_TOKEN]')) AS digest FROM documents")
def token_masked(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.mask_token("text", "en")).alias("digest"))


# ---- profiles of texts -----------------------------------------------------------------------------


@query(
    f"""WITH m AS (SELECT lang, len({_WORDS.format('text')}) AS w, length(text) AS c FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM m)
SELECT lang, count(*) AS count, round(avg(w), 6) AS mean_words, median(w)::DOUBLE AS median_words, max(CASE WHEN i = least(n - 1, floor(n * 0.9::DOUBLE)) THEN w END) AS p90_words,
  max(w) AS max_words, round(avg(c), 6) AS mean_characters, round(avg(CASE WHEN w <= 1 THEN 1 ELSE 0 END), 6) AS single_word_share FROM r GROUP BY 1"""
)
def length_stats(spark, sf_dir):
    found = profiling.length_stats(read(spark, sf_dir, "documents"), ["lang"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean_words", "mean_characters", "single_word_share")})


@query(
    f"SELECT lower(url[:10]) AS host, sum(len(regexp_extract_all(html, '{_URL}')))::BIGINT AS urls, sum(len(regexp_extract_all(html, '(?s)```.*?```')))::BIGINT AS code_blocks, "
    f"sum({_EMOJI.format('html')})::BIGINT AS emoji FROM pages GROUP BY 1"
)
def markers(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").withColumn("host", F.lower(F.col("url").substr(1, 10)))
    return profiling.content_markers(pages, ["host"], "html")


@query(
    f"""WITH e AS (SELECT lang, {_KEY.format('text')} AS k, text, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT lang, k, sum(n) AS n, sum(n - 1) AS e FROM e GROUP BY ALL)
SELECT lang, sum(e)::BIGINT AS exact_duplicates, sum(n - 1)::BIGINT AS near_duplicates, count(*) AS "distinct" FROM k GROUP BY 1"""
)
def duplicate_counts(spark, sf_dir):
    return profiling.duplicate_counts(read(spark, sf_dir, "documents"), ["lang"])


@query(
    f"""WITH {_STREAM_TURNS} SELECT transcript_id, count(*) AS turns, count_if(participant = 'target') AS target_turns, max(session_id)::BIGINT + 1 AS sessions,
  (SELECT count(*) FROM (WITH {_windows_sql('turns', 6)} SELECT DISTINCT transcript_id, session_id FROM windows) u WHERE u.transcript_id = turns.transcript_id) AS usable_sessions
FROM turns GROUP BY 1"""
)
def transcript_counts(spark, sf_dir):
    return profiling.session_counts(placed_turns(spark, sf_dir, "participant")).drop("windows")


@query(
    """SELECT user_id % 4 AS transcript_id, count(*) AS total, count_if(user_id % 3 = 0) AS self, count_if(user_id % 3 = 1) AS target, count_if(user_id % 3 = 2) AS other,
  0::BIGINT AS empty, 0::BIGINT AS invalid, 1.0::DOUBLE AS coverage, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1"""
)
def message_counts(spark, sf_dir):
    found = profiling.message_counts(stream(spark, sf_dir))
    return found.select("transcript_id", "total", "self", "target", "other", "empty", "invalid", "coverage", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


# ---- audit ---------------------------------------------------------------------------------------

_SIMPLE = ("api_credential", "credential_assignment", "private_key", "email", "filesystem_path", "url")


def _rule_sql(name: str) -> str:
    pattern = next(r.pattern for r in audit.RULES if r.name == name).replace("'", "''")
    return f"SELECT doc_id, '{name}' AS rule, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM documents"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# A number is looked for at the beginning of what is left; what is left begins with the character behind it.
_PHONE = r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]?\d{3,4}"
_EDGE = r"[^\p{L}\p{N}_.]"
_FOUND = f"""WITH RECURSIVE phones AS (SELECT doc_id, ' ' || text || ' ' AS rest, '' AS m FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, substr(rest, strpos(rest, whole) + length(whole) - 1), regexp_extract(whole, '({_PHONE}){_EDGE}$', 1)
  FROM (SELECT doc_id, rest, regexp_extract(rest, '{_EDGE}(?:{_PHONE}){_EDGE}') AS whole FROM phones) WHERE whole <> ''),
found AS ({" UNION ALL ".join(map(_rule_sql, _SIMPLE))}
UNION ALL SELECT doc_id, 'ip_address', m FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_.]+')) AS m FROM documents) WHERE regexp_full_match(m, '(?:{_OCTET}\\.){{3}}{_OCTET}')
UNION ALL SELECT doc_id, 'long_identifier', m FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\d+')) AS m FROM documents) WHERE length(m) >= 12
UNION ALL SELECT doc_id, 'phone_number', m FROM phones WHERE m <> '')
"""
_REDACTED = "CASE WHEN length(m) <= 3 THEN repeat('*', length(m)::INT) ELSE left(m, 3) || repeat('*', least(length(m) - 3, 12)::INT) || ' (' || length(m) || ' chars)' END"


def document_findings(spark, sf_dir):
    """Findings of all rules in the documents."""
    return audit.findings(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(_FOUND + f"SELECT doc_id, rule, {_REDACTED.replace('m)', 'trim(m))').replace('left(m,', 'left(trim(m),')} AS redacted FROM found")
def audit_findings(spark, sf_dir):
    return document_findings(spark, sf_dir).select("doc_id", "rule", "redacted")


@query(_FOUND + "SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS documents FROM found GROUP BY 1")
def audit_rule_counts(spark, sf_dir):
    return document_findings(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(
    _FOUND
    + """SELECT CASE WHEN rule IN ('api_credential', 'credential_assignment', 'private_key') THEN 'high' WHEN rule IN ('email', 'phone_number', 'ip_address') THEN 'medium' ELSE 'low' END AS severity,
  count(*) AS n FROM found GROUP BY 1"""
)
def audit_severity(spark, sf_dir):
    return audit.severity_counts(document_findings(spark, sf_dir))


@query(
    f"WITH m AS ({_MADE_ROWS}), f AS ("
    + " UNION ALL ".join(_rule_sql(r).replace("doc_id", "id").replace("FROM documents", "FROM m") for r in ("api_credential", "private_key", "filesystem_path", "url"))
    + ") SELECT id, rule, count(*) AS n FROM f GROUP BY ALL"
)
def made_findings(spark, sf_dir):
    """Keys, paths and links of made messages."""
    rules = tuple(r for r in audit.RULES if r.name in ("api_credential", "private_key", "filesystem_path", "url"))
    return audit.findings(made(spark, sf_dir), rules=rules).groupBy("id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT doc_id, regexp_matches(text, '(?:^|[^\p{L}\p{N}_.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]?\d{3,4}(?:[^\p{L}\p{N}_.]|$)') AS phone FROM documents"""
)
def audit_phone_flag(spark, sf_dir):
    rule = next(r for r in audit.RULES if r.name == "phone_number")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("(?U)" + rule.pattern).alias("phone"))


@query(
    f"""WITH {_WHOLE}, g AS (SELECT array_to_string(list_transform(c, lambda t: t.f || t.v), chr(2)) AS k, count(*) AS n FROM whole GROUP BY 1),
a AS (SELECT {_KEY.format('text')} AS k, count(*) AS n, count_if(length(text) > 200) AS l FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT (SELECT sum(n)::BIGINT FROM g) AS samples, (SELECT sum(n - 1)::BIGINT FROM g) AS duplicate_samples, sum(l)::BIGINT AS long_responses, count_if(n >= 2) AS repeated_strings FROM a"""
)
def audit_totals(spark, sf_dir):
    return audit.audit_totals(samples(spark, sf_dir), long_chars=200, repeated=2)


# ---- style ---------------------------------------------------------------------------------------


@query(
    f"""WITH c AS (SELECT lang AS corpus, sum(length(text)) AS chars FROM documents WHERE text <> '' GROUP BY 1),
m AS (SELECT lang AS corpus, unnest(regexp_extract_all(text, '{_MARKS.format()}')) AS term FROM documents)
SELECT corpus, term, count(*) AS n, round(count(*) / any_value(chars), 6) AS freq FROM m JOIN c USING (corpus) GROUP BY ALL"""
)
def punctuation_profile(spark, sf_dir):
    return style.punctuation_profile(corpora(spark, sf_dir)).withColumn("freq", F.round("freq", 6))


_TERMS = f"words AS (SELECT lang AS corpus, doc_id, {_WORDS.format('text')} AS w FROM documents), "
_UNIGRAMS = (
    _TERMS
    + """terms AS (SELECT corpus, doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pl FROM words),
uni AS (SELECT corpus, term, count(*) AS freq, min({'d': doc_id, 'a': pl}) AS met FROM terms GROUP BY ALL),
unigrams AS (SELECT corpus, term, freq, row_number() OVER (PARTITION BY corpus ORDER BY freq DESC, met) AS rank FROM uni QUALIFY rank <= 400)"""
)
_PHRASES = """runs AS (SELECT corpus, doc_id, 2 AS n, unnest(range(1, len(w))) AS pl, w FROM words UNION ALL SELECT corpus, doc_id, 3, unnest(range(1, len(w) - 1)), w FROM words),
phr AS (SELECT corpus, array_to_string(w[pl:pl + n - 1], ' ') AS term, count(*) AS freq, min({'d': doc_id, 'n': n, 'a': pl}) AS met FROM runs GROUP BY ALL),
phrases AS (SELECT corpus, term, freq, row_number() OVER (PARTITION BY corpus ORDER BY freq DESC, met) AS rank FROM phr QUALIFY rank <= 400)"""


@query(f"WITH {_UNIGRAMS} SELECT * FROM unigrams")
def top_unigrams(spark, sf_dir):
    return style.top_unigrams(corpora(spark, sf_dir)).select("corpus", "term", "freq", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_TERMS}{_PHRASES} SELECT * FROM phrases")
def top_phrases(spark, sf_dir):
    return style.top_phrases(corpora(spark, sf_dir)).select("corpus", "term", "freq", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_TERMS}t AS (SELECT corpus, unnest(w) AS term FROM words) SELECT corpus, round(count(DISTINCT term) / count(*), 6) AS type_token_ratio FROM t GROUP BY 1")
def type_token(spark, sf_dir):
    return style.type_token_ratio(corpora(spark, sf_dir)).withColumn("type_token_ratio", F.round("type_token_ratio", 6))


_PROFILE = (
    f"""feats AS (SELECT lang AS corpus, len({_WORDS.format('text')}) AS w, length(text) AS c, len(regexp_extract_all(text, '{_MARKS.format()}')) AS p, {_EMOJI.format('text')} AS e,
  len(regexp_extract_all(text, '\\p{{L}}')) AS l, len(regexp_extract_all(text, '\\p{{Lu}}')) AS u, (text = lower(text) AND regexp_matches(text, '\\p{{L}}'))::INT AS lm,
  (regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '[\\p{{Ll}}\\p{{Lt}}]'))::INT AS sh, list_transform({_SENTENCES.format('text')}, lambda s: len({_WORDS.format('s')})) AS s
  FROM documents WHERE {_STRIP.format('text')} <> ''),
ttr AS (SELECT corpus, count(DISTINCT term) / count(*) AS t FROM (SELECT corpus, unnest(w) AS term FROM words) GROUP BY 1),
prof AS (SELECT corpus, count(*) AS responses, avg(w) AS mean_words, median(w) AS median_words, avg(c) AS mean_characters, sum(p) / sum(c) AS punctuation_rate, avg(e) AS emoji_per_response,
  avg((e > 0)::INT) AS emoji_response_share, sum(u) / sum(l) AS uppercase_ratio, avg(lm) AS lowercase_message_share, avg(sh) AS shouting_share,
  sum(list_sum(s)) / sum(len(s)) AS mean_sentence_words, sum(len(s)) / count(*) AS sentences_per_response, any_value(t) AS type_token_ratio FROM feats JOIN ttr USING (corpus) GROUP BY 1)"""
)
_SCALARS = (
    "mean_words", "median_words", "mean_characters", "punctuation_rate", "emoji_per_response", "emoji_response_share", "uppercase_ratio",
    "lowercase_message_share", "shouting_share", "mean_sentence_words", "sentences_per_response", "type_token_ratio",
)


@query(f"WITH {_TERMS}{_PROFILE} SELECT corpus, responses, {', '.join(f'round({c}, 6) AS {c}' for c in _SCALARS)} FROM prof")
def style_profile(spark, sf_dir):
    return style.scalar_profile(corpora(spark, sf_dir)).select("corpus", "responses", *[F.round(c, 6).alias(c) for c in _SCALARS])


def _ratio(c: str) -> str:
    return f"(CASE WHEN r.{c} = 0 AND p.{c} = 0 THEN 1.0 ELSE least(r.{c}, p.{c}) / greatest(r.{c}, p.{c}) END)"


def _rate(c: str) -> str:
    return f"greatest(0, 1 - abs(r.{c} - p.{c}))"


def _cosine(name: str, source: str) -> str:
    return f"""{name} AS (SELECT o.corpus, coalesce((SELECT sum(a.freq * b.freq) FROM {source} a JOIN {source} b USING (term) WHERE a.corpus = 'en' AND b.corpus = o.corpus), 0)
  / (sqrt((SELECT sum(freq * freq) FROM {source} WHERE corpus = 'en')) * sqrt((SELECT sum(freq * freq) FROM {source} WHERE corpus = o.corpus))) AS v FROM prof o WHERE o.corpus <> 'en')"""


@query(
    f"""WITH {_UNIGRAMS}, {_PHRASES}, {_PROFILE},
marks AS (SELECT lang AS corpus, unnest(regexp_extract_all(text, '{_MARKS.format()}')) AS term FROM documents),
punct AS (SELECT corpus, term, count(*)::DOUBLE AS freq FROM marks GROUP BY ALL),
{_cosine('cp', 'punct')}, {_cosine('cu', 'unigrams')}, {_cosine('cf', 'phrases')}
SELECT p.corpus, round(({_ratio('mean_words')} + {_ratio('median_words')} + {_ratio('mean_characters')}) / 3, 6) AS length_similarity,
  round((cp.v + {_ratio('punctuation_rate')}) / 2, 6) AS punctuation_similarity, round(({_ratio('emoji_per_response')} + {_rate('emoji_response_share')}) / 2, 6) AS emoji_style_similarity,
  round(({_rate('uppercase_ratio')} + {_rate('lowercase_message_share')} + {_rate('shouting_share')}) / 3, 6) AS casing_similarity,
  round((cu.v + {_rate('type_token_ratio')}) / 2, 6) AS lexical_similarity, round(cf.v, 6) AS phrase_similarity,
  round(({_ratio('mean_sentence_words')} + {_ratio('sentences_per_response')}) / 2, 6) AS sentence_similarity
FROM prof p JOIN prof r ON r.corpus = 'en' JOIN cp ON cp.corpus = p.corpus JOIN cu ON cu.corpus = p.corpus JOIN cf ON cf.corpus = p.corpus WHERE p.corpus <> 'en'"""
)
def style_components(spark, sf_dir):
    return style.compare(corpora(spark, sf_dir), "en").select("corpus", *[F.round(c, 6).alias(c) for c in style.WEIGHTS])


_FOURS = {n: f"round_even({n}, 4)" for n in style.WEIGHTS}


@query(
    f"""WITH found AS ({ORACLE_SQL['style_components']}) SELECT corpus, {', '.join(f'{r} AS {n}' for n, r in _FOURS.items())},
  round_even(100 * (({' + '.join(f'{r}::DECIMAL(12, 4)' for r in _FOURS.values())})::DOUBLE / {len(_FOURS)}), 1) AS persona_fidelity_score FROM found"""
)
def persona_scores(spark, sf_dir):
    """The score of each language's documents against those in English."""
    return style.persona_fidelity(style_components(spark, sf_dir))


@query(
    f"""WITH {_REASONS.removeprefix('WITH ')} SELECT l.quality, l.toxic, coalesce(c.reason, 'kept') AS reason, count(*) AS n FROM c JOIN labels l ON l.doc_id = c.pos GROUP BY ALL"""
)
def filter_by_label(spark, sf_dir):
    marked = classify(documents(spark, sf_dir), _ALL).select(F.col("pos").alias("doc_id"), F.coalesce("reason", F.lit("kept")).alias("reason"))
    return marked.join(read(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "reason").agg(F.count(F.lit(1)).alias("n"))
