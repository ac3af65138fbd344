"""Messages of one transcript at the same time: counted as peers, as the queries' SQL counts them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chatterforge import catalog
from chatterforge.operators.ordered import scan
from chatterforge.operators.validation import message_violations

#: Columns whose values hang on the order among peers, which SQL leaves open.
OPEN = {"events_turns": {"ids", "author_id"}}


@pytest.fixture(scope="module")
def tied(spark, sf_dir, tmp_path_factory):
    """Three copies of the events under other ids and users, at the same times."""
    folder = str(tmp_path_factory.mktemp("tied"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, users = events.agg(F.max("event_id") + 1, F.max("user_id") + 1).first()
    copies = events.crossJoin(spark.range(3)).withColumns({"event_id": F.col("event_id") + F.col("id") * n, "user_id": F.col("user_id") + F.col("id") * (users + -users % 12)})
    copies.drop("id").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["events_turns", "events_sessions", "events_session_sizes", "windows_w2", "split_dedup", "split_counts", "transcript_counts", "others_drop_boundary"])
def test_peers_equal_sql(spark, tied, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet/*.parquet'")
    found = con.sql(catalog.ORACLE_SQL[name])
    names = [c for c in found.columns if c not in OPEN.get(name, ())]
    mine = catalog.QUERIES[name](spark, tied).select(*names).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(repr(tuple(v for c, v in zip(found.columns, r) if c in names)) for r in found.fetchall())


@pytest.mark.parametrize("spread", [True, False])
def test_peers_share_their_counts(spark, spread):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = [("a", p, i, v) for p in range(60) for i, v in enumerate("xyzx"[: 1 + p % 4])]
        df = spark.createDataFrame(rows, "k string, p bigint, i bigint, v string").repartition(5)
        starts = {"n": lambda row, last: F.when(last.isNotNull() & (row["v"] == last["v"]), 0).otherwise(1)}
        found = scan(df, "k", "p", ["v"], starts, spread=spread, ties=["i"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    upto, n, last = {}, 0, None
    for _, p, _, v in rows:
        n += v != last
        upto[p], last = n, v
    assert sorted((r["p"], r["i"], r["n"]) for r in found) == [(p, i, upto[p]) for _, p, i, _ in rows]


@pytest.mark.parametrize("name", ["events_turns", "events_sessions", "split_dedup", "split_counts", "transcript_counts", "sharegpt_labels"])
def test_peers_of_one_user_equal_sql(spark, sf_dir, tmp_path, name):
    """Copies under other ids only: authors are told by the place, so all but the order of the ids is fixed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.agg(F.max("event_id") + 1).first()[0]
    copies = events.crossJoin(spark.range(3)).withColumn("event_id", F.col("event_id") + F.col("id") * n)
    copies.drop("id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.sql(catalog.ORACLE_SQL[name])
    names = [c for c in found.columns if c != "ids"]
    mine = catalog.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(repr(tuple(v for c, v in zip(found.columns, r) if c in names)) for r in found.fetchall())


def test_repeated_ids_at_one_time_equal_sql(spark, sf_dir, tmp_path):
    """Copies that share ids and times: all but one are repeated.  What is older than the one before hangs on the order of peers, which is by id and time here."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    spread = F.col("event_id") + F.col("id") * 4500
    events.crossJoin(spark.range(5)).withColumn("event_id", spread).drop("id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = catalog.ORACLE_SQL["violations"]
    rows = [r for r in con.sql(sql).fetchall() if r[2] == "duplicate_id"]
    fixed = sql.replace("ORDER BY pos ROWS", "ORDER BY pos, id::VARCHAR, us ROWS")
    rows += [r for r in con.sql(fixed).fetchall() if r[2] == "order"]
    mine = catalog.QUERIES["violations"](spark, str(tmp_path)).collect()
    assert fixed != sql and sorted(map(tuple, mine)) == sorted(rows)


@pytest.mark.parametrize("spread", [True, False])
def test_repeated_ids_without_a_transcript_or_place(spark, spread):
    rows = [(None, 1, "x"), (None, 1, "x"), (None, 1, "x"), (None, 2, "x"), ("a", None, "y"), ("a", None, "y"), ("a", 5, "y"), ("b", None, "z"), ("b", None, "z"), ("b", 7, "w")]
    df = spark.createDataFrame([(*r, "self", "hi") for r in rows], "transcript_id string, pos bigint, id string, participant string, content string")
    found = message_violations(df, spread).where("code = 'duplicate_id'").collect()
    expected = [(None, 1), (None, 1), (None, 2), ("a", None), ("a", None), ("b", None)]
    assert sorted(((r["transcript_id"], r["pos"]) for r in found), key=repr) == sorted(expected, key=repr)
