import duckdb
import pytest

from chatterforge.llm import pii_disclosure as P
from chatterforge.llm.queries import ORACLE_SQL, QUERIES


def compare(df, rows, columns):
    names = sorted(df.columns)
    assert names == sorted(columns)
    mine = sorted(repr([r[c] for c in names]) for r in df.collect())
    assert mine == sorted(repr([dict(zip(columns, r))[c] for c in names]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(ORACLE_SQL[name])
    compare(QUERIES[name](spark, sf_dir), found.fetchall(), list(found.columns))


def test_disclosing_terms_equal_their_sql(spark):
    rows = [(i, f"all texts share this; Zoë writes from boss{i % 3}@corp.example, number {'abcdefghijklmnopqrstuvwxyz'[i % 26]}") for i in range(5)]
    rows += [(70 + i, f"all texts share this; Zoë writes from boss{i % 3}@corp.example, number q{i}") for i in range(30)]
    rows += [(110 + i, f"all texts share this and nothing else {'ijklmnopq'[i % 9]}{i}") for i in range(600)]
    rows += [(50, "only ZOË the writer is here"), (51, rows[0][1]), (52, "zoëx writes"), (53, None), (54, "writes. Writes! WRITES@corp.example")]
    rows += [(60 + i, f"call +1 234 567 890{i % 2} or 10.0.0.{i % 2}, says marigold {i}") for i in range(8)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.sql(ORACLE_SQL["op3_pii_disclosure"])
    df = P.span_report(P.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")))
    compare(df, found.fetchall(), list(found.columns))
    assert any("removed" in r["spans"] for r in df.collect()) and any("generalised" in r["spans"] for r in df.collect())
