"""The text queries that have SQL, against it, on the smallest tables."""

import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from shelfsight.llm import oracle, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(oracle.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_words_are_encoded_like_whole_texts():
    tok = tokens.Tokens(Path(tokens.TOKENIZER).read_bytes())
    rng = random.Random(1)
    bits = ["a", "b ", " ", "  ", "\n", "\t", "é", "'s", "12", "日本", ".", "!?", "\r\n", "\x1c", "\x85 ", " ", " \n "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(5000)]
    for known in (False, True):
        column = pa.array([t.encode() for t in texts], pa.binary())
        got = tok.slice(column)
        assert [g[:-1].tolist() for g in got] == [tok.model.encode_ordinary(t) for t in texts], known
        assert tok.slice(column, count_only=True) == [len(g) for g in got]
