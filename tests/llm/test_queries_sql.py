"""Registered queries against their SQL, on the given tables and on rows with nulls, copies and odd texts."""

import pytest
from check_queries import compare, connect

from evenhand.llm.oracles import ORACLES
from evenhand.llm.queries import QUERIES

ODD = [
    (1, None, None), (2, "", "a"), (2, "", "a"), (3, " \t\n ", "b"), (None, "One two three four five six seven eight nine ten eleven.", "b"),
    (4, "xx One, two three four five six seven eight nine ten eleven twelve", None), (5, "short item here", "a"), (6, "a short ITEM here and É-ÀB mit License MIT license mit license", "c"),
    (7, "\n".join(["w " * 30] * 6 + ["tail"]), "a"), (8, "\n".join(["x"] + ["w " * 30] * 3 + ["", "tail"]), "a"), (9, "\n".join(["w " * 30] * 6 + ["tail"]), "a"),
    (9, "other text of the same id " * 11, "c"), (9, "other text of the same id " * 11, "c"), (None, "other text of the same id " * 11, None), (10, "All rights reserved. This great work is licensed under the Apache License, Version 2.0.", "d"),
    (13, "\t".join(f"col{k}" for k in range(60)) + "\nend of a table", "a"), (14, "\t".join(f"col{k}" for k in range(60)) + "\nanother end", "b"), (15, "\v".join(f"v{k}" for k in range(55)), "a"), (16, "\f".join(f"v{k}" for k in range(55)), "a"),
    (11, "licensed under a b c d the Apache License 2.0", "d"), (12, "licensed under a b c the Apache License 2.0, copyright 2020 by me, all rights reserved", "d"),
]
BENCH = [(0, "one two three four five six seven eight nine ten eleven"), (1, "Short Item here!"), (2, ""), (3, None), (10, "of the same id other text of the same id other"), (4, "nothing of this stands anywhere in the corpus at all really")]

TURNS = [(c, t, role, text) for c in (0, 2, 5, 6, 7, 9, 11, 12, 3000) for t, role, text in [(None, None, None), (0, "user", ""), (1, "assistant", "é b"), (2, "user", f"{c % 4}"), (3, "", "end")][: 1 + c % 5]] + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_given_tables(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


@pytest.mark.parametrize("rows", ["odd", "empty"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows(spark, tmp_path, name, rows):
    import duckdb

    docs = [(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in ODD] if rows == "odd" else []
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, words string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH if rows == "odd" else [], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(TURNS if rows == "odd" else [], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None
