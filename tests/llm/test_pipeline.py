"""The pipeline's stages, each against its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_simhash import brute_components, brute_print
from test_text_operators import brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == (COLUMNS if k < 4 else [*COLUMNS, "epoch"])
        inputs.append(docs.collect())
    by_id = [{r.doc_id: r for r in rows} for rows in inputs]
    assert by_id[0].keys() == by_id[1].keys()  # all of these documents are in a declared language

    ids = sorted(by_id[1])
    texts = [by_id[1][i].text for i in ids]
    want = {}
    for i, t, gone in zip(ids, texts, brute_lines(texts, 50)):
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(gone))
        if not gone or left.strip():
            want[i] = left
    assert {i: r.text for i, r in by_id[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in inputs[2])

    prints = {i: brute_print(r.text) for i, r in by_id[2].items()}
    root = brute_components(set(prints.values()), 2)
    smallest = {}
    for i in sorted(prints):
        smallest.setdefault(root[prints[i]], i)
    assert sorted(by_id[3]) == sorted(smallest.values())

    clean = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() or ord(c) >= 0x80 else " " for c in t).split())
    low = lambda t: clean("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)).split()
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = low(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    assert all(len(w) == 10 for w in windows)
    hit = {i for i, r in by_id[3].items() if any(tuple(low(r.text)[k : k + 10]) in windows for k in range(len(low(r.text)) - 9))}
    assert by_id[4].keys() == by_id[3].keys() - hit and hit

    whole = sum(len(r.text.split()) for r in inputs[4])
    assert abs(sum(len(r.text.split()) for r in inputs[5]) - whole) <= len({r.source for r in inputs[4]})
    assert by_id[5].keys() <= by_id[4].keys()


def test_run_writes_each_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*COLUMNS, "epoch"] and out.agg(F.max("epoch")).first()[0] <= 2


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
