"""Packing: exact round trip of the ids, the plan against one-by-one best fit, odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evenhand.llm import packing
from evenhand.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(counts, capacity):
    """Remaining capacities after best-fit decreasing, piece by piece."""
    left = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [i for i, room in enumerate(left) if room >= size]
            if fits:
                left[min(fits, key=left.__getitem__)] -= size
            else:
                left.append(capacity - size)
    return sorted(left)


def test_plan_equals_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.choice([1, 7, 10, 16, 33, 100])
        counts = {s: rnd.choice([1, 2, 3, 10, 40]) for s in rnd.sample(range(1, capacity + 1), rnd.randint(1, min(capacity, 12)))}
        steps = packing.best_fit(counts, capacity)
        sizes = [s for s in sorted(counts, reverse=True) for _ in range(counts[s])]
        bins = {}
        for (first, each, bin_, offset), stop in zip(steps, [s[0] for s in steps[1:]] + [len(sizes)]):
            for k in range(stop - first):
                bins.setdefault(bin_ + k // each, []).append((offset + k % each * sizes[first], sizes[first + k]))
        assert sum(map(len, bins.values())) == len(sizes) and sorted(bins) == list(range(len(bins)))
        for parts in bins.values():
            assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[s for _, s in sorted(parts)]])[:-1].tolist()
        assert sorted(capacity - sum(s for _, s in parts) for parts in bins.values()) == one_by_one(counts, capacity)


def test_plan_is_short_whatever_the_counts():
    rnd = random.Random(2)
    steps = packing.best_fit({s: rnd.randint(1, 10**9) for s in range(1, 1025)})
    assert len(steps) < 3 * 1024 * 10
    assert packing.best_fit({}) == [] and packing.best_fit({1024: 10**9}) == [(0, 1, 0, 0)]


def test_ids_equal_the_tokenizers():
    encode, exact = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert encode.fast is not None
    odd = ["", "<|endoftext|> x<|endoftext|>", "a" * 100_000, " " * 70_000, "x  y " * 30_000 + "<|endoftext|>", "it's we'll " * 20_000, "͸ \U0001d4b3 �\x00\x1c", "né é x　字"]
    odd += [f"a {c} b1{c}a 2  {c}\n{c}' {c}{c}s" for c in sorted(encode.stable)[::7]]
    for text in odd:
        assert encode(text).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 2], text[:50]
    assert encode(None).tolist() == [2]


def check(rows, docs):
    """Every document whole and in order, every sequence gapless; the number of sequences."""
    exact = Tokenizer.from_file(PATH)
    want = sorted(((i is not None, i or 0), [*exact.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in docs)
    firsts = sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32, r.length) for r in rows if r.piece == 0)
    pieces, spans = [], {}
    for i, ids in want:
        cut = len(ids) % 1024 or 1024
        stops = [len(ids)] if len(ids) <= 1024 else list(range(cut, len(ids) + 1, 1024))
        pieces += [(i, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())) for k, (start, stop) in enumerate(zip([0, *stops], stops))]
    assert sorted(pieces) == sorted(((r.doc_id is not None, r.doc_id or 0), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert len(firsts) == len(docs)
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    counts = {}
    for p in pieces:
        counts[p[3]] = counts.get(p[3], 0) + 1
    assert len(spans) == len(one_by_one(counts, 1024))


def test_given_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op12_best_fit"](spark, sf).collect(), docs)


def test_odd_rows(spark):
    docs = [(None, None), (None, "two nulls"), (1, ""), (2, "same text"), (2, "same text"), (3, "long " * 5000), (4, "q" * 30_000), (5, "x y z")]
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], "doc_id bigint, text string, length int, sequence_id int, _row string, ids int")
    packed = packing.pack(packing.token_pieces(df, PATH, ids=True))
    check(packed.collect(), docs)
    by_sequence = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert by_sequence[r.sequence_id][r.offset : r.offset + r.length] == r.ids


@pytest.mark.parametrize("capacity, end", [(8, None), (1, 2)])
def test_other_capacities(spark, capacity, end):
    df = spark.createDataFrame([(k, "word " * k) for k in range(12)], "doc_id bigint, text string")
    rows = packing.pack(packing.token_pieces(df, PATH, capacity, end).where("length > 0"), capacity).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= capacity and sum(fill.values()) == sum(r.length for r in rows) > 0


def test_empty_table(spark):
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], "doc_id bigint, text string"), PATH)).collect() == []
