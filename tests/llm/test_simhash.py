import random
import re

import numpy as np
import pytest

from evenhand.llm import simhash

DOCS = "doc_id bigint, text string, id string, _h string, row string"


def brute_print(text, shingle=3):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    some = sorted(prints)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_codes_are_perfect():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    anchors = simhash.nearest_anchor(points)
    assert (np.bitwise_count(points ^ anchors) <= 8).all()
    assert (simhash.nearest_anchor(anchors) == anchors).all()


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    texts = [None, "", " \t ", "One", "one Two", "É a b c É a b c", "a\x0bb\x0cc d\x1ee", "x " * 200 + "y", "the cat sat on the mat " * 5]
    rows = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(rows).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}
    assert got[0] == got[1] == got[2] == 0
    jvm = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert simhash.fingerprint(b"ONE two\tthree") == jvm % 2**64


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_are_all_pairs_within_the_distance(spark, bits):
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = set(centres)
    for c in centres:
        for _ in range(12):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    got = {(r.u, r.v) for r in simhash.links(rows, bits).collect()}
    some = sorted(signed(p) for p in prints)
    want = {(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= bits}
    assert got == want


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 131)} | {i: 200 for i in range(200, 209)}


def test_groups_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    roots = brute_components(set(prints.values()), 2)
    smallest = {}
    for i in sorted(texts):
        smallest.setdefault(roots[prints[i]], i)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {i: (prints[i], smallest[roots[prints[i]]]) for i in texts}
    assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == sorted(smallest.values())


def test_nulls_copies_and_clashing_columns(spark):
    rows = [(5, "a b c d", "k", "k", "k"), (3, "a b c d", "k", "k", "k"), (3, "a b c d", "k", "k", "k"), (None, "A b C d", "k", "k", "k"), (7, None, "k", "k", "k"), (8, "", "k", "k", "k"), (9, " ", "k", "k", "k"), (10, "q " * 50_000, "k", "k", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 7), (10, 10)], key=str)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [10, 7, None]
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0
