"""Prefix trie against brute force; more pieces than one for each search to leave its piece."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from evenhand.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, piece int, run string, n_convs int"


def brute(rows):
    """Nodes of the rebuilt conversations, by grouping all prefixes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    given = {c: [(r, x) for _, r, x in sorted(v, key=lambda t: t[0])] for c, v in convs.items()}
    built = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(given.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, "r", 2) for r in rows], SCHEMA)
    got = [tuple(r) for r in trie.trie(trie.branched(trie.sequences(df))).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n):
    """Few different texts, so that prefixes repeat; equal conversations, single turns, null roles and texts."""
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(3 * n), n):
        hot = rnd.random() < 0.4
        for t in range(3 if hot else rnd.randint(1, 10)):
            rows.append((c, None if t == 0 and rnd.random() < 0.1 else t, rnd.choice(["user", None, ""]) if not hot else "user", f"{t}é" if hot else rnd.choice(["a", "b", "", None])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, partitions", [(1, 300, 37), (2, 300, 4), (3, 40, 64), (4, 1, 4)])
def test_against_brute_force(spark, seed, n, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = made(seed, n)
        assert nodes(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_sequence_in_all_pieces(spark):
    """All conversations alike: one path whose ends go through every piece."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        rows = [(c, t, "user", "x" * t) for c in range(0, 9000, 5) for t in range(9)]
        assert nodes(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    turnless = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)  # a head that is absent takes its turns
    rows = [(None, 0, "user", "lost"), (turnless, 0, "user", "a"), (turnless, 1, None, None), (5000, None, "user", "z" * 100_000), (5000, None, "user", "z" * 100_000), (-10, 1, "", "")]
    got = nodes(spark, rows)
    assert got == brute(rows) and (-10, 0, None, 3) in {r[:4] for r in got}
    assert nodes(spark, [(turnless, 0, "user", "a")]) == {(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())}
    assert nodes(spark, []) == set()


def test_searches():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 31, 100):
        values = rnd.integers(0, 6, n)
        table = trie._minima(values)
        lo, hi = np.array([(a, b) for a in range(n) for b in range(a, n)]).T
        assert (trie._range_min(table, lo, hi) == [values[a : b + 1].min() for a, b in zip(lo, hi)]).all()
        at, depth = np.array([(a, d) for a in range(n) for d in range(8)]).T
        assert trie._next_below(table, at, depth).tolist() == [next((j for j in range(a, n) if values[j] < d), n) for a, d in zip(at, depth)]
        assert trie._last_below(table, at, depth).tolist() == [next((j for j in range(a, -1, -1) if values[j] < d), -1) for a, d in zip(at, depth)]
