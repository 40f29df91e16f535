import hashlib
from collections import Counter

import numpy as np

from evenhand.llm import imatch


def test_words_and_lexicon(spark):
    texts = ["The cat, the CAT É9", None, "", "the dog", "a the rare"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    counts = Counter(w for t in texts for w in set(imatch.words(t or "")))
    assert counts[b"the"] == 3 and b"\xc3\x899" in counts
    hashed = dict(zip(imatch._hashes(list(counts)).view(np.int64).tolist(), counts.values()))
    assert {r.term: r.df for r in imatch.document_frequencies(docs, most=2).collect()} == hashed
    assert imatch.lexicon(docs, 0.0, 1.0).tolist() == imatch._hashes([b"the"]).tolist()
    assert len(imatch.lexicon(docs, 0.0, 0.5)) == 0


def test_likeness():
    known = np.sort(imatch._hashes([f"w{i}".encode() for i in range(3000)]))
    text = " ".join(f"w{i}" for i in range(300))
    one = imatch.fingerprint(text, known)
    same = imatch.fingerprint(" ".join(reversed(text.upper().split())) + " unknown", known)
    near = imatch.fingerprint(" ".join(f"w{i}" for i in range(290)), known)
    far = imatch.fingerprint(" ".join(f"w{i}" for i in range(1000, 1300)), known)
    empty = imatch.fingerprint(" .,", known)
    assert imatch.likeness(one, same) == 1.0 and imatch.likeness(empty, empty) == 1.0 and imatch.likeness(one, empty) == 0.0
    assert imatch.likeness(one, near) > 0.5 > 0.1 > imatch.likeness(one, far)
    assert (imatch.from_text(imatch.as_text(one)) == one).all() and len(imatch.as_text(one)) == imatch.DIGITS


def brute(texts, ids):
    """Rows by the definition, one document after the other."""
    n = len(texts)
    counts = Counter(w for t in texts for w in set(imatch.words(t or "")))
    known = np.sort(imatch._hashes([w for w, c in counts.items() if max(2, imatch.LOW * n) <= c <= imatch.HIGH * n]))
    key = lambda i: (-(ids[i] if ids[i] is not None else imatch.NO_ID), hashlib.md5(texts[i].encode()).hexdigest() if texts[i] is not None else "")
    order = sorted(range(n), key=key)
    rows = []
    for i, j in zip(order, order[1:] + order[:1]):
        a, b = texts[i] or "", texts[j] or ""
        k = len(a) // 3
        edited = (a[:-k] if k else a) + b[:k]
        p, q, r = (imatch.fingerprint(t, known) for t in (a, edited, b))
        rows.append((ids[i], len(a), hashlib.sha256(edited.encode()).hexdigest(), imatch.as_text(p), imatch.as_text(q), imatch.likeness(p, q), imatch.likeness(p, r)))
    return sorted(rows, key=str)


def test_edited_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    rows = docs.collect()
    want = brute([r.text for r in rows], [r.doc_id for r in rows])
    got = imatch.edited_fingerprints(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_odd_rows(spark):
    ids = [5, 5, 5, None, None, 9, 1, 2, -4]
    texts = ["a b", "a b", "z", None, "", "é" * 10, "word " * 40_000, "€€€€", "🙂🙂🙂🙂 a"]
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in zip(ids, texts)], "doc_id bigint, text string, piece string, id string")
    assert sorted((tuple(r) for r in imatch.edited_fingerprints(docs).collect()), key=str) == brute(texts, ids)
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0
    one = imatch.edited_fingerprints(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    added = imatch.fingerprints(docs, imatch.lexicon(docs))
    assert added.columns == [*docs.columns, "fingerprint"] and added.where("text = 'a b'").select("fingerprint").distinct().count() == 1
