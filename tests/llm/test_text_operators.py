"""Line dedup, decontamination, mixing and licenses: the operators' own outputs, odd rows, clashing columns."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evenhand.llm import common, decontaminate, licenses, linedup, mixing

SCHEMA = "doc_id bigint, text string, source string, row string, h string, gone string, epochs string, size string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, *["clash"] * 5) for i, t, s in rows], SCHEMA)


def test_prefix_sums_over_any_number_of_pieces(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id", (F.col("id") % 7).alias("n"))
    got = common.running(rows, ["k", "id"], ["n"]).orderBy("k", "id").collect()
    total = 0
    for r in got:
        assert r.before_n == total
        total += r.n
    assert len(got) == 1000 and common.running(rows.limit(0), ["k", "id"], ["n"]).count() == 0


def test_words(spark):
    texts = ["", None, " a ", "a", "\x0ba\tb \x0c", "A-b9É\x7fz x'Y", " a b c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", common.n_blank_words(F.col("t")).alias("n"), common.words_of(F.col("t")).alias("w")).orderBy("i").collect()
    for r, t in zip(rows, texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) and r.w == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_later_copies_of_passages_go(spark):
    passage = ["p" + " x" * 24, "q" + " y" * 24, "end"]
    rows = [(3, ["own three", *passage, "more"]), (1, ["own one", *passage]), (2, [*passage[:2], "other"]), (4, ["short line", "own four"]), (5, ["short line"]), (6, [passage[0], "between", passage[1]])]
    out = linedup.dedup_lines(docs_of(spark, [(i, "\n".join(ls), "a") for i, ls in rows]))
    got = {r.doc_id: (r.text, r.removed_lines) for r in out.collect()}
    assert got[1] == ("\n".join(["own one", *passage]), [])
    assert got[2] == ("other", [0, 1]) and got[3] == ("own three\nmore", [1, 2, 3])
    assert got[4][1] == got[5][1] == got[6][1] == []
    assert out.columns == [*docs_of(spark, []).columns, "removed_lines"]


def brute_lines(texts, least):
    """Lines covered by a run of ``least`` words that stands earlier, by comparing all runs."""
    firsts, runs = {}, []
    for d, text in enumerate(texts):
        ls = text.split("\n")
        sizes = [len([w for w in x.split(" ") if w]) for x in ls]
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                if sum(sizes[s:e]) >= least:
                    runs.append((d, s, e, tuple(ls[s:e])))
                    firsts.setdefault(tuple(ls[s:e]), (d, s))
    gone = defaultdict(set)
    for d, s, e, run in runs:
        if firsts[run] < (d, s):
            gone[d].update(range(s, e))
    return [sorted(gone[d]) for d in range(len(texts))]


@pytest.mark.parametrize("seed", range(4))
def test_lines_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    pool = ["", "a", "b c", "d e f", "g h i j k", "l m n o p q r"]
    texts = ["\n".join(rng.choice(pool[: rng.randint(2, 6)]) for _ in range(rng.randint(1, 14))) for _ in range(25)]
    out = linedup.dedup_lines(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), min_words=6)
    got = {r.doc_id: r.removed_lines for r in out.collect()}
    assert [got[i] for i in range(25)] == brute_lines(texts, 6)


def test_contaminated_documents_go(spark):
    item = " ".join(f"w{i}" for i in range(14))
    rows = [(1, "before " + item + " after", "a"), (2, " ".join(item.split()[:9]), "a"), (3, None, "a"), (4, "W3-w4, w5 w6 w7 w8 w9 w10 w11 w12!", "a"), (4, "W3-w4, w5 w6 w7 w8 w9 w10 w11 w12!", "a"), (None, "fine", "a")]
    bench = spark.createDataFrame([("x", item, "c"), ("y", item, "c"), (None, None, "c")], "item_id string, text string, words string")
    docs = docs_of(spark, rows)
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert found == {1: (14, ["x", "y"]), 2: (0, []), 3: (0, []), 4: (10, ["x", "y"]), None: (0, [])}
    in_blocks = decontaminate.contamination(docs, bench, most=200).collect()  # many blocks, one answer
    assert {r.doc_id: (r.n_hit, r["items"]) for r in in_blocks} == found and len(in_blocks) == len(rows)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == [2, 3, None]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_mixed_documents_are_the_plan(spark):
    rows = [(i, " ".join(f"v{i}" for _ in range(i % 9)), "abcde"[i % 5] if i % 11 else None) for i in range(120)] + [(7, "v7 " * 7, "c")] * 3 + [(None, None, "a"), (500, "big " * 4000, "b")]
    docs = docs_of(spark, rows)
    plan = mixing.mix(docs).collect()
    mixed = mixing.mixed_documents(docs)
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    taken = defaultdict(int)
    for r in plan:
        taken[r.doc_id] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixed.columns == [*docs.columns, "epoch"]
    sources = defaultdict(int)
    for r in plan:
        sources[r.source_size, r.target] += r.taken
    assert all(abs(v - target) < 4 for (_, target), v in sources.items())
    assert sorted(tuple(r) for r in mixing.mix(docs.repartition(9)).fillna(-1).collect()) == sorted(tuple(r) for r in mixing.mix(docs).fillna(-1).collect())
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs_of(spark, [(1, None, "a"), (2, " ", None)])).count() == 0


def test_templates_accept_exact_mandatory_wording():
    scan = lambda text, t: licenses.scan(text.encode(), {}, (("x", t),)).notices
    t = "<<optional>>this <<var 1-2>> is<</optional>> under <<var 0-2>> the mit license"
    assert scan("This fine work is under THE MIT License.", t) == [(0, 8, "x"), (4, 8, "x")]
    assert scan("under a b the mit license", t) == [(0, 6, "x")] and scan("under a b c the mit license", t) == []
    assert scan("under the mitt license", t) == [] and scan("under the mit", t) == [] and scan("", t) == []
    assert scan("under under the mit license", t) == [(0, 5, "x"), (1, 5, "x")]
    for text in ("this a is under the mit license", "this a b c is under q the mit license", "is under the the mit license x", "under the mit license under"):
        assert bool(scan(text, t)) == bool(re.search(licenses.as_regex(t), f" {text} "))


MIT = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at https://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""


def filled(template, owner):
    """A text of the template: optional regions dropped, replaceable ones filled."""
    return re.sub(r"<<var \d+-\d+>>", owner, re.sub(r"<<optional>>.*?<</optional>>", "", template))


def test_whole_licences_match_word_by_word():
    labels = lambda text: {x for _, _, x in licenses.scan(text.encode()).notices}
    assert labels(MIT) == {"mit-text", "mit-grant"} and labels("x " * 5000 + MIT + " y" * 5000) == {"mit-text", "mit-grant"}
    assert labels(MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "Example Corp. of Somewhere")) == {"mit-text", "mit-grant"}
    assert labels(APACHE) == {"apache-2.0-header", "apache-2.0"}
    for label, template in licenses.TEMPLATES:
        text = filled(template, "Example")
        assert label in labels(text), label
        if not label.endswith(("-text", "-header")):
            continue
        words = text.split()
        for k in (*range(0, len(words), 7), len(words) - 1):  # a changed, a missing, a further word anywhere is refused
            if words[k] != "Example" and "Example" not in words[max(k - 1, 0) : k + 2]:
                for other in ([*words[:k], "changed", *words[k + 1 :]], [*words[:k], *words[k + 1 :]]):
                    assert label not in labels(" ".join(other)), (label, k)
    assert "bsd-2-clause-text" not in labels(filled(dict(licenses.TEMPLATES)["bsd-3-clause-text"], "Example"))


def test_license_findings(spark):
    docs = spark.createDataFrame([(1, "mit license MIT-License", "c"), (2, None, "c"), (3, "", "c"), (4, "x " * 60_000 + "Licensed under CC BY-NC 4.0.", "c"), (4, "é apache license", "c")], "doc_id bigint, text string, base string")
    got = [tuple(r) for r in licenses.digest(licenses.find_licenses(docs)).orderBy("doc_id", "n_words").collect()]
    assert got == [(1, 4, 2, 0, 2, "mit", "mit", 0.5), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 3, 1, 1, 1, "apache", "apache", 0.5), (4, 60_007, 0, None, None, "", "cc-by-nc-4.0", 1.0)]
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_words_of_a_line_are_parted_by_any_blank(spark):
    """Runs of 50 words in lines parted by tabs and other blanks: later copies go, whole texts too."""
    table = ["\t".join(f"c{r}v{i}" for i in range(30)) for r in range(2)]
    mixed = "\x0b".join(f"m{i}" for i in range(25)) + "\r\f \t" + "\t ".join(f"n{i}" for i in range(25))
    texts = ["\n".join(["head", *table, "end"]), "\n".join(["other", *table]), mixed, "x\n" + mixed, "\n".join(["head", *table, "end"]), table[0], "y\n" + table[0]]
    got = linedup.dedup_lines(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), min_words=50)
    assert {r.doc_id: r.removed_lines for r in got.collect()} == {0: [], 1: [1, 2], 2: [], 3: [1], 4: [0, 1, 2, 3], 5: [], 6: []}
