import numpy as np
from pyspark.sql import functions as F

from evenhand.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, source string, id string, scores string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.withColumn("tag", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))  # the other half is held out
    got = langid.identify(known, declared="tag", host="source").join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1")
    right = got.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.99
    assert got.where("not kept").count() == 0


def test_trigrams_read_whole_texts():
    assert len(langid.trigrams("Ab")) == 2 and len(langid.trigrams("ab, cd")) == 5
    assert (langid.trigrams("AB!!c") == langid.trigrams("ab c")).all()
    assert len(langid.trigrams(None)) == len(langid.trigrams("")) == len(langid.trigrams("12 .,")) == 0
    assert len(langid.trigrams("ab" * 200_000)) == 400_000


def test_unknown_language_and_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", F.lit("c").alias("id"), F.lit("c").alias("scores"))
    odd = [(-1, None, "en", "src0", "c", "c"), (-2, "", "en", None, "c", "c"), (-3, "1234 %%", "en", "src0", "c", "c"), (-4, "жщю ъыэ фцч " * 40, "en", "src0", "c", "c"), (-5, "xqzv jwqx kkzq " * 40, None, None, "c", "c"), (None, "the of and that thonre inon ertion", "??", "src1", "c", "c")]
    docs = base.union(spark.createDataFrame(odd + odd[-1:], SCHEMA))
    rows = langid.identify(docs, declared="lang", host="source").collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].language == "und" and not by_id[i].kept for i in (-1, -2, -3, -4, -5))
    assert by_id[None].language == "en" and by_id[None].declared is None
    kept = langid.keep_identified(docs, declared="lang", host="source")
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    assert langid.identify(docs.limit(0), declared="lang", host="source").count() == 0
    assert langid.identify(base, declared=None).where("kept").count() == 0


def test_evidence_decides_short_texts(spark):
    """A text as likely in both languages follows the declared language, the suffix and the host."""
    model = langid.TextModel(["aa", "bb"], np.vstack([np.bincount(langid.trigrams(w * 50), minlength=langid.BUCKETS) for w in ("foo both ", "bar both ")]))
    rows = []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        host = f"www.{lang}.example.com" if i % 4 < 2 else "mixed.example.org"
        rows.append((i, "foo foo" if i % 2 else "bar bar", lang, f"http://{host}/{lang}/x", None))
    rows += [(1000, "both", "aa", None, "a"), (1001, "both", "bb-XX", None, "b"), (1002, "both", None, "http://h.net/aa/1", "a"), (1003, "both", None, "http://h.net/bb?", "b"), (1004, "both", None, "http://www.aa.example.com/", "a"), (1005, "both", None, "http://new.bb.example.com/", "b")]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, url string")
    got = {r.doc_id: r for r in langid.identify(docs, declared="lang", url="url", model=model).collect()}
    assert [got[i].language[0] for i in range(1000, 1006)] == [r[4] for r in rows[200:]]
    assert all(got[i].confidence < 1 for i in range(1000, 1006))


def test_host_priors_are_smoothed_level_by_level(spark):
    rows = spark.createDataFrame([("a.x.com", 0)] * 30 + [("b.x.com", 1)] * 10 + [("y", 1)] * 10 + [(None, 0)] * 10, "host string, guess int")
    priors, corpus = langid.host_priors(rows, ["p", "q"], 20.0)
    got = {r.host: np.exp(r.prior) for r in priors.collect()}
    whole = [41 / 62, 21 / 62]
    assert np.allclose(np.exp(corpus), whole)
    parent = [(30 + 20 * whole[0]) / 60, (10 + 20 * whole[1]) / 60]
    assert np.allclose(got["a.x.com"], [(30 + 20 * parent[0]) / 50, 20 * parent[1] / 50])
    own = [20 * whole[0] / 30, (10 + 20 * whole[1]) / 30]
    assert np.allclose(got["y"], [20 * own[0] / 30, (10 + 20 * own[1]) / 30])


def test_markup_and_addresses(spark):
    rows = spark.createDataFrame([('<!DOCTYPE html><HTML class="x" lang="en-US">', "http://a.B.de/fr/x"), ("<html><body lang='de'>", "http://x.org/page"), (None, None), ("", "no url")], "html string, url string")
    host, suffix = langid.address_parts(F.col("url"))
    got = [tuple(r) for r in rows.select(langid.markup_language(F.col("html")), host, suffix).collect()]
    assert got == [("en-US", "a.b.de", "/fr"), (None, "x.org", ".org"), (None, None, None), (None, None, None)]


def _text(rng, letters):
    return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))


def test_rare_languages_are_known(spark):
    """40 rows of a language among 20,000 of another, and three of a language too rare for a text model."""
    rng = np.random.default_rng(3)
    many, rare, script = [_text(rng, "abcdefgh") for _ in range(200)], [_text(rng, "mnopqrst") for _ in range(40)], [_text(rng, "\u0436\u0449\u044e\u044a\u044b\u044d") for _ in range(3)]
    rows = [(i, many[i % 200], "en") for i in range(20_000)] + [(30_000 + i, t, "gl") for i, t in enumerate(rare)] + [(40_000 + i, t, "ru") for i, t in enumerate(script)]
    rows += [(50_000, "1234 %%", "ru"), (50_001, script[0], None), (50_002, script[0], "und"), (50_003, None, "ru"), (50_004, script[0], "unknown")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("src0"))
    model = langid.fit_text_model(docs, "lang", sample=100)
    assert model.languages == ["en", "gl", "und"]
    got = {r.doc_id: (r.language, r.kept) for r in langid.identify(docs, declared="lang", host="source").collect()}
    assert all(got[30_000 + i] == ("gl", True) for i in range(40)) and all(got[40_000 + i] == ("ru", True) for i in range(3))
    assert all(got[i] == ("und", False) for i in range(50_000, 50_005)) and all(got[i] == ("en", True) for i in range(20_000))


def test_page_text(spark):
    html = "<!DOCTYPE html><html lang='fr'><!-- a < b --><script>var t='</p>';</script><STYLE>p{}</STYLE><p class=x>caf&eacute; &amp; th\u00e9<br/>1 < 2</p><script>open"
    rows = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(langid.page_text(F.col("html")).alias("t")).collect()
    assert [r.t and r.t.split() for r in rows] == ["caf\u00e9 & th\u00e9 1 < 2".split(), None, ""]


def test_pages_use_markup_and_address(spark, tmp_path):
    """A registered query judges every page; text as likely in both languages follows the address and the domain."""
    from evenhand.llm.queries import QUERIES

    rng = np.random.default_rng(4)
    page = "<html{}><script>x</script><p>{}</p></html>"
    rows = [(i, f"http://h{i % 9}.{'aa' if i % 2 else 'bb'}.com/{'xx' if i % 2 else 'yy'}/{i}", page.format(f" lang='{'fr' if i % 2 else 'de'}'", _text(rng, "abcdef" if i % 2 else "mnopqr"))) for i in range(200)]
    rows += [(1000, "http://new.aa.com/xx/1", page.format("", "7 \u0436 8")), (1001, "http://new.bb.com/yy/1", page.format("", "7 \u0436 8")), (1002, None, None), (1003, None, page.format(" lang='fr-FR'", "\u0436"))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op8_page_language"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[i].language == ("fr" if i % 2 else "de") == got[i].declared for i in range(200))
    assert [got[i].language for i in (1000, 1001, 1002, 1003)] == ["fr", "de", "und", "fr"] and got[1003].declared == "fr"
