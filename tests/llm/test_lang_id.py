"""Language ID: held-out accuracy, and what each kind of evidence does."""

from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import docs, items, table  # noqa: F401
from tracelake.llm import lang_id

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(documents):
    return lang_id.train(documents.where("doc_id % 2 = 0"))


def test_held_out_accuracy(documents, model):
    held = documents.where("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string"))
    found = {r.id: r.lang for r in lang_id.identify_documents(held, model).collect()}
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    assert np.mean([truth[i] == x for i, x in found.items()]) > 0.98


def test_trigrams_by_hand():
    data = np.frombuffer("ab é1".encode(), np.uint8)
    row, slot = lang_id.trigrams(data, np.array([0, 2, len(data)]))
    spell = lambda t: ((t[0] << 16 | t[1] << 8 | t[2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
    want = [(0, b" ab"), (0, b"ab "), (1, b"  \xc3"), (1, b" \xc3\xa9"), (1, b"\xc3\xa9 "), (1, b"\xa9  ")]
    assert list(zip(row, slot)) == [(r, spell(t)) for r, t in want]


def test_evidence(spark, model):
    text = "der die und nicht ist"
    rows = [(i, "q", None, "host-de", "x") for i in range(3)]
    rows += [(100 + i, text * 40, "de", "host-de", "x") for i in range(60)] + [(200 + i, "the of and in to it is that " * 40, "en", "host-en", "x") for i in range(60)]
    rows += [(300, "q", None, "host-en", "x"), (301, "q", "de", "new", "x"), (302, "q", "en", "new", "x"), (303, "%%% 12 34", "en", "host-en", "x"), (304, None, "en", "host-en", "x"), (305, "xqzj wvkq zzqx jjqk qxzv vvkj " * 50, "en", "host-en", "x")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    out = {r.id: r for r in lang_id.fuse(df, model).collect()}
    assert {out[i].lang for i in range(3)} == {"de"} and out[300].lang == "en"  # the host's prior
    assert (out[301].lang, out[302].lang) == ("de", "en")  # the declaration
    assert {out[i].lang for i in (303, 304, 305)} == {"und"}


def test_against_plain_python(spark, model):
    import random

    from tests.llm import brute

    rng = random.Random(4)
    words = {"en": "the of and in to it is that for".split(), "de": "der die und nicht ist das ein".split(), "fr": "les des une pour dans que".split(), None: "xq zzv wk".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(list(words))
        text = " ".join(rng.choices(words[lang], k=rng.randint(1, 12)))
        rows.append((i, rng.choice([text, text, text, "", None, "1 2 3"]), rng.choice([lang, None, "de", "xx"]), rng.choice(["a.de", "b.de", "c.com", None]), rng.choice(["de", "com"])))
    out = {r.id: (r.lang, r.confidence) for r in lang_id.fuse(spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string"), model).collect()}
    want = brute.fuse(rows, model, lang_id.POWER, lang_id.HOST_WEIGHT, lang_id.SUFFIX_WEIGHT, lang_id.DECLARED_WEIGHT)
    assert {i: x[0] for i, x in out.items()} == {i: x[0] for i, x in want.items()}
    assert {i: x[1] for i, x in out.items()} == pytest.approx({i: x[1] for i, x in want.items()}, abs=2e-5)


def test_rare_and_copied_labels(spark):
    """A rare label has a model beside one whose copied text is most rows; of many labels the most frequent have one."""
    rows = [("der die und nicht " * 9, "de")] * 3000 + [(f"the of and in {i}", "en") for i in range(40)] + [(f"les des une pour {i}", "fr") for i in range(3)] + [(f"x {i}", f"l{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert {"de", "en", "fr", "und"} <= set(lang_id.train(df, sample=20).languages)
    assert lang_id.train(df, most=3).languages == ["de", "en", "fr", "und"]


def test_pages(spark, model):
    page = '<!DOCTYPE html><HTML class="a" LANG="fr-FR"><head><title>x</title></head><body><script>var the = "and";</script><p>les des une pour dans</p></body></html>'
    df = spark.createDataFrame([(1, "https://user@WWW.Example.org:80/a?b", page), (2, None, None), (3, "nonsense", "<p>")], "page_id long, url string, html string").withColumn("host", F.lit(1))
    out = {r.id: r for r in lang_id.identify_pages(df, model).collect()}
    assert (out[1].host, out[1].declared, out[1].lang) == ("www.example.org", "fr", "fr")
    assert out[2].lang == out[3].lang == "und"
    assert lang_id.visible(page).split() == ["les", "des", "une", "pour", "dans"]


def test_all_pages(spark, model):
    rows = lang_id.identify_pages(spark.read.parquet(f"{DIR}/pages.parquet"), model).collect()
    assert len(rows) == 250 and np.mean([r.lang == r.declared for r in rows]) > 0.9


def test_hard_cases_and_empty(spark, table, model):  # noqa: F811
    out = lang_id.identify_documents(table, model).collect()
    assert len(out) == table.count() and all(0 < r.confidence <= 1 for r in out)
    assert lang_id.identify_documents(table.limit(0), model).collect() == []
    assert lang_id.train(table.limit(0)).languages == ["und"]
    assert list(lang_id.count_batches(iter([pa.RecordBatch.from_pydict({"text": pa.array([], pa.string()), "label": pa.array([], pa.string())})]))) == []


def test_pages_without_their_parts():
    """The same as one pattern that looks back, which takes time with the square where parts aren't closed."""
    rng = random.Random(5)
    pieces = ["<script>", "</script>", "<SCRIPT x", "</Script \n>", "<nav>", "</nav>", "<style", "</style>", "<head>", "<header>", "</head>", "<!--", "-->", "<!-->", "--", "text", " ", ">", "<", "</", "<b>", "&amp;"]
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ", page)))
        assert lang_id.visible(page) == want, page


@pytest.mark.parametrize("piece", ["<nav>", "<script", "<!--", "<", "</nav ", "<nav></script>", "-->"])
def test_hostile_pages(piece):
    began = time.perf_counter()
    lang_id.visible(piece * (2_000_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_declared_language_of_hostile_pages(spark):
    model = lang_id.Model(["en", lang_id.UNKNOWN], np.zeros((2, lang_id.SLOTS), np.float32))
    pages = [(1, "http://a.de/x", '<!doctype html><HTML class="x"\n LANG = \'fr-CA\'>'), (2, "http://a.de/x", "<html " * 300_000), (3, None, "<html><p lang=de>"), (4, "x", "<html lang" + " " * 100_000 + "=de>")]
    got = {r.id: r.declared for r in lang_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got == {1: "fr", 2: "", 3: "", 4: "de"}
