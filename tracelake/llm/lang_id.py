"""Language ID (1) by Bayesian evidence fusion.

Evidence on the language of a row: the likelihood of its text under byte-trigram models (of which neighbours depend on each
other, hence a power under one), the declared markup language, with how often each declaration meets each language, and a
prior of its host, smoothed towards that of its address suffix, which is smoothed towards all rows. The counts behind the
last two are sums of the text's own posteriors in grouped aggregations, the row itself left out of its host's. "und", the
likelihood of widely spread trigrams, stands for text of no known language.

The trigram models are fitted on a bounded sample of labelled rows (distinct texts, SAMPLE of each label, by hash; LABELS labels); all
other counts are of all rows.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import textcore
from tracelake.llm.common import broadcast_if_small, checkpoint, columns, read, row_key

SAMPLE, LABELS, SLOTS = 1000, 64, 1 << 16
#: Power of the text's likelihood; weight, in rows, of the suffix in a host's prior and of all rows in a suffix's.
POWER, HOST_WEIGHT, SUFFIX_WEIGHT = 0.25, 20.0, 100.0
#: Rows that each declaration is taken to have met each language beforehand.
DECLARED_WEIGHT = 1.0
UNKNOWN = "und"
#: Added to each trigram's count; and what UNKNOWN spreads its likelihood over: more than there are slots, so that a text is
#: only rejected if most of its trigrams are none of any language's.
SMOOTH, SPREAD = 0.1, 1 << 18

#: Letters as they are, in lower case; all else is one kind of gap.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    #: Natural logarithms of trigram probabilities by language, UNKNOWN last.
    logs: np.ndarray


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of each trigram that has a letter, of texts with a gap before and after."""
    n = np.diff(offsets) + 2
    seq = np.insert(_FOLD[data], np.concatenate([offsets[:-1], offsets[1:]]), 32)
    row = np.repeat(np.arange(len(n)), n)
    v = seq.astype(np.uint32)
    h = ((v[:-2] << np.uint32(16) | v[1:-1] << np.uint32(8) | v[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ok = (row[:-2] == row[2:]) & ((seq[:-2] != 32) | (seq[1:-1] != 32) | (seq[2:] != 32))
    return row[:-2][ok], h[ok].astype(np.int64)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by label, summed over a task."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column("label").to_pylist(), object)
        for at, data, offsets in textcore.texts(batch.column("text")):
            row, slot = trigrams(data, offsets)
            for label in set(labels[at : at + len(offsets) - 1]):
                own = labels[at + row] == label
                found[label] = found.get(label, 0) + np.bincount(slot[own], minlength=SLOTS)
    if found:
        yield pa.RecordBatch.from_pydict({"label": list(found), "counts": [x.astype(np.int64).tobytes() for x in found.values()]})


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, most: int = LABELS) -> Model:
    """Trigram models of the ``most`` most frequent labels, each of at most ``sample`` distinct texts, those of the least hash."""
    d = columns(docs, text=text_col, label=label_col).where(F.col("text").isNotNull() & F.col("label").isNotNull())
    d = d.select(F.col("label").cast("string").alias("label"), "text", F.xxhash64("text").alias("h"))
    # Distinct hashes by label, by an estimate: where a label's sample may end.
    labels = d.groupBy("label").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("rows"), "label").limit(most)
    share = labels.select("label", F.least(F.lit(1.0), F.lit(2.0 * sample) / F.greatest("texts", F.lit(1))).alias("share"))
    some = d.join(F.broadcast(share), "label").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000).drop("share")
    some = some.dropDuplicates(["label", "h"])
    first = Window.partitionBy("label").orderBy("h")
    some = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample).select("text", "label").repartition(d.sparkSession.sparkContext.defaultParallelism)
    counts: dict[str, np.ndarray] = {}
    for r in some.mapInArrow(count_batches, "label string, counts binary").collect():  # a row for each label and task
        counts[r["label"]] = counts.get(r["label"], 0) + np.frombuffer(r["counts"], np.int64)
    languages = sorted(counts)
    logs = [np.log((counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * SLOTS)) for x in languages]
    return Model([*languages, UNKNOWN], np.array([*logs, np.full(SLOTS, -np.log(SPREAD))], np.float32))


def without_parts(page: str) -> str:
    """A page with a space for each script, style, navigation, head and comment; what isn't closed stays. One pass: where no end of
    a kind is left, none is looked for again."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in re.finditer(r"(?i)</(script|style|nav|head)\s*>", page):
        ends.setdefault(m[1].lower(), []).append(m.span())
    ends["!--"] = [m.span() for m in re.finditer("-->", page)]
    out, at = [], 0
    for m in re.finditer(r"(?i)<(script|style|nav|head)\b|<(!--)", page):
        if m.start() < at:
            continue
        own = ends.get((m[1] or m[2]).lower(), [])
        k = bisect.bisect_left(own, (m.end(), 0))
        if k < len(own):
            out += [page[at : m.start()], " "]
            at = own[k][1]
    return "".join([*out, page[at:]])


def visible(page: str | None) -> str:
    """The text of a page without scripts, styles, navigation, comments and tags, in time in proportion to its length."""
    page = without_parts(page or "")
    end = page.rfind(">") + 1  # beyond it no tag ends
    return html.unescape(re.sub(r"<[^>]*>", " ", page[:end]) + page[end:])


def likelihood_batches(model, markup: bool):
    """``logs`` (natural, by language) and ``n`` (trigrams) of each row's text, or of a page's visible text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value.logs
        for batch in batches:
            text = batch.column("text")
            if markup:
                text = pa.array([visible(x.as_py()) for x in text], pa.large_string())
            sums, n = np.zeros((batch.num_rows, len(logs))), np.zeros(batch.num_rows, np.int64)
            for at, data, offsets in textcore.texts(text):
                row, slot = trigrams(data, offsets)
                k = len(offsets) - 1
                n[at : at + k] = np.bincount(row, minlength=k)
                for i, own in enumerate(logs):
                    sums[at : at + k, i] = np.bincount(row, own[slot], k)
            kept = [x for x in batch.schema.names if x != "text"]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(logs)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), lists, pa.array(n)], names=[*kept, "logs", "n"])

    return run


def softmax(logs: Column) -> Column:
    top = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(top, F.lit(0.0), lambda a, x: a + x)
    return F.transform(top, lambda x: x / total)


def fuse(rows: DataFrame, model: Model, markup: bool = False) -> DataFrame:
    """``id, k1, k2, lang, confidence, text_lang, prior`` from ``id, text, declared, host, suffix``: every row.

    A null or empty declaration, host or suffix is a value of its own. Text without letters (null, empty, digits) is
    UNKNOWN with confidence 1. Repeated rows are all returned, alike, and each counts in the priors. Equal scores go to the
    first language by name.
    """
    kinds = rows.schema["id"].dataType.simpleString()
    r = rows.select("id", *row_key(*[rows[x] for x in ("id", "text", "declared", "host", "suffix")]), *[F.coalesce(x, F.lit("")).alias(x) for x in ("declared", "host", "suffix")], "text")
    r = r.mapInArrow(likelihood_batches(r.sparkSession.sparkContext.broadcast(model), markup), f"id {kinds}, k1 long, k2 long, declared string, host string, suffix string, logs array<double>, n long")
    k = len(model.languages)
    r = r.withColumn("logs", F.transform("logs", lambda x: x * POWER))
    post = F.when(F.col("n") > 0, softmax(F.col("logs"))).otherwise(F.array(*[F.lit(float(i == k - 1)) for i in range(k)]))
    r = checkpoint(r.withColumn("post", post))
    sums = [F.array(*[F.sum(F.col("post")[i]) for i in range(k)]).alias("sum"), F.count("*").cast("double").alias("m")]

    whole = r.agg(*sums).first()
    everyone = [((whole["sum"][i] or 0.0) + 1.0) / (whole["m"] + k) for i in range(k)]
    by_suffix = checkpoint(r.groupBy("suffix").agg(*sums))
    prior = F.zip_with("sum", F.array(*map(F.lit, everyone)), lambda s, p: (s + SUFFIX_WEIGHT * p) / (F.col("m") + SUFFIX_WEIGHT))
    by_suffix = by_suffix.select("suffix", prior.alias("above"))
    by_host = r.groupBy("host", "suffix").agg(F.array(*[F.sum(F.col("post")[i]) for i in range(k)]).alias("host_sum"), F.count("*").cast("double").alias("host_n"))
    by_host = checkpoint(by_host.join(broadcast_if_small(by_suffix, by_suffix.count()), "suffix"))
    by_declared = checkpoint(r.groupBy("declared").agg(sums[0]))
    n_declared = by_declared.count()
    met = F.transform("sum", lambda s, i: F.log((s + DECLARED_WEIGHT) / (F.get(F.array(*[F.lit(float(x or 0.0)) for x in (whole["sum"] or [0.0] * k)]), i) + DECLARED_WEIGHT * max(1, n_declared))))
    by_declared = by_declared.select("declared", F.when(F.col("declared") == "", F.array_repeat(F.lit(0.0), k)).otherwise(met).alias("said"))

    out = r.join(broadcast_if_small(by_host, by_host.count()), ["host", "suffix"]).join(broadcast_if_small(by_declared, n_declared), "declared")
    prior = F.transform("above", lambda p, i: (F.greatest(F.get("host_sum", i) - F.get("post", i), F.lit(0.0)) + HOST_WEIGHT * p) / (F.col("host_n") - 1 + HOST_WEIGHT))
    out = out.withColumn("prior", prior)
    out = out.withColumn("all", F.transform("logs", lambda x, i: x + F.log(F.get("prior", i)) + F.get("said", i)))
    out = out.withColumn("fused", softmax(F.col("all")))
    name = lambda best, of: F.get(F.array(*map(F.lit, model.languages)), (F.array_position(of, best) - 1).cast("int"))
    best = F.array_max("fused")
    none = F.col("n") == 0
    return out.select(
        "id", "k1", "k2",
        F.when(none, UNKNOWN).otherwise(name(best, F.col("fused"))).alias("lang"),
        F.when(none, 1.0).otherwise(F.round(best, 6)).alias("confidence"),
        F.when(none, UNKNOWN).otherwise(name(F.array_max("post"), F.col("post"))).alias("text_lang"),
        "prior", "host", "declared",
    )


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages by visible text, the ``lang`` of their root element, the last label of their host, and the host."""
    p = columns(pages, id=id_col, url=url_col, text=html_col)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    root = F.regexp_extract("text", r"(?i)<html\b([^>]*)", 1)
    declared = F.lower(F.regexp_extract(root, r"(?i)\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return fuse(p.select("id", "text", declared.alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix")), model, markup=True)


def identify_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Plain documents: their source is the host, there is no suffix, and the declared language is a column."""
    d = columns(docs, id=id_col, text=text_col, declared=declared_col, host=host_col)
    return fuse(d.select("id", "text", F.col("declared").cast("string").alias("declared"), F.col("host").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix")), model)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with models of the labelled documents."""
    out = identify_pages(read(spark, sf_dir, "pages"), train(read(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("page_id"), "lang", "confidence", "text_lang", "declared", "host")
