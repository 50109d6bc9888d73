"""Ranked full-text search: terms, phrases, prefixes, AND, OR, NOT, BM25, blended ranks, tiers.

An index is of words without endings and diacritics unless it is asked for plain ones. One made on the fly reads its texts
twice for a search, whatever the number of its terms: once for the corpus' figures, once for ranks; nothing is shuffled. Of stems,
which cost more, frequencies are kept for the second pass. A stored
one has postings (one row for a term of a document, with its positions), sorted by term in buckets of its hash, so that a search
reads its own terms' rows only, and gathers them by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelake.functions import kernels
from tracelake.functions.reliable import checkpoint
from tracelake.functions.scalar import exp_decay, type_weight
from tracelake.model import Tables
from tracelake.operators.patterns import like
from tracelake.operators.ranking import between

K1, B = 1.2, 0.75
#: Buckets of a stored index.
BUCKETS = 64
#: Tokens whose postings are grouped at a time; a longer text's are grouped alone.
TOKENS = 1_000_000


@dataclass
class Index:
    texts: DataFrame | None  # doc, tokens
    stemmed: bool
    stored: DataFrame | None = None  # bucket, term, doc, positions array<int>, dl
    n: int = 0
    average: float = 0.0
    buckets: int = BUCKETS

    @property
    def postings(self) -> DataFrame:
        return postings_of(self.texts) if self.stored is None else self.stored.drop("bucket")


def tokens(text: Column, stemmed: bool) -> Column:
    """Words of letters and digits in lower case; stemmed also loses diacritics and endings (an Arrow UDF)."""
    text = F.coalesce(text, F.lit(""))
    return kernels.stems_udf(text) if stemmed else F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def posting_batches(doc: pa.DataType, present: str | None = None):
    """``term, doc, positions, dl`` from ``doc, tokens``: each term of a text with its positions, grouped where the text is. With
    ``present`` each text also has that term, behind its last token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lists = whole.column("tokens")
            ends = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1)
                yield group(whole.slice(at, to - at))
                at = to

    def group(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("tokens")
        size = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        words, row = coded.dictionary, np.repeat(np.arange(len(size)), size)
        code, place = coded.indices.to_numpy().astype(np.int64), np.arange(len(row)) - (np.cumsum(size) - size)[row]
        if present is not None:
            # Its code is one that no token has.
            code, row, place = np.r_[code, np.full(len(size), len(words))], np.r_[row, np.arange(len(size))], np.r_[place, size]
            words = pa.concat_arrays([words, pa.array([present], words.type)])
        key = row * np.int64(len(words)) + code
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else order
        one = order[first]
        positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), pa.array(place[order], pa.int32()))
        return pa.RecordBatch.from_arrays([words.take(pa.array(code[one])).cast(pa.string()), batch.column("doc").take(pa.array(row[one])).cast(doc), positions, pa.array(size[row[one]], pa.int32())], ["term", "doc", "positions", "dl"])

    return run


def postings_of(texts: DataFrame, present: str | None = None) -> DataFrame:
    """``term, doc, positions, dl`` from ``doc, tokens``: a row for each term of a text. Nothing is shuffled."""
    texts = texts.select("doc", "tokens")
    kind = texts.schema["doc"].dataType
    return texts.mapInArrow(posting_batches(to_arrow_type(kind), present), f"term string, doc {kind.simpleString()}, positions array<int>, dl int")


def build(corpus: DataFrame, id_col: str, text_col: str, stemmed: bool = True) -> Index:
    """An index on the fly, of all documents, those without words too."""
    return Index(corpus.select(F.col(id_col).alias("doc"), tokens(F.col(text_col), stemmed).alias("tokens")), stemmed)


def by_bucket(rows: DataFrame) -> DataFrame:
    """Postings dealt out by bucket and sorted by term; a bucket with a term of most documents is split, small ones share a task."""
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc")


def store(index: Index, path: str, buckets: int = BUCKETS) -> Index:
    """Writes the index: postings by bucket and term, and the corpus' figures; what is there is replaced."""
    rows = index.postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    by_bucket(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    figures = index.texts.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("average"), F.lit(index.stemmed).alias("stemmed"), F.lit(buckets).alias("buckets"))
    figures.write.mode("overwrite").parquet(f"{path}/figures")
    return load(index.texts.sparkSession, path)


def load(spark: SparkSession, path: str) -> Index:
    f = spark.read.parquet(f"{path}/figures").first()
    return Index(None, f["stemmed"], spark.read.parquet(f"{path}/postings").select("bucket", "term", "doc", "positions", "dl"), f["n"], f["average"], f["buckets"])


def _digests(index: Index) -> DataFrame:
    """``doc, digest``: of each document that has a word four sums over its tokens' places, with the text's length."""
    halves = [lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)]
    if index.stored is None:
        hashed = lambda seed: F.transform("tokens", lambda x, i: F.xxhash64(F.lit(seed), x, i, F.size("tokens")))
        rows = index.texts.where(F.size("tokens") > 0)
    else:
        hashed = lambda seed: F.transform("positions", lambda i: F.xxhash64(F.lit(seed), F.col("term"), i, F.col("dl")))
        rows = index.stored
    total = lambda hashes, half: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + half(h))
    sums = [total(hashed(seed), half).cast("decimal(38,0)") for seed in (1, 2) for half in halves]
    rows = rows.select("doc", *[x.alias(f"s{i}") for i, x in enumerate(sums)])
    return rows.groupBy("doc").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))]).select("doc", F.struct("s0", "s1", "s2", "s3").alias("digest"))


def _of_docs(index: Index, docs: DataFrame) -> Index:
    """The index of these documents (``doc``) only."""
    part = lambda x: x if x is None else x.join(docs, "doc", "left_semi")
    return replace(index, texts=part(index.texts), stored=part(index.stored))


def missing_postings(index: Index, corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """An integrity check: postings that should be there and aren't, or are and shouldn't (side).

    Documents are compared by 128 bits of sums over all their words and places first; only the postings of those that differ are
    gathered and compared one by one.
    """
    wanted = build(corpus, id_col, text_col, index.stemmed)
    sides = _digests(wanted).unionByName(_digests(index))
    # Equal documents are there twice with one digest.
    same = sides.groupBy("doc", "digest").agg(F.count("*").alias("n"))
    differ = checkpoint(same.where("n = 1").select("doc").distinct())
    want, have = (_of_docs(x, differ).postings.select("term", "doc", F.array_join("positions", ",").alias("at")) for x in (wanted, index))
    both = want.withColumn("side", F.lit("missing")).unionByName(have.withColumn("side", F.lit("extra")))
    seen = both.groupBy("term", "doc", "at").agg(*[F.count_if(F.col("side") == x).alias(x) for x in ("missing", "extra")]).where("missing = 0 OR extra = 0")
    # As often as it is there.
    return seen.select("term", "doc", "at", F.when(F.col("extra") == 0, "missing").otherwise("extra").alias("side"), F.explode(F.sequence(F.lit(1), F.greatest("missing", "extra").cast("int"))).alias("_")).drop("_")


@dataclass
class Query:
    leaves: list[tuple[tuple[str, ...], bool]] = field(default_factory=list)  # words, whether the last is a prefix
    tree: tuple | None = None


def parse(text: str, stemmed: bool = False, into: Query | None = None) -> Query:
    """The tree of a search: neighbours bind tightest, then NOT, AND and OR. An operator without an operand is an error.

    Words that hold no letter or digit stand for nothing: what is left of an operator by them is its other side.
    """
    q = into or Query()
    parts = re.findall(r'"[^"]*"\*?|\S+', text)
    at = 0

    def leaf() -> tuple | None:
        nonlocal at
        part = parts[at] if at < len(parts) else None
        if part in (None, "AND", "OR", "NOT"):
            raise ValueError(f"search: a word is missing in {text!r}" + (f" before {part}" if part else " at the end"))
        at += 1
        words = tuple(kernels.stems(part) if stemmed else re.findall(r"[^\W_]+", part.lower()))
        if not words:
            return None
        q.leaves.append((words, part.endswith("*")))
        return ("leaf", len(q.leaves) - 1)

    def joined(kind: str, a: tuple | None, b: tuple | None) -> tuple | None:
        return b if a is None else a if b is None else (kind, a, b)

    def neighbours() -> tuple | None:
        out = leaf()
        while at < len(parts) and parts[at] not in ("AND", "OR", "NOT"):
            out = joined("and", out, leaf())
        return out

    def level(operator: str, below) -> tuple | None:
        nonlocal at
        out = below()
        while at < len(parts) and parts[at] == operator:
            at += 1
            out = joined(operator.lower(), out, below())
        return out

    q.tree = level("OR", lambda: level("AND", lambda: level("NOT", neighbours))) if parts else None
    return q


def _in_texts(tokens: Column, words: tuple[str, ...], prefix: bool) -> Column:
    """How often a leaf occurs in an array of tokens."""
    fits = lambda x, j: x.startswith(words[j]) if prefix and j == len(words) - 1 else x == words[j]
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda x: fits(x, 0)))
    last = F.size(tokens) - len(words)

    def begins(i: Column) -> Column:
        out = fits(F.get(tokens, i), 0)
        for j in range(1, len(words)):
            out = out & fits(F.get(tokens, i + j), j)
        return out

    return F.when(last >= 0, F.size(F.filter(F.sequence(F.lit(0), last), begins))).otherwise(0)


def _in_postings(words: tuple[str, ...], prefix: bool) -> Column:
    """The same as an aggregate over a document's postings: each word's positions, moved back by its place, meet where it begins."""
    term = F.col("term")
    fits = lambda j: term.startswith(words[j]) if prefix and j == len(words) - 1 else term == words[j]
    moved = lambda by: F.transform("positions", lambda x: x - by)
    if len(words) == 1:
        return F.coalesce(F.sum(F.when(fits(0), F.size("positions"))), F.lit(0)).cast("int")
    out = None
    for j in range(len(words)):
        places = F.flatten(F.collect_list(F.when(fits(j), moved(j))))
        out = places if out is None else F.array_intersect(out, places)
    return F.size(out)


def _frequencies(index: Index, leaves: list[tuple[tuple[str, ...], bool]]) -> DataFrame:
    """``doc, dl, f0, f1, ...``: of all documents, or of a stored index's those that have one of the terms."""
    if index.stored is None:
        # One expression that names the tokens once, behind a generator: a filter of the figures is not pushed below it, where it
        # would tokenise each text again, for a phrase even at each of its words.
        figures = lambda w: F.struct(F.size(w).alias("dl"), *[_in_texts(w, *x).alias(f"f{i}") for i, x in enumerate(leaves)])
        return index.texts.select("doc", F.inline_outer(F.transform(F.array("tokens"), figures)))
    rows = index.stored
    exact = sorted({w for words, prefix in leaves for w in (words[:-1] if prefix else words)})
    begins = sorted({words[-1] for words, prefix in leaves if prefix})
    wanted = F.col("term").isin(exact) if exact else F.lit(False)
    for x in begins:
        wanted = wanted | F.col("term").startswith(x)
    if not begins:
        # Only the terms' buckets are read.
        hashes = rows.sparkSession.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(index.buckets)).cast("int") for w in exact])).first()[0]
        rows = rows.where(F.col("bucket").isin(sorted(set(hashes))))
    return rows.where(wanted).groupBy("doc", "dl").agg(*[_in_postings(*x).alias(f"f{i}") for i, x in enumerate(leaves)])


def _holds(node: tuple) -> Column:
    kind, *items = node
    if kind == "leaf":
        return F.col(f"f{items[0]}") > 0
    a, b = map(_holds, items)
    return a & b if kind == "and" else a | b if kind == "or" else a & ~b


def _counted(node: tuple, given: Column) -> list[tuple[int, Column]]:
    """Leaves that count for a rank, and when: if all that they are a part of holds, and never behind NOT."""
    if node[0] == "leaf":
        return [(node[1], given)]
    own = given if node[0] == "or" else given & _holds(node)
    return [x for side in (node[1:2] if node[0] == "not" else node[1:]) for x in _counted(side, own)]


def _evaluated(index: Index, queries: list[str]) -> tuple[DataFrame, list[tuple[Column, Column]], list[int]]:
    """Frequencies in documents; for each query that has words whether it holds and its rank; how many documents it holds for."""
    q, trees = Query(), []
    for text in queries:
        parse(text, index.stemmed, q)
        trees += [q.tree] if q.tree is not None else []
    docs = _frequencies(index, q.leaves)
    if not trees:
        return docs, [], []
    if index.stored is None and index.stemmed:
        docs = checkpoint(docs)  # a few numbers each, kept for both passes: stems are the dear part
    figures = docs.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg("dl"), F.lit(0.0)).alias("average"),
        F.array(*[F.count_if(F.col(f"f{i}") > 0) for i in range(len(q.leaves))]).alias("with"),
        F.array(*[F.count_if(_holds(t)) for t in trees]).alias("found"),
    ).first()  # one row
    n, average = (figures["n"], figures["average"]) if index.stored is None else (index.n, index.average)
    out = []
    for t in trees:
        score = F.lit(0.0)
        for i, given in _counted(t, F.lit(True)):
            f, have = F.col(f"f{i}").cast("double"), figures["with"][i]
            idf = F.greatest(F.log((F.lit(float(n)) - have + 0.5) / (F.lit(float(have)) + 0.5)), F.lit(1e-6))
            score = score + F.when((f > 0) & given, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(average)))).otherwise(0.0)
        out.append((_holds(t), -score))
    return docs, out, figures["found"]


def matches(index: Index, query: str) -> DataFrame:
    """``doc, rank`` of the documents that match; the lower the rank the better. A blank search matches nothing."""
    docs, found, _ = _evaluated(index, [query])
    if not found:
        return docs.select("doc", F.lit(0.0).alias("rank")).limit(0)
    ((holds, rank),) = found
    return docs.where(holds).select("doc", rank.alias("rank"))


def relevance(index: Index, corpus: DataFrame, id_col: str, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """The best documents by rank; ``corpus`` may be filtered, which doesn't change the ranks."""
    m = matches(index, kernels.sanitize(query) or "")
    top = corpus.join(m, corpus[id_col] == m["doc"]).drop("doc").withColumn("rank", F.round("rank", 6)).orderBy("rank", id_col)
    return top.offset(max(0, offset)).limit(max(1, min(limit, 100)))


def blended(index: Index, corpus: DataFrame, id_col: str, query: str, *, as_of: int, timestamp: str, kind: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """By .5 of the rank between the worst and best match, .3 of recency (half-life of 7 days) and .2 of the type."""
    m = matches(index, kernels.sanitize(query) or "")
    m = corpus.join(m, corpus[id_col] == m["doc"]).drop("doc")
    ends = m.agg(F.min("rank").alias("_best"), F.max("rank").alias("_worst"))  # one row
    rank = F.when(F.col("_best") == F.col("_worst"), 1.0).otherwise((F.col("rank") - F.col("_worst")) / (F.col("_best") - F.col("_worst")))
    score = rank * 0.5 + exp_decay((F.lit(as_of) - F.col(timestamp)) / 86400.0, 7.0) * 0.3 + type_weight(F.col(kind)) * 0.2
    out = m.crossJoin(F.broadcast(ends)).withColumn("score", F.round(score, 6)).drop("_best", "_worst", "rank")
    return out.orderBy(F.desc("score"), F.desc(id_col)).offset(max(0, offset)).limit(max(1, min(limit, 100)))


def observations(index: Index, t: Tables, query: str, *, as_of: int, project: str | None = None, obs_type: str | None = None, before: int | None = None, after: int | None = None, order_by: str = "relevance", limit: int = 20, offset: int = 0) -> DataFrame:
    """Observations that match, of a project, a type and an open range of times, by relevance or blended; ``index`` is by id."""
    o = between(t.observations, before, after)
    if obs_type is not None:
        o = o.where(F.col("obs_type") == obs_type)
    if project is not None:
        o = o.join(t.sessions.where(F.col("project") == project).select(F.col("id").alias("session_id")), "session_id", "left_semi")
    if order_by == "relevance":
        return relevance(index, o, "id", query, limit, offset)
    if order_by == "blended":
        return blended(index, o, "id", query, as_of=as_of, timestamp="timestamp", kind="obs_type", limit=limit, offset=offset)
    raise ValueError(f"an order of {order_by!r}: relevance or blended is needed")


def tiered(index: Index, query: str, limit: int = 20) -> DataFrame:
    """Documents of the first tier that has any (all are evaluated at once), best first, with the tier's number."""
    docs, found, n = _evaluated(index, kernels.tiers(query))
    first = next((i for i, x in enumerate(n) if x), None)
    if first is None:
        return docs.select("doc", F.lit(0.0).alias("rank"), F.lit(0).alias("tier")).limit(0)
    return docs.where(found[first][0]).select("doc", F.round(found[first][1], 6).alias("rank"), F.lit(first).alias("tier")).orderBy("rank", "doc").limit(limit)


def _by_episode(m: DataFrame, observations: DataFrame, work_units: DataFrame) -> DataFrame:
    o = observations.select("id", "session_id", "prompt_id").join(m, F.col("id") == m["doc"])
    e = work_units.select("session_id", "episode", "intent", "first_prompt_id", "last_prompt_id")
    o = o.join(e, "session_id").where(F.col("prompt_id").between(F.col("first_prompt_id"), F.col("last_prompt_id")))
    return o.groupBy("tier", "session_id", "episode", "intent").agg(F.round(F.min("rank"), 6).alias("rank"))


def episodes_matching(index: Index, observations: DataFrame, work_units: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Episodes by their best observation; ``index`` is of observations by id."""
    m = matches(index, query).withColumn("tier", F.lit(0))
    return _by_episode(m, observations, work_units).drop("tier").orderBy("rank", "session_id", "episode").limit(limit)


def episodes_tiered(index: Index, observations: DataFrame, work_units: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Episodes of the first tier that has any; without one those that have the text in intent or summary, newest first."""
    docs, found, _ = _evaluated(index, kernels.tiers(query))
    each = F.filter(F.array(*[F.when(holds, F.struct(F.lit(i).alias("tier"), rank.alias("rank"))) for i, (holds, rank) in enumerate(found)]), lambda x: x.isNotNull()) if found else F.array().cast("array<struct<tier:int,rank:double>>")
    rows = _by_episode(docs.select("doc", F.explode(each).alias("x")).select("doc", "x.*"), observations, work_units)
    last = work_units.where(like(query, "intent", "summary")).select(F.lit(len(found)).alias("tier"), "session_id", "episode", "intent", (-F.col("started_at")).cast("double").alias("rank"))
    rows = rows.unionByName(last)
    first = rows.agg(F.min("tier").alias("first"))
    return rows.join(F.broadcast(first), F.col("tier") == F.col("first")).drop("first").orderBy("rank", "session_id", "episode").limit(limit)


def episodes_like(work_units: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Episodes that have the term in intent or summary, newest first."""
    return work_units.where(like(term, "intent", "summary")).orderBy(F.desc("started_at"), "session_id", "episode").limit(limit)
