"""Source divergence audit (13): which sources of a language use its terms unlike it, and unlike each other.

Counts are added up within each task before they are shuffled, for the documents of a term too, since a document is in one
task. From then on all work is on postings (a count for each term and group that has it) and on buckets (for each group,
the terms of one count: how many, and the least probability that the language gives one of them).

The most divergent terms are searched best first: within a bucket a term's own probability is the same, and the rarest in
the language is the furthest from it, which bounds the bucket's values. Buckets are evaluated in rounds, highest bounds
first and eight times as many terms each round, until no bound that is left reaches the value of the last place.

A sum over all terms of two groups is a sum over the terms that both have, from the postings, and what buckets say of the
others: a group's terms against the other's probability of an unseen term, and the other way round.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import UPPER, broadcast_if_small, checkpoint, columns, read

SCALE, DOCS, TOP = 1_000_000_000, 3, 200
#: A task counts so many terms of groups before it hands them on; works on so many bytes of a text, and so many pairs, at a time.
COUNTED, CHUNK, PAIRS = 400_000, 1 << 20, 1 << 20
#: Terms that the first round evaluates, times the places wanted; and by how much a round grows.
GROWTH = 8
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), UPPER.lower().encode()))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of those of about CHUNK bytes: letters of ASCII in lower case, and all beyond ASCII."""
    lo = 0
    while lo < len(text):
        part = text[lo : lo + CHUNK].translate(_LETTERS)
        if lo + CHUNK < len(text) and (cut := part.rfind(b" ") + 1):
            part = part[:cut]
        elif lo + CHUNK < len(text):  # no end of a term in sight
            rest = text[lo:].translate(_LETTERS)
            part = rest[: rest.find(b" ", CHUNK) + 1] if b" " in rest[CHUNK:] else rest
        yield part.split()
        lo += len(part)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of the rows that a task has read; a null term for each group."""
    count: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in count.items():
            found = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        count.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.large_binary())):
            n, docs = count[lang, source]
            before, here = len(n), set()
            for part in terms(text.as_py()):
                n.update(part)
                here.update(part)
            docs.update(here)
            size += len(n) - before
            if size > COUNTED:
                yield from rows()
                size = 0
                n, docs = count[lang, source]
    yield from rows()


def share(n: Column, total: Column, kinds: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + kinds))``, exactly: in decimals, as counts of a large corpus leave no room in longs."""
    whole = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.call_function("div", whole(n + 1, 19) * whole(F.lit(SCALE), 10), whole(total + kinds, 19)) + F.lit(1).cast("long")


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)`` of shares: at most the square of SCALE, which a long holds."""
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, item, value``: over the terms of a partition (sorted by lang and term) that two groups have, the sums of
    what their shares give more than each with the other's share of an unseen term would."""
    sums: dict[tuple[str, str, str], int] = defaultdict(int)

    def rows() -> Iterator[pa.RecordBatch]:
        if sums:
            lang, source, item = zip(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(sums.values(), pa.int64())], ["lang", "source", "item", "value"])
            sums.clear()

    def add(t: pd.DataFrame) -> None:
        new = np.r_[True, (t["term"].to_numpy()[1:] != t["term"].to_numpy()[:-1]) | (t["lang"].to_numpy()[1:] != t["lang"].to_numpy()[:-1])]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(t)])[group]  # of each row's term
        code, kinds = pd.factorize(pd.MultiIndex.from_frame(t[["lang", "source"]]))
        p, p0 = t["p"].to_numpy(), t["p0"].to_numpy()
        ends = np.cumsum(size)
        lo = 0
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + PAIRS, "right")))
            a = np.repeat(np.arange(lo, hi), size[lo:hi])
            b = first[group[a]] + np.arange(len(a)) - np.repeat(ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo]), size[lo:hi])
            a, b = a[a != b], b[a != b]
            value = (p[a] - p[b]) ** 2 // p[b] - (p[a] - p0[b]) ** 2 // p0[b] - (p0[a] - p[b]) ** 2 // p[b] + (p0[a] - p0[b]) ** 2 // p0[b]
            pair, at = np.unique(code[a] * len(kinds) + code[b], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, value)
            for x, v in zip(pair.tolist(), total.tolist()):
                (lang, source), (_, item) = kinds[x // len(kinds)], kinds[x % len(kinds)]
                sums[lang, source, item] += v
            lo = hi

    rest = None
    for batch in batches:
        t = batch.to_pandas()
        t = t if rest is None else pd.concat([rest, t], ignore_index=True)
        last = (t["term"] == t["term"].iloc[-1]) & (t["lang"] == t["lang"].iloc[-1])  # may go on in the next batch
        rest = t[last]
        if not last.all():
            add(t[~last].reset_index(drop=True))
        if len(sums) > COUNTED:
            yield from rows()
    if rest is not None and len(rest):
        add(rest.reset_index(drop=True))
    yield from rows()


class Shares:
    """The kept tables of a corpus: groups, postings and buckets."""

    def __init__(self, docs: DataFrame, lang_col: str, source_col: str, text_col: str, least: int):
        d = columns(docs, lang=lang_col, source=source_col, text=text_col)
        d = d.select(*[F.coalesce(c, F.lit("")).alias(c) for c in d.columns])
        counted = d.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        # Dealt out by lang and term once: sums by group and by lang then need no further exchange.
        counted = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        seen = counted.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("of_lang"), F.sum("docs").over(of_term).alias("docs"), F.row_number().over(of_term.orderBy("source")).alias("place"))
        seen = checkpoint(seen.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs"))
        postings = seen.where(F.col("term").isNotNull())
        langs = postings.where("place = 1").groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("of_lang").alias("lang_total"))
        own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_kinds"))
        groups = seen.where(F.col("term").isNull()).select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.na.fill(0, ["total", "own_kinds", "kinds", "lang_total"])
        #: lang, source, total, own_kinds (terms it has), kinds (of the lang), lang_total, p0 (the share of a term it hasn't; null without terms).
        self.groups = checkpoint(groups.withColumn("p0", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.greatest("kinds", F.lit(1))))))
        self.n_groups = self.groups.count()
        postings = postings.join(self.bounded(self.groups.select("lang", "source", "total", "kinds", "lang_total", "p0")), ["lang", "source"])
        #: lang, source, term, n, p (its share), q (the lang's), p0: of kept terms that the group has.
        self.postings = checkpoint(postings.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("kinds")).alias("q"), "p0"))
        #: lang, source, n, m (terms of that count), p, q (the least of theirs), p0. A group has at most some sqrt(2 * total) of them.
        self.buckets = checkpoint(self.postings.groupBy("lang", "source", "n").agg(F.count("*").alias("m"), F.first("p").alias("p"), F.min("q").alias("q"), F.first("p0").alias("p0")))

    def bounded(self, groups: DataFrame) -> DataFrame:
        return broadcast_if_small(groups, self.n_groups)

    def divergent_terms(self, top: int) -> DataFrame:
        """``lang, source, item, value``: the ``top`` terms of each group whose share exceeds the lang's, by value, then term."""
        keys = ["lang", "source"]
        best_first = Window.partitionBy(*keys).orderBy(F.desc("bound"), F.desc("n"))
        bounds = self.buckets.where(F.col("p") > F.col("q")).select(*keys, "n", "m", distance(F.col("p"), F.col("q")).alias("bound"))
        before = F.sum("m").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
        bounds = checkpoint(bounds.select("*", F.coalesce(before, F.lit(0)).alias("before")))
        places = Window.partitionBy(*keys).orderBy(F.desc("value"), "item")
        best, hi = None, top
        left = bounds
        while (n := left.count()) or best is None:
            taken = left.where(F.col("before") < hi).select(*keys, "n")
            found = self.postings.join(broadcast_if_small(taken, n), [*keys, "n"]).where(F.col("p") > F.col("q"))
            found = found.select(*keys, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
            best = found if best is None else best.unionByName(found)
            best = checkpoint(best.withColumn("place", F.row_number().over(places)).where(F.col("place") <= top).drop("place"))
            last = best.groupBy(*keys).agg(F.count("*").alias("have"), F.min("value").alias("kth")).where(F.col("have") >= top)
            left = left.where(F.col("before") >= hi).join(self.bounded(last), keys, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
            left = checkpoint(left.select(*bounds.columns))
            hi *= GROWTH
        return best

    def divergent_sources(self) -> DataFrame:
        """``lang, source, item, value``: for each two groups of a lang the sum over all its terms, 0 without any."""
        kept = self.groups.select("lang", "source", "own_kinds", "kinds", "p0")
        other = kept.select("lang", F.col("source").alias("item"), F.col("own_kinds").alias("item_kinds"), F.col("p0").alias("q0"))
        pairs = kept.join(self.bounded(other), "lang").where(F.col("source") != F.col("item"))
        none = F.col("kinds") - F.col("own_kinds") - F.col("item_kinds")  # with the terms of both taken off twice
        rest = pairs.select("lang", "source", "item", F.coalesce(none * distance(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
        alone = self.buckets.select("lang", F.col("source").alias("of"), "m", "p").join(self.bounded(other.select("lang", F.col("item").alias("other"), "q0")), "lang").where(F.col("of") != F.col("other"))
        # The bucket's group stands first, or second.
        sums = [alone.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), (F.col("m") * v).alias("value")) for a, b, v in (("of", "other", distance(F.col("p"), F.col("q0"))), ("other", "of", distance(F.col("q0"), F.col("p"))))]
        both = self.postings.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
        both = both.mapInArrow(_both, "lang string, source string, item string, value long")
        return rest.unionByName(sums[0]).unionByName(sums[1]).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's other sources (part ``pair``) and most divergent terms (``term``).

    A term counts in a language if ``least`` of its documents have it. Each row is a document; ids are not read. Null lang,
    source and text are as empty ones. A language without terms has pairs of value 0 and no terms; a group that is alone has
    no pairs. Equal values are ranked by item. An empty table gives an empty result; other columns are not read.
    """
    s = Shares(docs, lang_col, source_col, text_col, least)
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value") for part, df in (("pair", s.divergent_sources()), ("term", s.divergent_terms(top)))]
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return parts[0].unionByName(parts[1]).withColumn("rank", rank)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS of_lang FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS kinds, sum(of_lang) AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce((SELECT sum(c.n) FROM c JOIN k USING (lang, term) WHERE c.lang = d.lang AND c.source = d.source), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.kinds) AS p, 1 + (1000000000::HUGEINT * (k.of_lang + 1)) // (l.total + l.kinds) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
