"""Substring dedup (8) by level-wise doubling: 9, 18, then the full 35 words.

Level 1 takes windows of 9 words: of each 35-word window the one with the least hash (leftmost of equals), so that equal
long windows have equal short ones at the same place. Only those that occur at two places or more are extended to 18
words, to the left and to the right; only those of which that still occurs twice, to full windows; and of these, the ones
that occur once are taken out again. Each level is a grouped minimum and maximum of places, which combines before it is
shuffled, so that a passage of a third of all documents gathers nowhere. Places are those of distinct texts; a text that
is there twice or more is known by its own hash and goes as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import common, textcore
from tracelake.llm.common import broadcast_if_small, checkpoint, columns, read

WINDOW = 35


class Grams:
    """The windows of a run of texts: word hashes, and for each full window its place and that of its least short window."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.short = max(1, (window + 2) // 4)
        starts, ends, self.first = textcore.words(data, offsets)
        self.hashes = textcore.word_hashes(data, starts, ends)
        n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(n)), n)
        index = np.arange(len(self.hashes))
        self.end = self.first[1:][self.row]
        self.start = self.first[:-1][self.row]
        self.place = np.flatnonzero(index + window <= self.end)
        if not len(self.place):
            self.least = self.place
            return
        count = len(index) - self.short + 1
        gram = textcore.range_hashes(self.hashes, index[:count], index[:count] + self.short, textcore.BASES[1])
        value, at, width = gram, index[:count], 1
        span = window - self.short + 1
        while width * 2 <= span:
            value, at = self._less(value, at, width)
            width *= 2
        if width < span:
            value, at = self._less(value, at, span - width)
        self.gram, self.least = gram, at[self.place]

    @staticmethod
    def _less(value: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[shift:] < value[:-shift]
        return np.where(right, value[shift:], value[:-shift]), np.where(right, at[shift:], at[:-shift])

    def anchors(self) -> np.ndarray:
        return self.least[np.flatnonzero(np.r_[True, np.diff(self.least) != 0])] if len(self.least) else self.least

    def hash(self, places: np.ndarray, n: int, which: int = 1) -> np.ndarray:
        return textcore.range_hashes(self.hashes, places, places + n, textcore.BASES[which])


def packed(t2: np.ndarray, place: np.ndarray) -> np.ndarray:
    """32 bits of the text's second hash above the place in it."""
    return (t2.astype(np.int64) << 32) | place.astype(np.int64)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("t1").to_numpy(zero_copy_only=False), batch.column("t2").to_numpy(zero_copy_only=False)


def anchor_batches(window: int, extended: bool):
    """Level 1: rows ``gram, loc`` of all anchors; if extended, ``gram, t1, t2, pos, left, right`` with the hashes of twice that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = _keys(batch)
            for at, data, offsets in textcore.texts(batch.column("text")):
                g = Grams(data, offsets, window)
                a = g.anchors()
                if not len(a):
                    continue
                row, pos = at + g.row[a], a - g.start[a]
                gram = pa.array(g.gram[a].view(np.int64))
                if not extended:
                    loc = textcore.mix(t1[row].view(np.uint64) ^ textcore.mix(packed(t2[row], pos).view(np.uint64)))
                    yield pa.RecordBatch.from_arrays([gram, pa.array(loc.view(np.int64))], names=["gram", "loc"])
                    continue
                n = 2 * g.short
                left, right = a - g.short >= g.start[a], a + n <= g.end[a]
                sides = [pa.array(g.hash(np.where(ok, x, 0), n if len(g.hashes) >= n else 0).view(np.int64), mask=~ok) for x, ok in ((a - g.short, left), (a, right))]
                yield pa.RecordBatch.from_arrays([gram, pa.array(t1[row]), pa.array(t2[row]), pa.array(pos.astype(np.int32)), *sides], names=["gram", "t1", "t2", "pos", "left", "right"])

    return run


def window_batches(window: int):
    """Level 3: for each text the full windows around its surviving anchors, as arrays of places and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = _keys(batch)
            sides = batch.column("sides")
            for at, data, offsets in textcore.texts(batch.column("text")):
                g = Grams(data, offsets, window)
                if not len(g.place):
                    continue
                ok = np.zeros((2, len(g.hashes)), bool)
                for i in range(len(offsets) - 1):
                    own = np.asarray(sides[at + i].values)
                    ok[own & 1, g.first[i] + (own >> 1)] = True
                before = g.least - g.place
                keep = (ok[0][g.least] & (before >= g.short)) | (ok[1][g.least] & (before + 2 * g.short <= window))
                place = g.place[keep]
                row = g.row[place]
                rows, begin = np.unique(row, return_index=True)
                cuts = pa.array(np.r_[begin, len(row)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((place - g.start[place]).astype(np.int32), g.hash(place, window, 0).view(np.int64), g.hash(place, window, 1).view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(t1[at + rows]), pa.array(t2[at + rows]), *lists], names=["t1", "t2", "pos", "w1", "w2"])

    return run


def cut_batches(window: int):
    """``text`` without the words under the windows that begin at ``starts``, or under any window if ``copied``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            for text, starts, copied in zip(batch.column("text").cast(pa.binary()), batch.column("starts"), batch.column("copied").to_pylist()):
                words = (text.as_py() or b"").split()
                n = removed = len(words)
                if copied and n >= window:
                    words = []
                elif starts.is_valid and len(starts):
                    edge = np.zeros(n + 1, np.int32)
                    at = np.asarray(starts.values)
                    edge[at] += 1
                    edge[at + window] -= 1
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                total.append(n)
                gone.append(removed - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, text, n_words, n_removed``: every row, its words joined by a space, less those under a repeated window.

    A window is ``window`` (4 or more) consecutive words; it is repeated if its words begin anywhere else, in the same text
    too. Null, empty and shorter texts lose nothing. Repeated rows, and texts equal to others, lose all their words if
    they have a window. An empty table gives an empty result; other columns are not read.
    """
    if window < 4:
        raise ValueError("window must be 4 or more")
    d = columns(docs, id=id_col, text=text_col)
    kind = d.schema["id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    # The last 32 bits of the second hash go with a place: 96 bits for a text.
    d = d.select("id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("t2"))
    copied = checkpoint(d.groupBy("t1", "t2").count().where("count > 1").select("t1", "t2", F.lit(True).alias("copied")))

    keyed = d.select("t1", "t2", "text")
    grams = keyed.mapInArrow(anchor_batches(window, False), "gram long, loc long")
    grams = checkpoint(grams.groupBy("gram").agg(F.min("loc").alias("a"), F.max("loc").alias("b")).where("a != b").select("gram"))
    extended = keyed.mapInArrow(anchor_batches(window, True), "gram long, t1 long, t2 int, pos int, left long, right long")
    extended = extended.join(broadcast_if_small(grams, grams.count(), common.KEYS), "gram", "left_semi")
    sides = extended.select("t1", "t2", "pos", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(x).alias("h")) for i, x in enumerate(("left", "right"))])).alias("x"))
    sides = checkpoint(sides.select("t1", "t2", (F.col("pos") * 2 + F.col("x.side")).alias("side"), F.col("x.h").alias("h")).where("h IS NOT NULL"))
    loc = F.xxhash64("t1", "t2", "side")
    twice = checkpoint(sides.groupBy("h").agg(F.min(loc).alias("a"), F.max(loc).alias("b")).where("a != b").select("h"))
    sides = sides.join(broadcast_if_small(twice, twice.count(), common.KEYS), "h", "left_semi")
    sides = checkpoint(sides.groupBy("t1", "t2").agg(F.collect_set("side").alias("sides")))

    n = sides.count()
    near = keyed.join(broadcast_if_small(sides.select("t1", "t2"), n, common.KEYS), ["t1", "t2"], "left_semi") if n <= common.KEYS else keyed
    near = near.dropDuplicates(["t1", "t2"]).join(sides, ["t1", "t2"])
    windows = checkpoint(near.select("t1", "t2", "text", "sides").mapInArrow(window_batches(window), "t1 long, t2 int, pos array<int>, w1 array<long>, w2 array<long>"))
    each = windows.select("t1", "t2", F.explode(F.arrays_zip("pos", "w1", "w2")).alias("x"))
    place = F.shiftleft(F.col("t2").cast("long"), 32).bitwiseOR(F.col("x.pos").cast("long"))
    once = each.groupBy("x.w1", "x.w2").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min(place).alias("p"), F.max(place).alias("q"))
    once = once.where("a = b AND p = q").select(F.col("a").alias("t1"), F.shiftright("p", 32).cast("int").alias("t2"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
    once = once.groupBy("t1", "t2").agg(F.collect_set("pos").alias("once"))
    found = windows.join(once, ["t1", "t2"], "left").select("t1", "t2", F.array_except("pos", F.coalesce("once", F.array().cast("array<int>"))).alias("starts"))
    found = checkpoint(found.where(F.size("starts") > 0).join(copied, ["t1", "t2"], "full").select("t1", "t2", "starts", F.coalesce("copied", F.lit(False)).alias("copied")))

    n = found.count()
    cut, out = cut_batches(window), f"doc_id {kind}, text string, n_words long, n_removed long"
    flags = ["id", "text", "starts", "copied"]
    if n > common.KEYS:
        return d.join(found, ["t1", "t2"], "left").select("id", "text", "starts", F.coalesce("copied", F.lit(False)).alias("copied")).mapInArrow(cut, out)
    # Only texts that lose a part of their words are shuffled; the rest are told apart by their keys.
    known = d.join(F.broadcast(found.select("t1", "t2", "copied")), ["t1", "t2"], "left")
    parts = known.where(~F.col("copied")).drop("copied").join(found.where(~F.col("copied")), ["t1", "t2"])
    rest = known.where(F.col("copied") | F.col("copied").isNull()).select("id", "text", F.lit(None).cast("array<int>").alias("starts"), F.coalesce("copied", F.lit(False)).alias("copied"))
    return parts.select(flags).mapInArrow(cut, out).unionByName(rest.select(flags).mapInArrow(cut, out))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS span FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY span) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM r),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT p.doc_id, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (c.pos IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
