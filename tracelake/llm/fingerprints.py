"""Document fingerprints (4): SimHash with weighted terms, and a Hamming search over permuted block tables.

Terms are 3-word shingles; a term's weight, a whole number, grows with its length, and each occurrence votes again. The
fingerprint query compares a text with its edited form and with the next document: rows are dealt by ranges of the id (those
without one, which come last, by ranges of a hash), and the first row of each range also goes to the range before it, so that no
row needs a window over the whole table.

The search cuts fingerprints into RADIUS + 2 blocks. Within the radius at least two blocks are equal, so there is a table for
each pair of blocks, as if the bits had been permuted to put that pair first. Only distinct fingerprints are in the tables,
and a bucket yields a count for each of its queries, not its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import textcore
from tracelake.llm.common import broadcast_if_small, checkpoint, columns, read, row_key

BITS, SHINGLE, RADIUS = 64, 3, 3
#: Votes of a term of one byte, for each doubling of its length, and at most. Terms whose votes are counted at a time: the sums
#: of so many are exact in 32-bit floats.
UNIT, MOST, PART = 16, 128, 1 << 12


def simhash(column: pa.Array) -> np.ndarray:
    """Fingerprints of an array of texts: 0 for a text without words. Texts of equal words have equal ones.

    A bit is 1 if the terms whose hash has it set have more than half of all votes.
    """
    out = np.zeros(len(column), np.uint64)
    for at, hashes, starts, ends, first in textcore.hashed(column, folded=False):
        for row in np.flatnonzero(np.diff(first)).tolist():
            lo, hi = int(first[row]), int(first[row + 1])
            votes, total = np.zeros(BITS, np.int64), 0
            # A text of fewer words than a shingle is one term.
            for i in range(lo, max(lo + 1, hi - SHINGLE + 1), PART):
                begin = np.arange(i, min(i + PART, max(lo + 1, hi - SHINGLE + 1)))
                last = np.minimum(begin + SHINGLE, hi)
                term = textcore.range_hashes(hashes[i : last[-1]], begin - i, last - i, textcore.BASES[1])
                weight = np.minimum(UNIT + np.floor(UNIT * np.log2(ends[last - 1] - starts[begin])), MOST).astype(np.float32)
                bits = np.unpackbits(term.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                votes += (weight @ bits).astype(np.int64)
                total += int(weight.sum(dtype=np.float64))
            out[at + row] = np.packbits(votes * 2 > total).view(np.uint64)[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / BITS


#: Bits that are left out of numbers beyond 52, which quantiles would round: so many neighbours then open a range together.
SHIFT = 12


def deal(ids: np.ndarray, hashes: np.ndarray, shift: int):
    """Adds ``part``, ``halo`` to batches of ``id, text, k1``: the range of the id, or without one of the hash, and copies of each
    range's first rows for the range before (1), of the first range's for the last (2).

    ``ids, hashes``: the least of each range, which are there, without their last ``shift`` bits, or SHIFT.
    """
    parts = len(ids) + len(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.asarray(batch.column("id").is_null())
            value, hash_ = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("k1").to_numpy(zero_copy_only=False)
            part, first = np.zeros(len(null), np.int64), np.zeros(len(null), bool)
            for own, bounds, x, begin in ((~null, ids, value >> shift, 0), (null, hashes, hash_ >> SHIFT, len(ids))):
                if own.any():
                    at = np.maximum(np.searchsorted(bounds, x[own], "right") - 1, 0)
                    part[own], first[own] = at + begin, bounds[at] == x[own]
            yield batch.append_column("part", pa.array(part.astype(np.int32))).append_column("halo", pa.array(np.zeros(len(part), np.int32)))
            if len(rows := np.flatnonzero(first)):
                to = (part[rows] - 1) % parts
                halo = np.where(part[rows] > 0, 1, 2)
                yield batch.take(pa.array(rows)).append_column("part", pa.array(to.astype(np.int32))).append_column("halo", pa.array(halo.astype(np.int32)))

    return run


def edit(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many of the following text, or all of it."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of part, halo, id: each own row with the one that follows it."""
    pending = None  # (part, id, text, fingerprint) of the row that waits for its successor

    def rows(left: list, right_texts: list[str], right_fps: np.ndarray) -> pa.RecordBatch:
        edited = [edit(x[2], y) for x, y in zip(left, right_texts)]
        own = np.array([x[3] for x in left], np.uint64)
        changed = simhash(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([x[1] for x in left], pa.int64()),
                "n_chars": [len(x[2]) for x in left],
                "edited_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in edited],
                "fp": own.view(np.int64),
                "edited_fp": changed.view(np.int64),
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, right_fps),
            }
        )

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            found = simhash(batch.column("text"))
            text, ids, parts, halo = (batch.column(x).to_pylist() for x in ("text", "id", "part", "halo"))
            left, right, fps = [], [], []
            for i in range(len(parts)):
                if pending is not None:
                    same = pending[0] == parts[i]
                    left.append(pending)
                    right.append((text[i] or "") if same else pending[2])
                    fps.append(found[i] if same else pending[3])
                # Of the rows that only follow, the first is enough; none waits for a successor.
                pending = (parts[i], ids[i], text[i] or "", found[i]) if not halo[i] else None
            if left:
                yield rows(left, right, np.array(fps, np.uint64))
    if pending is not None:
        yield rows([pending], [pending[2]], np.array([pending[3]], np.uint64))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next``: every row against the next by integer id.

    An id that is no integer is none. Rows without an id come last, by a hash of the text, which also orders ties; after the last
    row comes the first. A null text is empty; an empty text has fingerprint 0. Repeated rows are all returned, each followed by
    the next copy. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    d = columns(docs, id=id_col, text=text_col)
    id_ = d["id"].try_cast("long")
    d = d.select(id_.alias("id"), "text", row_key(id_, d["text"])[0])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 8 * parts  # several for each partition, so that their hashes share them out evenly
    cuts = lambda x: (F.min(x), F.percentile_approx(x, [i / ranges for i in range(1, ranges)], 10 * ranges))
    ends = d.agg(F.min("id"), F.max("id")).first()
    shift = SHIFT if any(x is not None and abs(x) >= 1 << 52 for x in ends) else 0
    found = d.agg(*cuts(F.shiftright("id", shift)), *cuts(F.when(F.col("id").isNull(), F.shiftright("k1", SHIFT)))).first()
    ids, hashes = (np.array(sorted({least, *(more or [])} - {None}), np.int64) for least, more in (found[:2], found[2:]))
    kind = "id long, text string, k1 long, part int, halo int"
    dealt = d.mapInArrow(deal(ids, hashes, shift), kind).repartition(parts, "part").sortWithinPartitions("part", "halo", F.col("id").isNull(), "id", "k1")
    return dealt.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of radius + 2 blocks, 3 at least, that share the bits out: a pair then fits into 56 bits."""
    n = max(3, radius + 2)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def count_near(radius: int):
    """From rows in order of ``bucket``: for each query how many documents of its bucket are near, if no earlier table has them."""
    cut = [(np.uint64(a), np.uint64((1 << w) - 1)) for a, w in blocks(radius)]
    pairs = list(combinations(range(len(cut)), 2))

    def found(bucket: int, fps: np.ndarray, n: np.ndarray, asked: np.ndarray) -> pa.RecordBatch | None:
        table = bucket >> 56
        own, out = fps[asked], np.zeros(int(asked.sum()), np.int64)
        for i in range(0, len(own), 256):
            differ = own[i : i + 256, None] ^ fps[None, :]
            near = np.bitwise_count(differ) <= radius
            if table:
                same = [((differ >> at) & mask) == 0 for at, mask in cut]
                for x, y in pairs[:table]:
                    near &= ~(same[x] & same[y])
            out[i : i + 256] = near @ n
        some = out > 0
        return pa.RecordBatch.from_arrays([pa.array(own[some].view(np.int64)), pa.array(out[some])], names=["fp", "near"]) if some.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "fp", "n", "asked")]
            if len(cols[0]):
                kept.append(cols)
            if len(kept) and sum(len(k[0]) for k in kept) > 1:
                whole = [np.concatenate(x) for x in zip(*kept)]
                last = int(np.searchsorted(whole[0], whole[0][-1]))  # the last bucket may go on
                yield from split([x[:last] for x in whole])
                kept = [[x[last:] for x in whole]]
        if kept:
            yield from split([np.concatenate(x) for x in zip(*kept)])

    def split(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, fp, n, asked = cols
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.r_[0, cuts].astype(int), np.r_[cuts, len(bucket)].astype(int)
        if len(bucket):
            with_query = np.logical_or.reduceat(asked, starts)
            for i in np.flatnonzero(with_query):
                a, b = starts[i], ends[i]
                batch = found(int(bucket[a]), fp[a:b].view(np.uint64), n[a:b].astype(np.int64), asked[a:b].astype(bool))
                if batch is not None:
                    yield batch

    return run


def within(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, near`` for each distinct ``fp`` (long) of a row that is ``asked``: how many rows are within the radius, itself too."""
    f = fps.groupBy("fp").agg(F.count("*").alias("n"), F.max("asked").alias("asked"))
    cut = blocks(radius)
    keys = []
    for table, (x, y) in enumerate(combinations(range(len(cut)), 2)):
        part = lambda i: F.shiftrightunsigned("fp", cut[i][0]).bitwiseAND(F.lit((1 << cut[i][1]) - 1))  # noqa: B023, E731
        keys.append(F.lit(table << 56).bitwiseOR(F.shiftleft(part(x), cut[y][1])).bitwiseOR(part(y)))
    rows = f.select("fp", "n", "asked", F.explode(F.array(*keys)).alias("bucket"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp", "n", "asked")
    return rows.mapInArrow(count_near(radius), "fp long, near long").groupBy("fp").agg(F.sum("near").alias("near"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides, for each document whose id 20 divides: how many others are within the radius of its fingerprint."""
    from tracelake.llm.near_dedup import as_hex

    out = checkpoint(fingerprint_pairs(read(spark, sf_dir, "documents")))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = checkpoint(within(out.select("fp", asked.alias("asked"))))
    # Only rows that ask are joined; a fingerprint that many of them have is split, as both sides are plain exchanges.
    found = out.where(asked).join(broadcast_if_small(near, near.count()), "fp").withColumn("n_near", F.col("near") - 1).drop("near")
    out = found.unionByName(out.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
