"""LM scoring (2): online logistic context mixing of hashed-context bit predictors, and a smoothed unigram beside it.

``mixer`` has the model of bytes: decisions on Huffman paths, predicted by three contexts, mixed by gated weights, refined,
and adapted within each text. What it is made of is gathered from all texts that are learned from: counts of symbols after three
bytes give the trees; sparse pieces of each task's counts, added up by piece, give the tables of logits; and one fold of
them, which the tables leave out so that nothing is known of it beforehand, teaches the weights of gates and the refinement.

Beyond these bounded tables, which are broadcast (13 MB and the trees), two tables grow with the input and stay distributed:

- counts of words, by hash, for the unigram; only the most frequent ones (at most HEAD) are broadcast, all others are joined;
- counts of segments of text after the three words before them. The model of a segment is a mixture of "as was seen there" and
  of its bytes; how far the first is believed is learned from how often it holds (deleted interpolation: a text that was
  learned from is left out of its own counts) and follows, in a text, what it finds. So passages that were seen before, be it
  in one other text, cost few bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import mixer, textcore
from tracelake.llm.common import broadcast_if_small, checkpoint, columns, read, stored

HEAD = 1 << 19
#: Trees of three bytes at most, the least count of one, and the share of its symbols below which one is escaped.
TREES, LEAST, RARE = 8192, 256, 2048
#: Slots of a piece that is summed and shuffled alone.
PIECE = 1 << 16
#: Levels (log2 of the count) of the contexts of segments that are told apart; the rate of belief within a text.
LEVELS, BELIEF = 6, 0.5
#: Of the rows of the fold that teaches, the share that does; the rest fill the tables.
TAUGHT = 4
#: Words, or symbols, that a task gathers before it adds them up.
MANY = 1 << 22
WORD, GRAM = 0, 1

U64 = np.uint64


class Sums:
    """Sums of two columns by a 64-bit key, of runs that are added; rows of ``kind, key, a, b``."""

    def __init__(self, kind: int):
        self.kind, self.kept, self.held = kind, [], 0

    def add(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.kept.append((key, a, b))
        self.held += len(key)

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.held <= least:
            return
        key, a, b = (np.concatenate(x) for x in zip(*self.kept))
        self.kept, self.held = [], 0
        order = np.argsort(key)
        key, a, b = key[order], a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = [x.astype(np.int64) for x in (key[first], np.add.reduceat(a, first), np.add.reduceat(b, first))]
        for i in range(0, len(first), 100_000):
            part = [pa.array(x[i : i + 100_000]) for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), self.kind, np.int8)), *part], names=["kind", "key", "train", "total"])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts ``kind, key, train, total`` from ``text, held``: of words by hash and, learned from only, of three bytes
    and the symbol after them."""
    words, grams = Sums(WORD), Sums(GRAM)
    for batch in batches:
        held = np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)
        for out in (False, True):
            for _, data, offsets, ended in mixer.runs(batch.column("text").filter(pa.array(held == out))):
                starts, ends, _ = textcore.words(data, offsets)
                key, n = np.unique(textcore.word_hashes(data, starts, ends), return_counts=True)
                words.add(key, n * (not out), n)
                if not out:
                    s = mixer.Stream(data, offsets, ended, False)
                    key, n = np.unique((s.before >> U64(40)).astype(np.uint32) << np.uint32(8) | s.symbol, return_counts=True)
                    grams.add(key, n, n)
                yield from words.flush(MANY)
                yield from grams.flush(MANY)
    yield from words.flush()
    yield from grams.flush()


def pack(counts: np.ndarray) -> bytes:
    """A piece's counts: in a byte each, compressed, and those over 254 in full."""
    flat = counts.ravel()
    small = np.minimum(flat, 255).astype(np.uint8)
    body = zlib.compress(small.tobytes(), 1)
    return np.int64(len(body)).tobytes() + body + flat[small == 255].astype(np.int64).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    flat = np.frombuffer(zlib.decompress(packed[8 : 8 + n]), np.uint8).astype(np.int64)
    flat[flat == 255] = np.frombuffer(packed[8 + n :], np.int64)
    return flat


def table_batches(code):
    """A task's counts of all tables, as rows ``piece, counts``, of which there is none for a piece without counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = mixer.empty()
        mixer.count(code.value, tables, (mixer.Stream(data, offsets, ended, False) for batch in batches for _, data, offsets, ended in mixer.runs(batch.column("text"))))
        first = 0
        for table in tables:
            for i in range(0, len(table), 2 * PIECE):
                own = table[i : i + 2 * PIECE]
                if own.any():
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([first], pa.int32()), "counts": pa.array([pack(own)], pa.binary())})
                first += 1

    return run


def logit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of ``piece``: the 8-bit logits of each piece's sums, one piece in memory at a time."""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"piece": pa.array([now], pa.int32()), "logits": pa.array([mixer.logits(total.reshape(-1, 2)).tobytes()], pa.binary())})

    now, total = None, None
    for batch in batches:
        for piece, packed in zip(batch.column("piece").to_pylist(), batch.column("counts")):
            if piece != now:
                if now is not None:
                    yield done()
                now, total = piece, 0
            total = total + unpack(packed.as_py())
    if now is not None:
        yield done()


def teach_batches(code, tables):
    """What a task learns of the weights: rows ``key, a, b`` to be summed, see ``learned``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = mixer.Teacher()
        for batch in batches:
            for _, data, offsets, ended in mixer.runs(batch.column("text")):
                t.learn(code.value, tables.value, mixer.Stream(data, offsets, ended, False))
        n = np.repeat(t.n, mixer.INPUTS)
        a, b = np.concatenate([t.w.weights.ravel() * n, t.seen[:, :, 0].ravel()]), np.concatenate([n, t.seen[:, :, 1].ravel()])
        some = np.flatnonzero(b + a)
        yield pa.RecordBatch.from_pydict({"key": pa.array(some.astype(np.int32)), "a": a[some], "b": b[some]})

    return run


def learned(rows: list) -> mixer.Weights:
    a, b = (np.zeros(mixer.GATES * (mixer.INPUTS + mixer.BUCKETS)) for _ in range(2))
    for r in rows:
        a[r["key"]], b[r["key"]] = r["a"], r["b"]
    k = mixer.GATES * mixer.INPUTS
    n = b[:k].reshape(mixer.GATES, mixer.INPUTS)[:, 0]
    return mixer.taught(np.where(n[:, None] > 0, a[:k].reshape(mixer.GATES, -1) / np.maximum(n, 1)[:, None], 0) * n[:, None], n, np.stack([a[k:], b[k:]], 1).reshape(mixer.GATES, mixer.BUCKETS, 2))


def lists(rows: list[np.ndarray], values: list[np.ndarray], n: int, kind: type) -> pa.Array:
    """A list for each of ``n`` rows, of values whose rows go up."""
    count = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, kind), *values])))


def score_batches(code, tables, weights: mixer.Weights, words, n_end: int):
    """For each text a number, its tokens, what of the unigram score is known from the head, the other words, its bits by the
    model of bytes, and its segments but the first: the words before, itself, its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, train = words.value
        doc = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            tokens, known, sums, bits = np.ones(n, np.int64), np.full(n, int(n_end > 0)), np.full(n, math.log10(n_end + 1)), np.zeros(n)
            tail: tuple[list, list] = [], []
            segments: tuple[list, list, list, list] = [], [], [], []
            for at, data, offsets, ended in mixer.runs(batch.column("text")):
                s = mixer.Stream(data, offsets, ended)
                cost = mixer.segment_costs(code.value, tables.value, weights, s)
                ids = head.find(s.hashes)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(s.first))
                c = np.where(ids >= 0, train.take(np.maximum(ids, 0)) if len(train) else 0, 0)
                own, k = slice(at, at + len(offsets) - 1), len(offsets) - 1
                tokens[own] += np.diff(s.first)
                known[own] += np.bincount(row, c > 0, k).astype(np.int64)
                sums[own] += np.bincount(row, np.log10(c + 1.0), k)
                bits[own] += np.bincount(s.segment_row, cost, k)
                rest, some = np.flatnonzero(ids < 0), np.flatnonzero(s.segment_known)
                for to, x in zip((*tail, *segments), (at + row[rest], s.hashes[rest].view(np.int64), at + s.segment_row[some], s.segment_context[some].view(np.int64), s.segment_next[some].view(np.int64), cost[some].astype(np.float32))):
                    to.append(x)
            kept = [batch.column("id"), pa.array(np.arange(doc, doc + n)), batch.column("held")]
            doc += n
            yield pa.RecordBatch.from_arrays(
                [*kept, *map(pa.array, (tokens, known, sums, bits)), pc.add(pc.binary_length(batch.column("text")).cast(pa.int64()), 1), lists(*tail, n, np.int64), *(lists(segments[0], x, n, kind) for x, kind in zip(segments[1:], (np.int64, np.int64, np.float32)))],
                names=["id", "doc", "held", "tokens", "known", "sums", "bits", "symbols", "tail", "context", "next", "cost"],
            )

    return run


def level(total):
    return F.least(F.floor(F.log2(total)).cast("int"), F.lit(LEVELS - 1))


def gain(segments: list[tuple], held: bool, rates: list[float]) -> float:
    """Bits that a text saves by segments that were seen before, from its segments in order: ``context, next, cost, n, total``,
    the last how often the context was learned from, with this segment (n) and at all.

    What the text itself holds doesn't count, if it was learned from, but for what came earlier in it.
    """
    own: dict = {}
    for context, following, *_ in segments if not held else ():
        for k in (context, (context, following)):
            own[k] = own.get(k, 0) + 1
    earlier: dict = {}
    saved, shift = 0.0, 0.0
    for context, following, cost, n, total in segments:
        pair = (context, following)
        total += earlier.get(context, 0) - own.get(context, 0)
        n += earlier.get(pair, 0) - own.get(pair, 0)
        for k in (context, pair):
            earlier[k] = earlier.get(k, 0) + 1
        if total <= 0:
            continue
        rate = rates[min(total.bit_length() - 1, LEVELS - 1)]
        belief = 1 / (1 + math.exp(-max(-20.0, min(20.0, math.log(rate / (1 - rate)) + shift))))
        miss = math.log2(1 - belief)
        hit = math.log2(belief * n / total) + cost if n > 0 else -math.inf
        most, least = max(miss, hit), min(miss, hit)
        got = most + math.log2(1 + 2 ** (least - most))
        saved += got
        shift += BELIEF * (2 ** (hit - got) - belief)
    return saved


def gain_batches(rates: list[float]):
    """``doc, gain`` from a row for each text: ``doc, held, segments``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column("segments")
            ends = np.cumsum(segments.value_lengths().to_numpy()).tolist()
            flat = segments.flatten()
            rows = list(zip(*(flat.field(x).to_pylist() for x in ("context", "next", "cost", "n", "total"))))
            found = [gain(rows[lo:hi], held, rates) for lo, hi, held in zip([0, *ends], ends, batch.column("held").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.float64())], names=["doc", "gain"])

    return run


def trees(counts: DataFrame) -> mixer.Code:
    """From ``key, train`` of three bytes and a symbol: the most frequent contexts' trees, at most TREES, and those of bytes."""
    c = counts.select(F.shiftright("key", 8).alias("c"), F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), F.col("train").alias("n"))
    top = c.groupBy("c").agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST).orderBy(F.desc("total"), "c").limit(TREES)
    rows = c.join(F.broadcast(top), "c").where(F.col("n") * RARE >= F.col("total")).select("c", "symbol", "n").toArrow()
    of = rows.column("c").to_numpy()
    contexts, number = np.unique(of, return_inverse=True)
    pairs = np.zeros((256, 256), np.int64)
    for r in c.groupBy(F.shiftright("c", 16).alias("before"), "symbol").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r["before"], r["symbol"]] = r["n"]
    return mixer.Code(contexts, np.stack([number, rows.column("symbol").to_numpy(), rows.column("n").to_numpy()], 1).reshape(-1, 3), pairs)


def train(counts: DataFrame, filling: DataFrame, teaching: DataFrame):
    """Broadcasts of a Code and of tables of 8-bit logits, and Weights: bounded in size by the parameters alone."""
    sc = counts.sparkSession.sparkContext
    code = sc.broadcast(trees(counts))
    # Each task adds its own texts up; pieces of that are added up by piece, a few rows for each task and piece.
    pieces = filling.mapInArrow(table_batches(code), "piece int, counts binary").repartition("piece").sortWithinPartitions("piece")
    tables = [np.zeros(len(x) // 2, np.int8) for x in mixer.empty()]
    first = np.cumsum([0, *(-(-len(t) // PIECE) for t in tables)])
    for r in pieces.mapInArrow(logit_batches, "piece int, logits binary").toLocalIterator():  # the tables, in pieces
        t = int(np.searchsorted(first, r["piece"], "right")) - 1
        i = (r["piece"] - first[t]) * PIECE
        tables[t][i : i + PIECE] = np.frombuffer(r["logits"], np.int8)
    tables = sc.broadcast(tables)
    rows = teaching.mapInArrow(teach_batches(code, tables), "key int, a double, b double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return code, tables, learned(rows.collect())  # a row for each weight


def gains(rows: DataFrame) -> DataFrame:
    """``doc, gain`` of the texts that have segments whose context was learned from.

    Contexts that are there once are of no use to any text, and most are: all other joins are of what is left.
    """
    each = rows.select("doc", "held", F.posexplode(F.arrays_zip("context", "next", "cost")).alias("pos", "x")).select("doc", "held", "pos", "x.*")
    learned_from = F.count_if(~F.col("held"))
    contexts = checkpoint(each.groupBy("context").agg(learned_from.alias("total"), F.count("*").alias("all")).where("total > 0 AND all > 1").select("context", "total"))
    # Shuffled at every size; a context of a third of all rows is split, as both sides are plain exchanges.
    each = checkpoint(each.join(contexts.hint("merge"), "context"))
    pairs = checkpoint(each.groupBy("context", "next").agg(learned_from.alias("n")))
    each = each.join(pairs.hint("merge"), ["context", "next"])
    others = F.when(F.col("held"), 0).otherwise(1)
    taught = each.where(~F.col("held") & (F.col("total") > 1)).groupBy(level(F.col("total") - 1).alias("level")).agg(F.count_if(F.col("n") > others).alias("hits"), F.count("*").alias("n"))
    rates = [0.5] * LEVELS
    for r in taught.collect():  # a row for each level
        rates[r["level"]] = (r["hits"] + 0.5) / (r["n"] + 1)
    texts = each.groupBy("doc", "held").agg(F.array_sort(F.collect_list(F.struct("pos", "context", "next", "cost", "n", "total"))).alias("segments"))
    return texts.mapInArrow(gain_batches(rates), "doc long, gain double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``: every row, scores in log10.

    Rows with crc32(id as text) mod ``folds`` equal to ``held`` are not learned from; one in TAUGHT of the next fold teaches the
    weights, all others fill the tables (with fewer than three folds, all do both). Bits per byte are of the lower-cased text and its
    end. A null text is empty: it has one token, its end, as every text. A null id has the checksum of an empty text. Repeated
    rows are all learned from and all returned, alike. Texts of any length are scored whole: beyond RUN bytes in pieces, each
    from the learned weights. An empty table gives an empty result; other columns are not read.
    """
    d = columns(docs, id=id_col, text=text_col)
    kind = d.schema["id"].dataType.simpleString()
    crc = F.crc32(F.encode(F.coalesce(d["id"].cast("string"), F.lit("")), "UTF-8"))
    d = d.select("id", (crc % folds == held).alias("held"), crc.alias("crc"), F.coalesce("text", F.lit("")).alias("text"))
    sc = d.sparkSession.sparkContext

    counts = d.select("text", "held").mapInArrow(count_batches, "kind tinyint, key long, train long, total long")
    counts = stored(counts.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total")))
    words, grams = (counts.where(F.col("kind") == x).drop("kind") for x in (WORD, GRAM))
    n_end = d.where(~F.col("held")).count()
    known = words.agg(F.sum("train"), F.count_if(F.col("train") > 0)).first()
    n, v = (known[0] or 0) + n_end, known[1] + (n_end > 0)
    # Words by eighths of the power of their count, at most a few hundred rows: where the head has to end.
    power = F.floor(F.log2("total") * 8).cast("int")
    least, room = 1 << 30, HEAD
    for r in sorted(words.groupBy(power.alias("level")).count().collect(), reverse=True):
        if room < r["count"]:
            break
        least, room = r["level"], room - r["count"]
    head = words.where(power >= least).select("key", "train").toArrow()
    head = sc.broadcast((mixer.Lookup(head.column("key").to_numpy().view(U64)), head.column("train").to_numpy()))

    learn = d.where(~F.col("held"))
    teach = (F.col("crc") % folds == (held + 1) % folds) & (F.floor(F.col("crc") / folds) % TAUGHT == 0)
    model = train(grams, *(learn.where(x).select("text") for x in ((~teach, teach) if folds > 2 else (F.lit(True),) * 2)))
    rows = d.drop("crc").mapInArrow(
        score_batches(*model, head, n_end),
        f"id {kind}, doc long, held boolean, tokens long, known long, sums double, bits double, symbols long, tail array<long>, context array<long>, next array<long>, cost array<float>",
    )
    rows = stored(rows)
    tail = rows.select("doc", F.explode("tail").alias("key")).join(words.where((power < least) & (F.col("train") > 0)).select("key", "train").hint("merge"), "key")
    tail = tail.groupBy("doc").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("train") + 1)).alias("rest"))
    out = rows.drop("tail", "context", "next", "cost").join(tail, "doc", "left").join(gains(rows), "doc", "left")
    bits = F.col("bits") - F.coalesce("gain", F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("held").alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("rest", F.lit(0.0)) - F.col("tokens") * math.log10(n + v + 1)).alias("base_score"),
        (-bits * math.log10(2)).alias("score"),
        (bits / F.col("symbols")).alias("bits_per_byte"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
