"""Token counts (12): the exact number of tokens of every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding a sequence of pieces is the encoding of its text exactly if each two neighbours are the encoding of
theirs: the first merge to cross a border between pieces would also cross it in those two alone. So a prefix's encoding
ends in the one piece that goes with the end of the encoding of what is before it, and its count is one more than there.
One pass thus gives the counts of all prefixes, and where a text must be cut for a budget, without encoding anything twice.

Where two characters stand side by side in no piece, no merge passes between them: a text falls into units there, whose
counts add up. Units repeat a lot, so each task keeps the counts of short ones. What is stored of a text is one signed
byte for each code point: by how much the count changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracelake.llm.common import columns, read

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: A task keeps counts of units of so many bytes at most, and so many units and pairs of pieces; others are worked out again.
UNIT, KEPT = 64, 400_000
#: Bytes of a text that are worked on at a time.
CHUNK = 1 << 20
#: The library writes a space as this character.
SPACE = "▁"
#: A model that the library would treat otherwise (by normalising, trimming or whole words) is told by these.
PROBE = "  A ﬁne  Ｔest\n\n\tof words, 12345 <s> </s> ▁x é é \U0001f600   "


class Units(dict):
    """Changes of the count by code point of a unit (one signed byte each), by the unit's UTF-8 bytes; spaces for SPACE."""

    def __init__(self, score: dict[str, float]):
        super().__init__()
        self.score = score
        #: Texts have numbers (0 is nothing), so that pairs of them are single numbers.
        self.numbers: dict[str, int] = {"": 0}
        self.names = [""]
        self.fits: dict[int, bool] = {}
        #: What a text may end in to go on with a piece, and by that and the next character: the same, and the pieces that end there.
        self.begun = {x[:i] for x in score for i in range(1, len(x) + 1)}
        self.moves: dict[int, tuple[int, list[tuple[int, int, int]]]] = {}
        #: Whether two bytes (the first one the higher half) stand side by side in no piece; bytes within a character always may.
        apart = np.ones((256, 256), bool)
        apart[:, 0x80:0xC0] = False
        for piece in score:
            raw = np.frombuffer(piece.encode(), np.uint8)
            apart[raw[:-1], raw[1:]] = False
        self.apart = apart.ravel()

    def encoded(self, text: str) -> list[str]:
        """The pieces of a short text, by merging: the best score first, leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            found = [(-score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in score]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def number(self, text: str) -> int:
        if text not in self.numbers:
            self.numbers[text] = len(self.names)
            self.names.append(text)
        return self.numbers[text]

    def follows(self, pair: int) -> bool:
        """Whether the second of two texts is a piece that goes with the first (nothing at the start) as the piece in front of it."""
        before, piece = self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]
        if len(self.fits) >= KEPT:
            self.fits.clear()
        self.fits[pair] = out = self.encoded(before + piece) == ([before, piece] if before else [piece])
        return out

    def move(self, begun: int, char: str) -> tuple[int, list[tuple[int, int, int]]]:
        """After ``char``: the longest end of the text that begins a piece; all pieces that end there, longest first, with length and tokens."""
        text = self.names[begun] + char
        while text and text not in self.begun:
            text = text[1:]
        pieces = [(self.number(x), len(x), 1) for i in range(len(text)) if (x := text[i:]) in self.score]
        if char not in self.score:
            pieces.append((self.number(char), 1, len(char.encode())))  # an unknown character is as many tokens as it has bytes
        if len(self.moves) >= KEPT:
            self.moves.clear()
        self.moves[begun << 32 | ord(char)] = out = self.number(text), pieces
        return out

    def changes(self, unit: str) -> bytes:
        moves, fits, last, counts, begun, before = self.moves, self.fits, [0], [0], 0, 0
        out = bytearray()
        for i, char in enumerate(map(ord, unit), 1):
            key = begun << 32 | char
            begun, pieces = moves[key] if key in moves else self.move(begun, chr(char))
            for piece, n, tokens in pieces:
                pair = last[i - n] << 32 | piece
                if fits[pair] if pair in fits else self.follows(pair):
                    break
            last.append(piece)
            counts.append(now := counts[i - n] + tokens)
            out.append((now - before) & 255)
            before = now
        return bytes(out)

    def __missing__(self, unit: bytes) -> bytes:
        out = self.changes(unit.decode())
        if len(unit) <= UNIT:
            if len(self) >= KEPT:
                self.clear()
            self[unit] = out
        return out

    def of(self, data: bytes) -> np.ndarray:
        """The changes of the count at each code point of a text."""
        if not data:
            return np.zeros(0, np.int8)
        data = b" " + data.replace(SPACE.encode(), b" ")
        out, rest = [], b""
        for lo in range(0, len(data), CHUNK):
            block = rest + data[lo : lo + CHUNK]
            raw = np.frombuffer(block, np.uint8)
            cuts = [0, *(np.flatnonzero(self.apart[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]) + 1).tolist()]
            if lo + CHUNK < len(data):
                rest = block[cuts[-1] :]  # goes on in the next block
            else:
                cuts.append(len(block))
            out.append(b"".join([self[block[a:b]] for a, b in zip(cuts, cuts[1:])]))
        found = np.frombuffer(b"".join(out), np.int8).copy()
        found[1] += found[0]  # the library's own leading space is no code point of the text
        return found[1:]


@lru_cache(maxsize=2)
def units(model_file: str | None) -> Units:
    """The units of a model (of ``public_tokenizers`` if none is named), kept for the life of the Python worker."""
    import sentencepiece

    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = Units({model.id_to_piece(i).replace(SPACE, " "): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))})
    if len(model.encode(PROBE)) != int(out.of(PROBE.encode()).sum()):
        raise ValueError(f"{model_file}: only models of byte-pair encoding with byte fallback, a leading space and no normalising are supported")
    return out


def within(changes: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens. The counts may fall as a prefix grows, so all are looked at."""
    fit = count = 0
    for lo in range(0, len(changes), CHUNK):
        counts = count + np.cumsum(changes[lo : lo + CHUNK], dtype=np.int64)
        fitting = np.flatnonzero(counts <= limit)
        fit = lo + int(fitting[-1]) + 1 if len(fitting) else fit
        count = int(counts[-1])
    return fit


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """``doc_id, changes``: for each row by how much each code point changes the count of tokens, as signed bytes.

    ``count_at`` and ``longest_within`` answer questions from it. A null or empty text has no code points. Rows are worked
    on one by one: repeated ones come out alike, null ids stay null. An empty table gives an empty result; other columns
    are not read. A text of any length takes about eight bytes of memory a byte (measured with 50 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = units(model_file).of
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([of(x).tobytes() for x in _texts(batch.column("text"))], pa.binary())], ["doc_id", "changes"])

    d = columns(docs, id=id_col, text=text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['id'].dataType.simpleString()}, changes binary")


@F.pandas_udf(LongType())
def count_at(changes: pd.Series, n_chars: pd.Series) -> pd.Series:
    """Tokens of the first ``n_chars`` code points (all, if there are fewer), from stored changes."""
    return pd.Series([int(np.frombuffer(x, np.int8)[: max(0, int(n))].sum(dtype=np.int64)) for x, n in zip(changes, n_chars)], dtype="int64")


def longest_within(changes: Column | str, limit: int) -> Column:
    """Code points of the longest prefix of at most ``limit`` tokens, from stored changes."""

    @F.pandas_udf(LongType())
    def found(column: pd.Series) -> pd.Series:
        return column.map(lambda x: within(np.frombuffer(x, np.int8), limit)).astype("int64")

    return found(changes)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, model_file: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, chars_within``: the last of each text's prefix counts, and where ``limit`` cuts it.

    The changes are those of ``prefix_counts``, used where they are made and not stored. Cases as there: a null or empty
    text has no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = units(model_file).of
        for batch in batches:
            size, tokens, fit = [], [], []
            for x in _texts(batch.column("text")):
                changes = of(x)
                size.append(len(x))
                tokens.append(int(changes.sum(dtype=np.int64)))
                fit.append(within(changes, limit))
            over = [x > limit for x in tokens]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"])

    d = columns(docs, id=id_col, text=text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all texts. SQL can't encode; tests hold the counts of texts and of prefixes against the library's."""
    return token_counts(read(spark, sf_dir, "documents"))
