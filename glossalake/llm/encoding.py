"""SentencePiece encoding by streaming Viterbi, and decoding."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: A file of a public tokenizer; it must be on every machine under the same path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Added to the score of the worst piece for each byte that stands for an unknown character.
BYTE_PENALTY = 10.0
#: Segmented stretches that a worker keeps, and the longest of them; beyond, it starts anew. Bounds memory, changes no result.
CACHE, SHORT = 1_000_000, 64
#: A piece's probability falls with its rank r among the vocabulary's stored scores as 1 / (r + SHIFT): Zipf's law with Mandelbrot's shift.
SHIFT = 2.7


class Pieces:
    """A vocabulary with scores. The best segmentation has the largest sum of piece scores; of equals, the longer last piece."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces), default=1)
        self.worst = min((s for _, s in pieces.values()), default=0.0) - BYTE_PENALTY
        self.text = {i: p.replace(SPACE_MARK, " ").encode() for p, (i, _) in pieces.items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        # No piece has a space mark after another character: every path then has a boundary before each run of marks.
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.stretch = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+") if self.cuts else re.compile("(?s).+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}

    def viterbi(self, text: str, window: int | None = None) -> Iterator[int]:
        """Streams the ids of the best segmentation of `text`.

        Keeps the scores and back pointers of the places that a piece has reached so far, at most `longest` ahead, and what
        lies between them and the last committed boundary. Whenever the paths to all these places run through
        one boundary, the ids up to it are final and leave the window. Looked for every `window` characters.
        """
        get, prefixes, longest, n = self.pieces.get, self.prefixes, self.longest, len(text)
        window = window or 4 * longest
        score: dict[int, float] = {0: 0.0}
        back: dict[int, tuple] = {}
        done, check = 0, window
        for start in range(n):
            here = score.pop(start)
            for end in range(start + 1, n + 1):
                part = text[start:end]
                if part not in prefixes:
                    break
                found = get(part)
                if found is not None:
                    total = here + found[1]
                    if end not in score or total > score[end]:
                        score[end], back[end] = total, (start, found[0])
            if text[start] not in self.pieces:
                # An unknown character is spelt in bytes; it competes with pieces that contain it.
                raw = text[start].encode("utf-8", "surrogatepass")
                total = here + self.worst * len(raw)
                if start + 1 not in score or total > score[start + 1]:
                    score[start + 1], back[start + 1] = total, (start, raw)
            if start + 1 >= check and start + 1 < n:
                meet = self._meet(back, done, list(score))
                if meet > done:
                    yield from self._path(back, done, meet)
                    back = {end: via for end, via in back.items() if end > meet}
                    done = meet
                check = start + 1 + window
        yield from self._path(back, done, n)

    @staticmethod
    def _meet(back, done: int, live: list[int]) -> int:
        """The last boundary that the paths to all live places share."""
        heads = set(live)
        while len(heads) > 1:
            top = max(heads)
            if top == done:
                break
            heads.remove(top)
            heads.add(back[top][0])
        return min(heads)

    def _path(self, back, done: int, end: int) -> list[int]:
        out: list[int] = []
        while end > done:
            start, piece = back[end]
            out += [self.byte_ids[b] for b in reversed(piece)] if isinstance(piece, bytes) else [piece]
            end = start
        return out[::-1]

    def encode_into(self, text: str, out: array) -> None:
        """Appends the ids of a text. A space goes before it, spaces become marks, marks in the text itself are spelt in bytes.

        No piece crosses the beginning of a run of marks, so all paths meet there: what lies between two such places is a stretch of its own, and the
        ids of a short one are kept for when it comes again.
        """
        known, stretch = self.known, self.stretch
        mark = [self.byte_ids[b] for b in SPACE_MARK.encode()]
        for i, part in enumerate(text.split(SPACE_MARK)):
            if i:
                out.extend(mark)
            for x in stretch.findall(("" if i else SPACE_MARK) + part.replace(" ", SPACE_MARK)) if part or not i else ():
                ids = known.get(x)
                if ids is None:
                    ids = self.viterbi(x)
                    if len(x) <= SHORT:
                        if len(known) >= CACHE:
                            known.clear()
                        known[x] = ids = tuple(ids)
                out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode_bytes(self, ids) -> bytes:
        text = self.text
        return b"".join([text[i] for i in ids])[1:]  # without the space before the text

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    """Reads the normal pieces and the byte pieces of a SentencePiece model, with log probabilities by the rank of the stored scores.

    The scores that a merge vocabulary stores are ranks, not log probabilities, and can't be summed along a path.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    stored, byte_ids = [], [0] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            stored.append((-sp.get_score(i), i))
    stored.sort()
    total = math.log(sum(1 / (r + SHIFT) for r in range(len(stored))))
    return Pieces({sp.id_to_piece(i): (i, -math.log(r + SHIFT) - total) for r, (_, i) in enumerate(stored)}, byte_ids)


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_pieces, ids, decoded_crc32 (of the UTF-8 text decoded from ids).

    Whole texts; memory is bounded by the Viterbi window and the batch. Null and empty texts have no ids and crc 0. Characters
    without a piece are spelt in byte pieces, so decoding gives back every text exactly. No row depends on
    another, so repeated rows are encoded alike and a lost task is simply run again. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            flat, ends, crc = array("i"), [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    pieces.encode_into(text, flat)
                ends.append(len(flat))
                crc.append(zlib.crc32(pieces.decode_bytes(flat[ends[-2] : ends[-1]])))
                if len(flat) > 1 << 22:  # long texts: smaller batches out
                    yield _batch(batch.column(0), len(crc), flat, ends, crc)
                    batch, flat, ends, crc = batch.slice(len(crc)), array("i"), [0], []
            if crc:
                yield _batch(batch.column(0), len(crc), flat, ends, crc)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces int, ids array<int>, decoded_crc32 long")


def _batch(ids: pa.Array, n: int, flat: array, ends: list[int], crc: list[int]) -> pa.RecordBatch:
    values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    sizes = np.diff(np.array(ends)).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids.slice(0, n), pa.array(sizes), lists, pa.array(crc, pa.int64())], ["doc_id", "n_pieces", "ids", "decoded_crc32"])


def op10_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
