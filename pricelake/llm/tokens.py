"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A text of up to `chunk` bytes is encoded as it is. A longer one is encoded in chunks of
`chunk` bytes that overlap by `overlap`; from the piece lengths every token end gets
its byte offset. Two neighbouring chunks are spliced at an offset in their overlap where
both have a token end that is proven stable: between two characters that stand side by side
in no piece. Every symbol that merging makes is a piece, so no merge can cross such a place and
both sides are encoded independently. The pairs of all pieces are read when the vocabulary is
loaded. If the overlap has no such place, it is doubled, up to the rest of the text; so
memory depends on the chunk and on the longest stretch without such a place (a run of one
letter, say, whose doubles are pieces), not on the text.

The vocabulary's own space symbol inside a text is encoded as a space is, which is checked
with the vocabulary. A text is encoded at once if that does not hold for a text with the symbol, or
if offsets don't add up (a normalizing vocabulary).

Defined results: null and empty texts have 0 tokens and 0 bytes; special strings are
ordinary text; repeated rows give repeated results; null ids stay null; an empty
table gives an empty result. Other columns are ignored. The vocabulary file is read once
by the driver and sent along with the tasks (its size is checked).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricelake.llm import text as tx

CHUNK_BYTES = 32 << 10
OVERLAP_BYTES = 512
MODEL_BYTES = 64 << 20
SPACE = "▁"


def _pair_codes(text: str) -> np.ndarray:
    """One number for each two neighbouring characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return points[:-1] << 21 | points[1:]


class Encoder:
    """Counts tokens of texts for one vocabulary."""

    def __init__(self, model: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.lengths = np.array([
            1 if self.model.is_byte(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)])
        pairs = {x + y for p in pieces for x, y in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:])}
        self.pairs = _pair_codes("".join(sorted(pairs)))[::2] if pairs else np.zeros(0, np.int64)
        tried = f"a{SPACE}b {SPACE}c{SPACE}{SPACE}d{SPACE}"
        self.same_space = all(
            self.model.encode(t) == self.model.encode(t.replace(SPACE, " ")) for t in (tried, SPACE + tried, " " + tried + " "))
        self.unknown = self.model.unk_id()

    def ends(self, part: bytes) -> np.ndarray | None:
        """Byte offsets of token ends in `part` (the added space ahead is at -1), None if they can't be told."""
        ids = np.asarray(self.model.encode(part.decode()), np.int64)
        ends = np.cumsum(self.lengths[ids]) - 1
        if (ids == self.unknown).any() or not len(ids) or ends[-1] != len(part):
            return None
        return ends

    def stable(self, part: bytes, ends: np.ndarray, low: int, high: int) -> np.ndarray:
        """Proven token ends of `part` in [low, high)."""
        ends = ends[(ends >= max(low, 1)) & (ends < high)]
        if not len(ends):
            return ends
        # The text around the candidates, from a whole character on.
        first = int(ends[0]) - 1
        while first and part[first] & 0xC0 == 0x80:
            first -= 1
        around = part[first:]
        data = np.frombuffer(around, np.uint8)
        begins = np.flatnonzero((data & 0xC0) != 0x80) + first
        free = begins[1:][~np.isin(_pair_codes(around.decode()), self.pairs)]
        return np.intersect1d(ends, free)

    def count_long(self, data: bytes) -> int:
        whole = lambda: len(self.model.encode(data.decode()))
        if SPACE.encode() in data:
            if not self.same_space:
                return whole()
            data = data.replace(SPACE.encode(), b" ")

        def cut(at: int) -> int:  # never inside a character
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(data))

        total, start, entry = 0, 0, None  # `entry`: the splice that ended the chunk before
        while True:
            after, overlap = cut(start + self.chunk), self.overlap
            while True:
                stop = cut(after + overlap)
                part = data[start:stop]
                ends = self.ends(part)
                if ends is None:
                    return whole()
                if stop == len(data):
                    splice = stop
                    break
                ahead = data[after:stop]
                theirs = self.ends(ahead)
                if theirs is None:
                    return whole()
                common = np.intersect1d(
                    self.stable(part, ends, after - start, len(part)) + start,
                    self.stable(ahead, theirs, 0, len(ahead)) + after)
                if len(common):
                    splice = int(common[0])
                    break
                overlap *= 2
            here = ends + start
            total += int((here <= splice).sum() - (0 if entry is None else (here <= entry).sum()))
            if splice == len(data):
                return total
            start, entry = after, splice

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if len(t) <= self.chunk // 4 or len(t.encode()) <= self.chunk:
                short.append(i)
            else:
                out[i] = self.count_long(t.encode())
        for i, ids in zip(short, self.model.encode([texts[i] for i in short])):
            out[i] = len(ids)
        return out


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return model


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    model = read_model(model_path)

    def count(batches):
        encoder = Encoder(model, chunk, overlap)
        for block in tx.blocks(batches, text_col, 1 << 20):
            rows = block.last - block.first
            values = block.batch.column(1).slice(block.first, rows).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(0).slice(block.first, rows), pa.array(np.diff(block.ends)),
                 pa.array(encoder.count([v or "" for v in values]), pa.int64())],
                [id_col, "n_bytes", "n_tokens"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
