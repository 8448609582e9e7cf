"""SentencePiece encoding and decoding by a streaming lattice of backpointers.

The lattice keeps, for every position of a window no longer than the longest piece, the last piece of
the best segmentation of the text up to there. Ids are committed as soon as the backpointer paths from
all positions of the window meet in one boundary. Two rules fill the lattice:

* unigram models: the piece that ends the path with the greatest sum of scores (Viterbi), ties to the
  earlier boundary, that is the longer last piece;
* BPE models: the only piece whose pairing with the last piece before it survives the model's own merges.
  Greatest score sums give other ids than the merges of a BPE model, and the model at hand is one, so the
  Viterbi maximum alone would give wrong ids; the window, the backpointers and the commits are the same.

A space always starts a piece in such models, so every path meets at it; documents are therefore cut at
spaces and each distinct cut of a worker's memory goes through the lattice once. A cut that ends inside one
window has nothing to commit before its end; its pieces are found by one automaton of all pieces.

Which rule holds is read from the model file; models that normalise texts, drop spaces, or have pieces set by
the user are refused.

Edge cases: a null or empty text has no ids and decodes to an empty text; characters without a piece
become byte pieces; a null doc_id is kept; repeated rows give repeated results; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import bound_batches, slices, text_array, trimmed

SPACE = "▁"
#: Cuts whose ids a worker keeps, and the longest of them; about 150 bytes each.
KEEP = 400_000
LONGEST_KEPT = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class UnsupportedModel(ValueError):
    """A model that asks for something that the lattice does not do."""


def merges_of(path: str) -> bool:
    """Whether the model in the file is a BPE model (True) or a unigram model (False); others and unsupported settings raise UnsupportedModel."""
    with open(path, "rb") as f:
        message = list(proto_fields(f.read()))
    trainer = dict(proto_fields(b"".join(v for k, v in message if k == 2)))
    normaliser = dict(proto_fields(b"".join(v for k, v in message if k == 3)))
    kinds = {dict(proto_fields(v)).get(3, 1) for k, v in message if k == 1}
    # fixed values of the file format: model types 1 unigram, 2 BPE; piece type 4 is set by the user
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise UnsupportedModel(f"model type {kind}")
    if 4 in kinds or trainer.get(24, 0):
        raise UnsupportedModel("pieces set by the user, or spaces at the end of pieces")
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise UnsupportedModel("a normaliser that changes texts")
    return kind == 2


class Pieces:
    """Pieces of a model: ids and scores of ordinary pieces, byte pieces, and whether merges (BPE) or sums (unigram) decide."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int] | None, merges: bool, unknown: int = 0):
        self.scores, self.byte_ids, self.merges, self.unknown = scores, byte_ids, merges, unknown
        self.longest = max(map(len, scores), default=1)
        self.low = min((s for _, s in scores.values()), default=0.0) - 10.0
        self.valid: dict[tuple[str, str], bool] = {}
        self.pairs = {piece[i : i + 2] for piece in scores for i in range(len(piece) - 1)}
        self.found = ahocorasick.Automaton()  # all pieces by their last characters
        for piece in scores:
            self.found.add_word(piece, piece)
        self.found.make_automaton()

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece as sp

        model = sp.SentencePieceProcessor(model_file=path)
        scores, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[piece] = (i, model.get_score(i))
        return cls(scores, byte_ids, merges=merges_of(path), unknown=model.unk_id())

    def merged(self, text: str) -> list[str]:
        """The pieces that the model's merges leave of a short text: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_holds(self, a: str, b: str) -> bool:
        """Whether the merges of a + b end in exactly a and b."""
        key = (a, b)
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            known = self.valid[key] = self.merged(a + b) == [a, b]
        return known

    def _alone(self, a: str) -> bool:
        key = ("", a)
        known = self.valid.get(key)
        if known is None:
            known = self.valid[key] = self.merged(a) == [a]
        return known

    def ids(self, piece: str) -> list[int]:
        found = self.scores.get(piece)
        if found:
            return [found[0]]
        if self.byte_ids is None:
            return [self.unknown]
        return [self.byte_ids[b] for b in piece.encode()]


class Lattice:
    """Streaming segmentation: feed() characters, take committed pieces; close() commits the rest. `peak` is the widest window held."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.reset()

    def reset(self) -> None:
        self.text, self.base, self.peak = "", 0, 0
        self.last: list[str] = [""]  # last piece of the segmentation that ends at base + i
        self.score: list[float] = [0.0]
        self.before = ""  # the piece committed before base

    def _step(self) -> None:
        """Fills the lattice at the next position of the window."""
        p, at = self.p, len(self.last)
        text, last = self.text, self.last
        get = p.scores.get
        if p.merges:
            for size in range(min(at, p.longest), 0, -1):
                piece = text[at - size : at]
                if size > 1 and get(piece) is None:
                    continue
                start = at - size
                ahead = last[start] if start else self.before
                if (p.pair_holds(ahead, piece) if ahead else p._alone(piece)):
                    last.append(piece)
                    return
            raise AssertionError("merges always leave some last piece")
        best, chosen = -np.inf, text[at - 1]
        for size in range(min(at, p.longest), 0, -1):
            piece = text[at - size : at]
            found = get(piece)
            if found is None and size > 1:
                continue
            total = self.score[at - size] + (found[1] if found else p.low)
            if total > best:
                best, chosen = total, piece
        last.append(chosen)
        self.score.append(best)

    def _commit(self) -> list[str]:
        """Pieces before the one boundary in which the paths from all positions that later pieces can reach meet."""
        at = len(self.last) - 1
        paths = set(range(max(0, at - self.p.longest + 1), at + 1))
        while len(paths) > 1:
            far = max(paths)
            paths.discard(far)
            paths.add(far - len(self.last[far]))
        meet = paths.pop()
        return self._take(meet)

    def _take(self, at: int) -> list[str]:
        out, here = [], at
        while here:
            out.append(self.last[here])
            here -= len(self.last[here])
        if out:
            out.reverse()
            self.before = out[-1]
            self.text, self.base = self.text[at:], self.base + at
            self.last = [""] + self.last[at + 1 :]
            if not self.p.merges:
                self.score = [s - self.score[at] for s in self.score[at:]]
        return out

    def feed(self, text: str) -> Iterator[str]:
        for c in text:
            self.text += c
            self._step()
            if len(self.last) > 2 * self.p.longest:
                yield from self._commit()
            self.peak = max(self.peak, len(self.last))

    def close(self) -> list[str]:
        out = self._take(len(self.last) - 1)
        self.reset()
        return out

    def segment(self, text: str) -> list[str]:
        if self.p.merges and len(text) <= 2 * self.p.longest:
            return self._short(text)
        return [*self.feed(text), *self.close()]

    def _short(self, text: str) -> list[str]:
        """The same lattice for a text inside one window, nothing to commit before its end."""
        p = self.p
        valid = p.valid
        last = [""]
        # pieces come by their ends, longest first; the last one left, of one character, always holds
        for end, piece in p.found.iter(text):
            at = len(last)
            if end < at - 1:
                continue
            while at <= end:
                last.append(text[at - 1])
                at += 1
            if len(piece) > 1:
                key = (last[at - len(piece)], piece)
                holds = valid.get(key)
                if holds is None:
                    holds = p.pair_holds(*key) if key[0] else p._alone(piece)
                if not holds:
                    continue
            last.append(piece)
        for at in range(len(last), len(text) + 1):
            last.append(text[at - 1])
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out


class StreamEncoder:
    """Ids of whole texts. Texts are normalised as the model does: spaces become its space sign, one is put in front."""

    def __init__(self, path: str | None = None, pieces: Pieces | None = None):
        self.pieces = pieces or Pieces.load(path or model_path())
        self.lattice = Lattice(self.pieces)
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        self.table = [b" \xe2\x81\x87 "] * (1 + max([0, *(i for i, _ in self.pieces.scores.values()), *(self.pieces.byte_ids or [])]))
        for piece, (i, _) in self.pieces.scores.items():
            self.table[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.pieces.byte_ids or []):
            self.table[i] = bytes([b])

    def word(self, word: str) -> bytes:
        """The ids of a cut without its first space sign, as 32-bit numbers."""
        found = self.known.get(word)
        if found is None:
            found = b"".join([self.part(part) for part in self.parts(SPACE + word)])
            if len(word) <= LONGEST_KEPT:
                if len(self.known) >= KEEP:
                    self.known.clear()
                self.known[word] = found
        return found

    def parts(self, word: str) -> list[str]:
        """A word cut between neighbours that no piece holds: every path meets there."""
        pairs, out, start = self.pieces.pairs, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def part(self, part: str) -> bytes:
        found = self.known_parts.get(part)
        if found is None:
            found = np.array([i for piece in self.lattice.segment(part) for i in self.pieces.ids(piece)], np.int32).tobytes()
            if len(part) <= LONGEST_KEPT:
                if len(self.known_parts) >= KEEP:
                    self.known_parts.clear()
                self.known_parts[part] = found
        return found

    def cuts(self, text: str) -> list[str]:
        """Runs that start with space signs, without their first; no piece has a space sign after another character."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, lead = [], ""
        for part in parts[:-1]:
            if part:
                out.append(lead + part)
                lead = ""
            else:
                lead += SPACE
        if parts[-1]:
            out.append(lead + parts[-1])
        elif len(parts) > 1:
            out.append(lead)
        return out

    def encode_array(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        get, word = self.known.get, self.word
        return np.frombuffer(b"".join([get(cut) or word(cut) for cut in self.cuts(text)]), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (the decoded ids equal the text, its space signs read as spaces). One scan, no shuffle."""
    bound_batches(docs.sparkSession)
    path = path or model_path()
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, most=2 << 20):
            encoder = encoder or StreamEncoder(path)
            texts = text_array(batch.column(1)).to_pylist()
            ids = [encoder.encode_array(t) for t in texts]
            same = [encoder.decode(i.tolist()) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(i) for i in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes), pa.array(same)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids."""
    path = path or model_path()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or StreamEncoder(path)
            texts = [encoder.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), f"doc_id {kind}, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
