"""SentencePiece encoding and decoding: a forward pass over the piece lattice that commits ids early."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm.common import in_slices, query, table, text_of
from newsgauge.llm.tokens import tokenizer_file

PIECES = "piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a space mark that a text holds itself, so that decoding gives it back. No text holds a lone surrogate.
OWN_MARK = "\ud800"


class PieceModel:
    """The pieces of a model file, and which piece ends the encoding of each prefix of a text.

    The file is a merge model: its scores order merges. Its encoding of a text is a path through the
    lattice of pieces in which every two neighbours stand as they are when the two are encoded
    together. Such a path is unique for each prefix, so the pass keeps one backpointer for each
    position, as a Viterbi pass does; instead of comparing sums, it takes the piece that may follow the
    path to its start. Characters without a piece are spelled in byte pieces.
    """

    def __init__(self, name: str = PIECES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        size = model.vocab_size()
        self.ids, self.score, self.raw = {}, {}, []
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.code = {piece: np.array([i], "<u4").tobytes() for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: Lengths of the pieces, by their last two characters, the longest first.
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            lengths.setdefault(piece[-2:], {1}).add(len(piece))
        self.tails = {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items() if len(tail) == 2}
        #: No piece has a space mark behind another character, so paths meet before a mark that begins a word.
        self.words_are_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        #: The parts of a text between places that no piece crosses, each with the spaces before it.
        self.parts = re.compile(self._parts_pattern()).findall

    def _parts_pattern(self) -> str:
        """Characters that stand side by side in a piece are of one group, such as letters or punctuation, and so are the
        neighbours of neighbours. No piece holds characters of two groups, so paths meet between them. Small groups count as one.
        """
        groups: dict[str, set[str]] = {}
        for piece in self.ids:
            chars = piece.lstrip(SPACE)
            for a, b in zip(chars, chars[1:]):
                one, other = groups.setdefault(a, {a}), groups.setdefault(b, {b})
                if one is not other:
                    one, other = sorted((one, other), key=len)
                    other |= one
                    groups.update(dict.fromkeys(one, other))
        large = {id(g): "".join(map(re.escape, sorted(g))) for g in groups.values() if len(g) >= _GROUP}
        runs = "|".join([f"[{chars}]+" for chars in large.values()] + [f"[^ {''.join(large.values())}]+"])
        return f" *(?:{runs})| +"

    def merged(self, text: str) -> list[str]:
        """Encode by its definition: join the best-scored neighbours, the first of equals, until none join."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def path(self, text: str) -> list[str]:
        """The pieces of a text short enough to hold as a whole: the pass of StreamEncoder without commits."""
        known, tails, pairs, follows = self.ids, self.tails, self.pairs, self.may_follow
        last: list[str | None] = [None]
        for end in range(1, len(text) + 1):
            for n in tails.get(text[end - 2:end] if end > 1 else "", _ONE):
                start = end - n
                if start < 0 or (before := last[start]) is None and start:
                    continue
                piece = text[start:end]
                if n > 1 and piece not in known:
                    continue
                if start:
                    fits = pairs.get((before, piece))
                    if not (follows(before, piece) if fits is None else fits):
                        continue
                last.append(piece)
                break
            else:
                last.append(None)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in (SPACE if piece == OWN_MARK else piece).encode()]


_ONE = (1,)
_GROUP = 8  # characters that make a group of its own


class StreamEncoder:
    """Encodes characters as they come; ``feed`` gives the pieces that nothing later can change.

    Held are the characters since the last commit, with the last piece of the best path to each
    position. Only positions within the longest piece of the end can be built upon. When the paths back
    from all of them meet in one position, the pieces before it are committed and its characters go.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""  # not committed
        self.last: list[str | None] = [None]  # by position; [0] is the last committed piece
        self.committed: str | None = None

    def feed(self, chars: str) -> Iterator[str]:
        known, tails, pairs, follows = self.model.ids, self.model.tails, self.model.pairs, self.model.may_follow
        window, end, last = 2 * self.model.longest, len(self.text), self.last
        text = self.text + chars
        while end < len(text):
            end += 1
            for n in tails.get(text[end - 2:end] if end > 1 else "", _ONE):
                start = end - n
                if start < 0:
                    continue
                before = last[start] if start else self.committed
                if before is None and start:
                    continue
                piece = text[start:end]
                if n > 1 and piece not in known:
                    continue
                if before is None or (pairs[before, piece] if (before, piece) in pairs else follows(before, piece)):
                    last.append(piece)
                    break
            else:
                last.append(None)
            if end >= window:
                self.text, rest = text[:end], text[end:]
                yield from self._commit(self._meeting())
                text, end, last = self.text + rest, len(self.text), self.last
        self.text = text

    def _meeting(self) -> int:
        """The last position that the paths to all positions still in reach have in common."""
        end = len(self.text)
        at = {p for p in range(max(0, end - self.model.longest + 1), end + 1) if p == 0 or self.last[p] is not None}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - len(self.last[far]))
        return at.pop()

    def _commit(self, upto: int) -> list[str]:
        out, at = [], upto
        while at:
            out.append(self.last[at])
            at -= len(self.last[at])
        if out:
            self.committed = out[0]
            self.text, self.last = self.text[upto:], [None, *self.last[upto + 1:]]
        return out[::-1]

    def finish(self) -> list[str]:
        return self._commit(len(self.text))


class PieceCodec:
    """Whole texts to ids and back. Encoded words are remembered, up to a bounded number of them."""

    def __init__(self, name: str = PIECES, entries: int = 800_000, word: int = 48):
        self.model = PieceModel(name)
        self.entries, self.word = entries, word
        self.words: dict[str, bytes] = {}

    def _streamed(self, marked: str) -> Iterator[str]:
        stream = StreamEncoder(self.model)
        yield from stream.feed(marked)
        yield from stream.finish()

    def _bytes(self, marked: str) -> bytes:
        code = self.model.code
        pieces = self.model.path(marked) if len(marked) <= 2 * self.model.longest else self._streamed(marked)
        return b"".join([code.get(piece) or np.array(self.model.ids_of(piece), "<u4").tobytes() for piece in pieces])

    def _remembered(self, part: str) -> bytes:
        out = self.words.get(part)
        if out is None:
            out = self._bytes(part.replace(" ", SPACE))
            if len(part) <= self.word:
                if len(self.words) >= self.entries:
                    self.words.clear()
                self.words[part] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; the empty text has none.

        Where no piece crosses the start of a word, all paths meet there, and also between characters that no piece
        joins, so the parts of words are encoded one by one, each once.
        """
        if not text:
            return b""
        text = " " + text.replace(SPACE, OWN_MARK)
        if not self.model.words_are_apart:
            return self._bytes(text.replace(" ", SPACE))
        return b"".join(map(self._remembered, self.model.parts(text)))

    def decode(self, ids: bytes) -> str:
        raw = self.model.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()[1:]


@cache
def codec(name: str = PIECES) -> PieceCodec:
    """One codec for each Python worker, kept from task to task."""
    return PieceCodec(name)


def _kind(df: DataFrame, column: str) -> str:
    return df.select(F.col(column)).schema[0].dataType.simpleString()


def encode_pieces(docs: DataFrame, model: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Piece ids of every whole text: doc_id and ids (little-endian unsigned 32-bit integers).

    The ids are those of the model's own library, but for a text that holds the space mark itself: its
    bytes are spelled, so that decoding gives the text back exactly. A null or empty text has no ids.
    One row per row of ``docs``; nothing is shuffled; other columns are ignored, whatever their names.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = codec(model).encode
        for batch in in_slices(batches):
            ids = [ids_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return given.mapInArrow(encode, f"doc_id {_kind(docs, id_col)}, ids binary")


def decode_pieces(encoded: DataFrame, model: str = PIECES) -> DataFrame:
    """The texts of ``encode_pieces``: doc_id, ids and text."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_from = codec(model).decode
        for batch in in_slices(batches):
            texts = [text_from(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ids")), pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {_kind(encoded, 'doc_id')}, ids binary, text string")


@query("op10_piece_codec")
def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number and crc of its piece ids, and the hash of the text decoded from them."""
    decoded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
                          F.crc32("ids").alias("ids_crc32"), F.char_length("text").cast("long").alias("n_chars"),
                          F.sha2("text", 256).alias("decoded_sha256"))
