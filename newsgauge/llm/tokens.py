"""Encoding with the public tokenizer files, a word at a time with a bounded memory of words."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")

# How the two tokenizers split texts into words before they merge.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def tokenizer_file(name: str) -> str:
    """A path as it is, or the place of one of the installed public tokenizer files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Memory(dict):
    """Encoded words. A full memory starts anew, so its size is bounded; so is that of a word it holds."""

    def __init__(self, encode, entries: int, longest: int = 48):
        self.encode, self.entries, self.longest = encode, entries, longest

    def __missing__(self, word: str) -> bytes:
        out = self.encode(word)
        if len(word) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[word] = out
        return out


class TextEncoder:
    """Ids of whole texts, as little-endian integers of ``width`` bytes.

    Both tokenizers split a text into words before they merge within words, so a text may be cut where
    they always split and each part be encoded once: before a space that a character other than white
    space follows (byte-level), or at white space, which is dropped (word-level). The ids are those of
    the text encoded in one piece. A text with the string of a special token goes to the library whole, which gives
    that token's id.

    Words that are not remembered are merged by tiktoken with the vocabulary of the file, several times
    as fast as by the file's own library, if they are in Latin script. That library marks the end of a word in the word-level
    vocabulary; here a space does, which no word holds.
    """

    def __init__(self, name: str, entries: int = 600_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.drops_spaces = self.tokenizer.normalizer is not None
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = tuple(special)
        byte_of = _byte_of_char()
        ranks = {}
        for token, i in self.tokenizer.get_vocab().items():
            if token not in special:
                end = b" " if self.drops_spaces and token.endswith(WORD_END) else b""
                ranks[bytes(byte_of[c] for c in token.removesuffix(WORD_END if end else "")) + end] = i
        self._merge = tiktoken.Encoding(
            name, pat_str="[^ ]+ " if self.drops_spaces else BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self._parts = regex.compile(WORD_SPLIT).findall
        self.words = _Memory(self._word if self.drops_spaces else self._spaced, entries)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _bytewise(self, text: str) -> bytes:
        return np.array(self._merge(text), self.dtype).tobytes() if _plain(text) else self._library(text)

    def _spaced(self, word: str) -> bytes:
        return self._bytewise(" " + word)

    def _word(self, word: str) -> bytes:
        if not _plain(word):
            return self._library(word)
        parts = self._parts(unicodedata.normalize("NFC", word).lower())
        return np.array(self._merge(" ".join(parts) + " ") if parts else [], self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._library(text)
        if not self.drops_spaces:
            first, *rest = _SPLIT(text)
            return self._bytewise(first) + b"".join(map(self.words.__getitem__, rest))
        if any(c in text for c in CONTROLS):  # white space for str.split, but not for the tokenizer
            return self._library(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def many(self, texts: list[str], end: int) -> tuple[np.ndarray, pa.Buffer]:
        """The ids of several texts, each followed by ``end``: where each text begins and ends, in bytes, and the ids.

        For the byte-level tokenizer. Words are told apart by Arrow, so each is looked up once for all texts.
        """
        whole = [_UNEVEN(t) is not None or any(s in t for s in self.special) for t in texts]
        parts = pc.split_pattern(pa.array(["" if w else t for w, t in zip(whole, texts)], pa.string()), " ")
        cuts = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.dictionary_encode()
        other = pc.match_substring_regex(words.dictionary, _OTHER_LETTERS)
        place = np.empty(len(words.dictionary), np.int64)
        plain = other.to_numpy(zero_copy_only=False) == 0
        place[plain], place[~plain] = np.arange(plain.sum()), plain.sum() + np.arange((~plain).sum())
        # the first word of a text has no space before it; an uneven text is its own first word
        heads = [self(t) if w else self._bytewise(t.partition(" ")[0]) for w, t in zip(whole, texts)]
        single = [*map(self.words.__getitem__, words.dictionary.filter(other).to_pylist()), *heads, np.array([end], self.dtype).tobytes()]
        known = pa.concat_arrays([self._spaced_words(words.dictionary.filter(pc.invert(other))), pa.array(single, pa.large_binary())])
        at = place[words.indices.to_numpy()]
        at[cuts[:-1]] = len(known) - 1 - len(texts) + np.arange(len(texts))
        at = np.insert(at, cuts[1:], len(known) - 1)
        ids = known.take(pa.array(at))
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        return bounds[np.append(0, cuts[1:] + np.arange(1, len(texts) + 1))], ids.buffers()[2]

    def _spaced_words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of Latin words, each with a space before it: merged in one go, and parted by the bytes of their tokens."""
        if not len(words):
            return pa.array([], pa.large_binary())
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self._merge(" " + text), self.dtype)
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        tokens = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
        bounds = np.append(0, tokens) * self.width
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.tobytes())])


def _plain(text: str) -> bool:
    """Latin letters and signs, on whose classes all editions of Unicode agree."""
    return text.isascii() or max(text) < "\u0250"


_OTHER_LETTERS = r"[^\x{0}-\x{24f}]"  # what _plain rejects
_SPLIT = re.compile(r" (?=\S)").split
_UNEVEN = re.compile(r" (?:\s|\Z)").search  # a space that does not begin a word


@cache
def text_encoder(name: str) -> TextEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return TextEncoder(name)
