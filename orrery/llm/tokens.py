"""Whole texts to token ids, a batch at a time.

Texts are cut at places where no token can cross (before a single space, or at white space), the pieces are looked up in a
table of pieces met before, and only unknown pieces reach an encoder. The table is bounded and emptied when full.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .spans import HashTable, byte_hashes, same_spans, spread, text_bytes, white, word_spans

#: Bytes that stand for themselves in the byte-level alphabet; the others follow from U+0100.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    rest = [b for b in range(256) if b not in _PLAIN]
    return {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTable:
    """Ids of pieces of text, found by hash and confirmed by their bytes."""

    def __init__(self, bits: int = 21, most_bytes: int = 1 << 26):
        self.table, self.most_bytes = HashTable(bits), most_bytes
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.held = np.zeros(1 << 16, np.uint8), 0
        #: where each piece's ids and bytes begin, and how many there are
        self.start, self.length, self.at, self.size = (np.zeros(1 << 14, np.int64) for _ in range(4))
        self.n = 0

    def _room(self, n: int, ids: int, size: int) -> None:
        while self.n + n > len(self.start):
            self.start, self.length, self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.at, self.size))
        while self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.held + size > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])

    def _append(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[bytes]], list]) -> np.ndarray:
        """Encode pieces and keep them; their numbers."""
        flat = raw.tobytes()
        got = encode([flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        lengths, size = np.fromiter(map(len, got), np.int64, len(got)), ends - starts
        ids, total, n = int(lengths.sum()), int(size.sum()), len(got)
        self._room(n, ids, total)
        self.ids[self.used : self.used + ids] = np.fromiter((x for own in got for x in own), np.uint32, ids)
        self.raw[self.held : self.held + total] = raw[spread(starts, size)]
        own = np.arange(self.n, self.n + n)
        self.start[own], self.length[own] = self.used + np.cumsum(lengths) - lengths, lengths
        self.at[own], self.size[own] = self.held + np.cumsum(size) - size, size
        self.n, self.used, self.held = self.n + n, self.used + ids, self.held + total
        return own

    def _find(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where its bytes are not held under its hash."""
        at = self.table.find(hashes)
        hit = np.flatnonzero(at >= 0)
        there = at[hit]
        good = self.size[there] == size[hit]
        good[good] = same_spans(self.raw[: self.held], self.at[there[good]], raw, starts[hit[good]], size[hit[good]])
        at[hit[~good]] = -1
        return at

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[bytes]], list]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces and the number of ids of each."""
        hashes, size = byte_hashes(raw, starts, ends), ends - starts
        at = self._find(hashes, raw, starts, size)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, first = np.unique(hashes[miss], return_index=True)
            if self.table.full(len(new)) or self.n > len(self.table.keys) or self.held > self.most_bytes:
                self.clear()
                miss = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
                while self.table.full(len(new)):
                    self.table = HashTable(self.table.bits + 1)
            free = self.table.find(new) < 0
            where = miss[first[free]]
            self.table.add(new[free], self._append(raw, starts[where], ends[where], encode).astype(np.int32))
            at[miss] = self._find(hashes[miss], raw, starts[miss], size[miss])
            other = np.flatnonzero(at < 0)  # a hash that other bytes hold: a number of its own, for this batch
            if len(other):
                at[other] = self._append(raw, starts[other], ends[other], encode)
        lengths = self.length[at]
        return self.ids[spread(self.start[at], lengths)], lengths


def per_text(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where each text's ids begin, from the ids of each piece and each text's first piece."""
    sums = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=sums[1:])
    return sums[first]


class ByteBpe:
    """Byte-level BPE of public rank files: the ids of the library's byte_bpe_50k.json."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.engine = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.table = PieceTable()

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.engine.encode(p.decode("utf-8"), allowed_special=self.special) for p in pieces]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's begin. A piece begins before a space that a visible character follows."""
        raw, at = text_bytes(column)
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        head = np.zeros(n + 1, bool)
        head[at] = True
        cut = raw == 32
        follows = np.zeros(n, bool)
        # C2, E1, E2 and E3 may begin other white space: no cut there, which only makes a piece longer
        follows[:-1] = ~white(raw[1:]) & ~np.isin(raw[1:], (0xC2, 0xE1, 0xE2, 0xE3)) & ~head[1:n]
        cut &= follows
        cut |= head[:n]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        ids, lengths = self.table.encode(raw, starts, ends, self._encode)
        return ids, per_text(lengths, np.searchsorted(starts, at))


class WordBpe:
    """Lower-case BPE with word ends (word_bpe_49k.json). words: encodes distinct words, given as UTF-8 bytes; about most_words of
    them are kept, as pieces met before need none."""

    def __init__(self, path: str, words: Callable[[list[bytes]], list], most_words: int = 100_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # fixed values: the vocabulary's own split pattern, with its white space written out
        space = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.split_words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{space}\p{{L}}\p{{N}}]+")
        self.words, self.known, self.most_words = words, {}, most_words
        self.table = PieceTable()

    def _split(self, piece: bytes) -> list[bytes | int]:
        text, out = piece.decode("utf-8"), []
        for i, part in enumerate(self.split_special.split(text) if b"<|" in piece else [text]):
            if i % 2:
                out.append(self.special[part])
            else:  # one letter at a time: no special form of a final sigma
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [w.encode("utf-8") for w in self.split_words.findall(low)]
        return out

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        split = [self._split(p) for p in pieces]
        new = {w for ws in split for w in ws if isinstance(w, bytes)} - self.known.keys()
        if len(self.known) + len(new) > self.most_words:
            self.known = {}
            new = {w for ws in split for w in ws if isinstance(w, bytes)}
        new = sorted(new)
        self.known.update(zip(new, self.words(new), strict=True))
        known = self.known
        return [[x for w in ws for x in (known[w] if isinstance(w, bytes) else (w,))] for ws in split]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's begin."""
        raw, at = text_bytes(column)
        starts, ends, first = word_spans(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ids, lengths = self.table.encode(raw, starts, ends, self._encode)
        return ids, per_text(lengths, first)


def library_words(path: str) -> Callable[[list[bytes]], list]:
    """Words by the tokenizers library's own model."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    shown = {b: c for b, c in byte_alphabet().items()}

    def encode(words: list[bytes]) -> list:
        return [[t.id for t in model.tokenize(w.decode("latin-1").translate(shown))] for w in words]

    return encode


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """One encoder for each Python worker, kept between tasks."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(path: str | None = None) -> ByteBpe:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return held(("byte", path), lambda: ByteBpe(path, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}))


def word_bpe(path: str, engine: str) -> WordBpe:
    """engine: 'trie' (the prefix-sharing traversal) or 'library'."""
    from .bpe_trie import trie_words

    return held(("word", path, engine), lambda: WordBpe(path, (trie_words if engine == "trie" else library_words)(path)))


def texts_by_slice(batches_: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    from .common import trim
    from .spans import batches

    for batch in batches_:
        yield from batches(batch, "text", limit)
        del batch
        trim()
