"""BPE encoding and decoding by a prefix-sharing trie traversal (operator 3).

The encoding of a string is fixed by the last token of each of its prefixes: the last token t of a prefix is the one that is
a suffix of it and that joins cleanly to the last token of what is before t. Distinct words go into a trie, here their
sorted list, in which a word's neighbour shares its longest prefix: a depth-first walk keeps the states of the current path,
so those of a shared prefix are computed once.

Defined results
    * null and empty texts give no ids and an empty decoded text; special tokens' strings in a text give their ids
    * repeated rows give repeated results and a null doc_id stays null; further columns are ignored; an empty table gives an empty
      result
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import byte_alphabet, texts_by_slice, tokenizer_path, word_bpe

WORD_END = "</w>"


class TrieBpe:
    """Ids of words over a vocabulary with merges in rank order and a mark at word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        back = {c: b for b, c in byte_alphabet().items()}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            end = token.endswith(WORD_END)
            (self.final if end else self.inner)[bytes(back[c] for c in token[: -len(WORD_END) if end else None])] = i
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for a, b in model["merges"]:
            i, pair = vocab[a + b], (vocab[a], vocab[b])
            if self.parts and i <= max(pair[0], pair[1], self.newest):
                raise ValueError("the ids of merges must rise with their ranks")
            self.newest = i
            self.pairs[pair], self.parts[i] = i, pair
        self.size = {i: len(b) for d in (self.inner, self.final) for b, i in d.items()}
        self.longest = max(self.size.values())
        self.clean: dict[int, bool] = {}

    newest = -1

    def joins(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes together gives just these two tokens: undo the later merge again and
        again, and see that no merge over the border would have come before the one just undone."""
        key = left << 32 | right
        if (known := self.clean.get(key)) is not None:
            return known
        limit, good = 1 << 31, True
        while True:
            over = self.pairs.get((left, right))
            if over is not None and over < limit:
                good = False
                break
            later = max(left, right)
            if later not in self.parts:
                break
            if left > right:
                limit, left = left, self.parts[left][1]
            else:
                limit, right = right + 1, self.parts[right][0]
        if len(self.clean) > 1_000_000:
            self.clean.clear()
        self.clean[key] = good
        return good

    def _last(self, word: bytes, end: int, tokens: dict[bytes, int], states: list[int]) -> int:
        joins = self.joins
        for n in range(min(end, self.longest), 0, -1):
            t = tokens.get(word[end - n : end])
            if t is not None and (n == end or joins(states[end - n], t)):
                return t
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; words are distinct and sorted."""
        out, states, before = [], [-1], b""
        size, inner, final = self.size, self.inner, self.final
        for word in words:
            n, shared = len(word), 0
            most = min(n - 1, len(before) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, n):
                states.append(self._last(word, end, inner, states))
            t = self._last(word, n, final, states)
            ids, at = [t], n - size[t]
            while at > 0:
                ids.append(t := states[at])
                at -= size[t]
            out.append(ids[::-1])
            before = word
        return out


def trie_words(path: str) -> Callable[[list[bytes]], list]:
    return TrieBpe(path).encode


def decode_table(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    table = [b""] * (max(names.values()) + 1)
    for token, i in names.items():
        table[i] = token.encode("utf-8")
    return table


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = word_bpe(path, "trie"), decode_table(path)
        for batch in texts_by_slice(batches):
            ids, at = encoder.encode(batch.column("text"))
            small, named = ids.astype("<u4", copy=False), ids.tolist()
            bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(small[a:b]).hexdigest() for a, b in bounds], pa.string()),
                    pa.array([hashlib.sha256(b" ".join([names[x] for x in named[a:b]])).hexdigest() for a, b in bounds], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, engine: str = "trie") -> DataFrame:
    """doc_id and the ids themselves."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(path, engine)
        for batch in texts_by_slice(batches):
            ids, at = encoder.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that the vocabulary gives for ids: tokens' names with a space between, as it has no decoder."""
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = decode_table(path)
        for batch in batches:
            texts = [None if ids is None else b" ".join(names[i] for i in ids).decode("utf-8") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
