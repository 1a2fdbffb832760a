"""Byte-level BPE by a trie of words: each shared prefix is encoded once.

The encoding of a prefix is fixed by its last token and where that begins, as what stands before it is again
the encoding of a prefix.  Distinct words are put in order, which is the depth-first order of their trie; going
from one word to the next keeps the states of the prefix they share and adds a state for each further byte:
the one token that ends there and is compatible with the last token of the prefix before it.  Two tokens are
compatible if no merge across their boundary comes before the merges that make them, which is read off the
right edge of one and the left edge of the other.

Texts are cut into units (see ``units``) and those, by the tokenizer's pattern, into words; a worker remembers
units and words it has encoded.  Decoding joins the tokens' bytes.

Defined cases: a null text is an empty one and has no ids; strings of special tokens inside a text become these
tokens, as in the tokenizers library by default; repeated rows are encoded alike; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loreworks.llm.units import REMEMBERED, UnitTable, text_slices

#: The pattern by which byte-level BPE tells words apart.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieEncoder:
    """Encoder and decoder of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = _byte_of_char()
        self.token = {bytes(byte[c] for c in name): i for name, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.token.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for name, i in self.token.items():
            self.bytes[i] = name
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self.ends = ahocorasick.Automaton()  # finds the tokens that end at each byte of a word
        for name, i in self.token.items():
            self.ends.add_word(name.decode("latin-1"), (i, len(name)))
        self.ends.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank of the merge that makes it
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(byte[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.token[left], self.token[right]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(self.token[left + right], (*pair, rank))
        self.words: dict[str, tuple[int, ...]] = {}  # tuples of numbers cost the garbage collector nothing
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.units = UnitTable(self._encode_units)
        length = np.fromiter(map(len, self.bytes), np.int64, size)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.begin, self.length = np.cumsum(length) - length, length

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Tokens that stand at an edge of ``token`` while it is made, each with the rank of the merge that takes it in."""
        key = (token, right)
        if key not in self.edges:
            out, taken = [], float("inf")
            while True:
                out.append((token, taken))
                if token not in self.parts:
                    break
                left_part, right_part, taken = self.parts[token]
                token = right_part if right else left_part
            self.edges[key] = out
        return self.edges[key]

    def compatible(self, left: int, right: int) -> bool:
        """Whether both stand side by side in the encoding of their bytes."""
        key = (left, right)
        fits = self.fits.get(key)
        if fits is None:
            fits = True
            for a, a_taken in self._edge(left, True):
                for b, b_taken in self._edge(right, False):
                    rank = self.rank.get((a, b))
                    # of equal merges the leftmost comes first
                    if rank is not None and rank < a_taken and rank <= b_taken:
                        fits = False
            if len(self.fits) > 4 * REMEMBERED:
                self.fits.clear()
            self.fits[key] = fits
        return fits

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of each word, for words in byte order."""
        compatible, fits, ends = self.compatible, self.fits.get, self.ends.iter
        last, start = [-1], [0]  # by depth: the last token of the prefix, and where it begins
        before = b""
        for word in words:
            depth = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :], start[depth + 1 :]
            for end, (t, size) in ends(word.decode("latin-1")):
                if end >= depth:  # the state behind this byte isn't known yet
                    at = end + 1 - size
                    fit = fits((last[at], t)) if at else self._whole(t)
                    if fit or (fit is None and compatible(last[at], t)):
                        last.append(t)
                        start.append(at)
                        depth += 1
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            before = word
            yield tuple(ids)

    def _whole(self, token: int) -> bool:
        """Whether the bytes of ``token`` are encoded as it."""
        if token not in self.parts:
            return True
        left, right, rank = self.parts[token]
        key = (token, -1)
        if key not in self.fits:
            fits = self._whole(left) and self._whole(right)
            # the merge of both parts must be the first across their boundary
            for a, a_taken in self._edge(left, True):
                for b, b_taken in self._edge(right, False):
                    other = self.rank.get((a, b))
                    if other is not None and (a, b) != (left, right) and other < a_taken and other <= b_taken:
                        fits = False
            self.fits[key] = fits
        return self.fits[key]

    def _encode_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct units: their words are looked up, new ones go through the trie together."""
        find = self.pattern.findall
        if len(self.words) > REMEMBERED:
            self.words.clear()
        parts: list[list[str | int]] = []
        for unit in units:
            if self.split and "<" in unit and self.split.search(unit):
                cut: list[str | int] = []
                for piece in self.split.split(unit):
                    if piece in self.special:
                        cut.append(self.special[piece])
                    else:
                        cut.extend(find(piece))
                parts.append(cut)
            else:
                parts.append(find(unit))
        new = {w for part in parts for w in part if isinstance(w, str)}.difference(self.words)
        order = sorted((w.encode(), w) for w in new)
        for (_, word), ids in zip(order, self.encode_words([raw for raw, _ in order]), strict=True):
            self.words[word] = ids
        known = self.words
        return [known[p[0]] if len(p) == 1 and isinstance(p[0], str) else tuple([i for w in p for i in ((w,) if isinstance(w, int) else known[w])]) for p in parts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the number of ids of each."""
        found = [self.units.lookup(texts[a:b]) for a, b in text_slices(texts)]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text; bytes that are no UTF-8 become replacement characters."""
        size = self.length[ids]
        edge = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.repeat(self.begin[ids] - edge[:-1], size) + np.arange(edge[-1])].tobytes()
        ends = edge[np.cumsum(counts)] if len(counts) else counts
        parts = (raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False))
        return [p if _valid(p) else p.decode("utf-8", "replace").encode() for p in parts]


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """The encoder of a tokenizer file; one for each worker process."""
    return TrieEncoder(path)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, at: int):
    """Parts of batches with the ids of their texts."""
    enc = encoder(path)
    for batch in batches:
        for a in range(0, batch.num_rows, 512):  # few texts at once: a worker holds little
            part = batch.slice(a, 512)
            texts = _texts(part.column(at))
            for s, e in text_slices(texts):
                yield part.slice(s, e - s), enc, *enc.encode(texts[s:e])


def encode_documents(docs: DataFrame, path: str, name: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in place of it, and ``n_tokens``; both replace columns of these names."""
    names = [c for c in docs.columns if c not in ("text", name, "n_tokens")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids, counts in _encoded(batches, path, len(names)):
            edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(edges, pa.array(ids))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], lists, pa.array(counts)], [*names, name, "n_tokens"])

    return docs.select(*[f"`{c}`" for c in names], "text").mapInArrow(run, f"{fields}, `{name}` array<int>, n_tokens long")


def decode_documents(docs: DataFrame, path: str, name: str = "token_ids") -> DataFrame:
    """``docs`` with ``text`` in place of the ids in column ``name``."""
    names = [c for c in docs.columns if c not in ("text", name)]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lists = batch.column(len(names)).fill_null([])
            counts = np.asarray(lists.value_lengths()).astype(np.int64)
            texts = enc.decode(np.asarray(lists.flatten()), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"])

    return docs.select(*[f"`{c}`" for c in names], name).mapInArrow(run, f"{fields}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for part, enc, ids, counts in _encoded(batches, path, 1):
            words = ids.astype("<u4")
            ends = np.cumsum(counts)
            of_ids = [sha(words[s:e]) for s, e in zip(ends - counts, ends, strict=True)]
            of_text = [sha(raw) for raw in enc.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
