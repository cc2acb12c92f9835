"""Byte-level BPE: encoding and decoding of whole texts.

Method: forced-boundary splitting. Two bytes that are adjacent in no vocabulary token can never end up in one
token, so every such place is a certain cut. The fragments between the cuts, and between the cuts that the vocabulary's
pre-tokenizer makes, are merged each on its own and their ids are concatenated. Cuts keep merges short even
where a text has no blanks, and make equal fragments worth remembering.

A text is first cut before each blank that comes before a non-blank: the pre-tokenizer always starts a piece there.
Such pieces repeat, so each worker process keeps the ids of up to ``KEEP`` of them, in packed form.

The vocabulary is a tokenizers JSON file (byte-level, BPE); its path is a parameter and must be readable at that
path by every executor. Null texts count as empty: no ids, empty decoded text. A special token's string in a text
becomes that token's id, as the library has it. Bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from densefold.llm.common import column, id_text

#: Pieces that a worker remembers; beyond that it starts anew.
KEEP = 400_000
LONGEST = 256
#: Fragments up to this length are merged with a plain list, longer ones with a heap.
PLAIN = 48

# The byte-level pre-tokenizer's pattern, with white space as Unicode has it.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

_LOOSE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Memo(dict):
    """Ids of a piece as little-endian 32-bit integers; computed when first asked for."""

    def __init__(self, start: str, work):
        super().__init__()
        self.start, self.work = start, work

    def __missing__(self, piece: str) -> bytes:
        ids = self.work(self.start + piece)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= KEEP:
                self.clear()
            self[piece] = found
        return found


class PieceEncoder:
    """Encodes texts piece by piece; ``work`` gives the ids of a piece."""

    def __init__(self, work):
        self.first, self.rest = _Memo("", work), _Memo(" ", work)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = _CUT.split(text) if _LOOSE.search(text) else text.split(" ")
        if len(parts) == 1:
            return self.first[text]
        # An empty first part is a blank at the very start: nothing comes before it.
        head = self.first[parts[0]] if parts[0] else b""
        del parts[0]
        return head + b"".join(map(self.rest.__getitem__, parts))


class Vocabulary:
    """Merges, forced cuts and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE":
            raise ValueError(f"{path}: not a BPE vocabulary")
        vocab = model["vocab"]
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        joined = bytearray(65536)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
            whole = self.bytes[vocab[a + b]]
            for x, y in zip(whole, whole[1:], strict=False):
                joined[x << 8 | y] = 1
        #: 1 where the two bytes are adjacent in a token; anywhere else is a forced cut.
        self.joined = bytes(joined)
        self._table = np.frombuffer(self.joined, np.uint8)
        self._pieces = regex.compile(PIECES)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max(self.bytes) + 1
        self._length = np.zeros(size, np.int64)
        for i, b in self.bytes.items():
            self._length[i] = len(b)
        self._start = np.r_[0, np.cumsum(self._length)[:-1]]
        self._all = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)
        self._known: dict[bytes, list[int]] = {}
        #: Compiled merges for short fragments; None where ids don't follow the order of merges.
        self.core = None
        order = [vocab[a + b] for a, b in (p.split(" ") if isinstance(p, str) else p for p in model["merges"])]
        if order == sorted(set(order)) and max(self.byte_id) < order[0]:
            ranks = {b: i for i, b in self.bytes.items() if i not in set(self.special.values())}
            self.core = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special)._core_bpe

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut at every forced boundary."""
        if len(piece) < 2:
            return [piece] if piece else []
        if len(piece) <= PLAIN:
            joined = self.joined
            cuts = [i for i in range(1, len(piece)) if not joined[piece[i - 1] << 8 | piece[i]]]
        else:
            b = np.frombuffer(piece, np.uint8).astype(np.int64)
            cuts = (np.flatnonzero(self._table[b[:-1] << 8 | b[1:]] == 0) + 1).tolist()
        if not cuts:
            return [piece]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: merges of least rank first, leftmost among equals."""
        if self.core and len(fragment) <= PLAIN:
            return self.core.encode_single_piece(fragment)
        ids = [self.byte_id[b] for b in fragment]
        return self._merge_plain(ids) if len(ids) <= PLAIN else self._merge_heap(ids)

    def _merge_plain(self, ids: list[int]) -> list[int]:
        merges = self.merges
        while len(ids) > 1:
            best = min((merges[p] for p in zip(ids, ids[1:], strict=False) if p in merges), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and merges.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        heap = [(*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or (found := self.merges.get((ids[i], ids[j]))) is None or found[1] != new:
                continue
            ids[i], alive[j] = new, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := self.merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def piece_ids(self, text: str) -> list[int]:
        """Ids of any text: special tokens, then pieces, then fragments."""
        out: list[int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self._pieces.findall(part):
                for fragment in self.fragments(piece.encode()):
                    ids = self._known.get(fragment)
                    if ids is None:
                        ids = self.merge(fragment)
                        if len(fragment) <= PLAIN:
                            if len(self._known) >= KEEP:
                                self._known.clear()
                            self._known[fragment] = ids
                    out += ids
        return out

    def decode(self, ids: bytes) -> str:
        """Text of packed ids."""
        a = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(a):
            return ""
        size = self._length[a]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self._start[a] - (end - size), size)
        return self._all[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def own_encoder(path: str) -> PieceEncoder:
    """Forced-boundary encoder, one per worker process."""
    return PieceEncoder(vocabulary(path).piece_ids)


class WholeEncoder:
    """Whole texts at once, for operators whose subject isn't the encoding.

    The ids are those of the tokenizers library for the same file. They come from compiled merges over the file's own
    ranks, which take a quarter of the library's time; where a file's ids don't follow its merges, from the library.
    """

    def __init__(self, path: str):
        v = vocabulary(path)
        self.special, self.core = set(v.special), v.core
        if self.core is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.core is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return bytes(self.core.encode_to_tiktoken_buffer(text, self.special))


@lru_cache(maxsize=4)
def whole_encoder(path: str) -> WholeEncoder:
    return WholeEncoder(path)


def _encode(path: str, also_decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = own_encoder(path).encode, vocabulary(path).decode
        for batch in batches:
            ids = [encode(t) for t in column(batch, "text").to_pylist()]
            cols = {"doc_id": column(batch, "doc_id"), "ids": pa.array(ids, pa.large_binary()).cast(pa.binary())}
            if also_decode:
                cols["decoded"] = pa.array([decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "decoded": pa.array([decode(x or b"") for x in column(batch, "ids").to_pylist()], pa.string())})

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers. No shuffle."""
    return id_text(docs).mapInArrow(_encode(path, False), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) in one pass."""
    return id_text(docs).mapInArrow(_encode(path, True), "doc_id long, ids binary, decoded string")
