"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of byte strings form a monoid under a join that repairs the seam. encode() halves its bytes until they are
short enough for the plain merge loop, then joins neighbours: tokens near the seam are encoded anew over a window that
grows until the tokens outside provably stay. The proof rests on a property of greedy rank merging: a row of tokens is the
encoding of its bytes exactly if each two adjacent tokens are the encoding of their own bytes. So a window is wide
enough once its first and last tokens are compatible with the tokens outside. Decoding is the homomorphism back:
bytes are concatenated up the tree.

A text is first cut into the matches of the tokenizer's pattern and each is encoded on its own. Encoded
matches of up to KEPT characters are memoised per worker in a table of bounded size.

Defined results: null and empty texts have no tokens; repeated rows are encoded each; an empty table gives an empty
result; very long texts, and very long matches in them, are encoded whole, in memory in proportion to the text and time
n log n; a null doc_id is kept; columns other than doc_id and text are not read, whatever their names. Special tokens in a text are
ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronofold.llm._common import Bounded, arrow, rows_in

#: Bytes that the plain merge loop takes on at once.
LEAF = 48
#: Token ids that are decoded at once; and the longest match, in characters, that is memoised.
IDS, KEPT = 4096, 64


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.fits = Bounded(self._fits)
        self.packed = Bounded(lambda piece: np.array(self.encode_bytes(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes(), longest=KEPT)

    def merge(self, data: bytes) -> list[int]:
        """A token as it is, else the plain loop."""
        return [whole] if (whole := self.ranks.get(data)) is not None else self.loop(data)

    def loop(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of the least rank, the first of equals, until none is left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < 1 << 60:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of what left and right encode."""
        if not left or not right or self.fits[left[-1], right[0]]:
            return left + right
        take, text = 1, self.bytes_of
        while True:
            a, b = max(0, len(left) - take), min(len(right), take)
            window = self.merge(b"".join([text[t] for t in left[a:]] + [text[t] for t in right[:b]]))
            if (a == 0 or self.fits[left[a - 1], window[0]]) and (b == len(right) or self.fits[window[-1], right[b]]):
                return left[:a] + window + right[b:]
            take *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern. Neighbours are joined level by level, so depth costs no stack."""
        if len(data) <= LEAF:
            return self.merge(data) if data else []
        row = [self.merge(data[i : i + LEAF // 2]) for i in range(0, len(data), LEAF // 2)]
        while len(row) > 1:
            row = [self.join(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids: of each leaf of IDS ids, then concatenated pair by pair up the tree."""
        row, get = np.frombuffer(ids, "<u4"), self.bytes_of.__getitem__
        parts = [b"".join(map(get, row[k : k + IDS].tolist())) for k in range(0, len(row), IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a public vocabulary; the file is installed beside its library on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        c = codec(path, pattern)
        for ids, texts in rows_in(batches, "doc_id", "text", size=200):
            packed = [c.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32())), pa.array([c.decode(p) for p in packed], pa.binary())], schema=schema)

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what encode() gives, as digests made where it is made."""

    def run(batches):
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for ids, texts in rows_in(batches, "doc_id", "text", size=500):
            packed = [c.encode(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "ids_sha256": [sha(p) for p in packed], "decoded_sha256": [sha(c.decode(p)) for p in packed]})

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
