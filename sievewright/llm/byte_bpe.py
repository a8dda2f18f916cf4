"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a piece has at most ``leaf`` characters; leaves are
encoded, and neighbours are joined pairwise up the tree. A join re-encodes a
window around the boundary and keeps the tokens outside it. It may do so because
of one property of the split pattern: no alternative matches white space after
something that is not white space, so wherever a non-space is followed by a
space (a *seam*) a match starts, whatever stands further away, and merges never
cross matches. If the window starts at a seam of the left piece and ends at a
seam of the right piece, the tokens outside are therefore those of the joined
text. The window starts small and doubles until it has both seams (or a piece's
outer end); so texts without any space are still right, only slower.

Decoding maps each leaf's ids to bytes and concatenates them up the same tree.

Defined cases: a null text is the empty text (no tokens, empty bytes); special
token strings are ordinary text; repeated rows are encoded each; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def _vocabulary(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The leaf encoder and each token's length in bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


class TreeEncoder:
    def __init__(self, path: str | None = None, pattern: str | None = None, leaf: int = 512, window: int = 64):
        self.encoding, self.sizes = _vocabulary(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
        self.leaf, self.window = leaf, window
        self.joins = 0  # of all texts so far

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        return self._node(text, 0, len(text))

    def _node(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._node(text, lo, mid), self._node(text, mid, hi))

    @staticmethod
    def _seam(text: str, at: int) -> bool:
        return text[at] in " \n" and not text[at - 1].isspace()

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        width = self.window
        self.joins += 1
        while True:
            start = max(lo, mid - width)
            end = min(hi, mid + width)
            p = next((i for i in range(max(start, lo + 1), mid) if self._seam(text, i)), lo if start == lo else None)
            q = next((i for i in range(end - 1, mid, -1) if self._seam(text, i)), hi if end == hi else None)
            if p is not None and q is not None:
                break
            width *= 2
        return np.concatenate([
            left[: len(left) - self._tokens(left[::-1], text[p:mid])],
            self._leaf(text[p:q]),
            right[self._tokens(right, text[mid:q]) :],
        ])

    def _tokens(self, ids: np.ndarray, part: str) -> int:
        """How many of the first ids make up ``part``, which ends at a seam."""
        want, k = len(part.encode()), 0
        if not want:
            return 0
        k = min(len(ids), want)
        ends = np.cumsum(self.sizes[ids[:k]])
        k = int(np.searchsorted(ends, want))
        if k >= len(ends) or ends[k] != want:
            raise AssertionError("a seam must be a token boundary")
        return k + 1

    def decode(self, ids: np.ndarray, leaf: int = 8_192) -> bytes:
        """Bytes of ids, concatenated up the tree."""
        if len(ids) <= leaf:
            return self.encoding.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def _clean(text: str | None) -> str:
    """Lone surrogates (not valid in UTF-8) can't reach us from Spark; null is empty."""
    return text or ""


def encode(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of ints) of every text."""

    def run(batches):
        tree = TreeEncoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [tree.encode(_clean(t)) for t in part["text"].to_pylist()]
                values = pa.array(np.concatenate(ids).astype("i4") if ids else np.zeros(0, "i4"), pa.int32())
                offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype("i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    rows = documents.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and decoded bytes of rows (doc_id, ids); null ids decode to nothing."""

    def run(batches):
        tree = TreeEncoder(path)
        for batch in batches:
            out = [tree.decode(np.array(i or [], "<u4")) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def token_digest(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document the number and hash of its ids and the hash of what they
    decode to; ids go no further than the task that made them."""

    def run(batches):
        tree = TreeEncoder(path)
        for batch in batches:
            n, ids_hash, bytes_hash = [], [], []
            for text in batch["text"]:
                ids = tree.encode(_clean(text.as_py()))
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                bytes_hash.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(bytes_hash)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = documents.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, encoded and decoded again."""
    return token_digest(table(spark, sf_dir, "documents"))
