"""Substring dedup: a count-min prefilter, then exact grouping of windows.

A window is ``width`` consecutive words; the words of a window are removed if the
same word sequence also starts in a document with a smaller id.

1. One pass over the texts gives each document's content hash and its *anchors*:
   the minima of hashed half-windows over each window. Equal windows have equal
   anchors, so the count of an anchor is never below that of its windows, and
   there is about one anchor for 13 words instead of one window for each.
2. Whole copies (equal word sequences) are put together first, so that a large group
   of them is one partial aggregate: all but the smallest id are removed whole.
3. Count-min: a sketch of ``ROWS`` rows of 2^``bits`` cells, a fixed width. Every
   partition counts the cells of its anchors in each row (the partial aggregate is
   the partition's sketch, of which only cells in use are stored), the sketches are merged
   by cell, and the least count of an anchor's cells estimates in how many texts its
   windows occur. It can only overestimate, so no repeated window is lost. Windows
   estimated in one are done with, and documents without others are finished.
4. The remaining texts are packed into chunks. Windows estimated in two or more
   are dealt by hash to slices of bounded size, each chunk
   sending a window once with its smallest id; a slice finds the smallest id of
   all and answers each chunk with one bit for each of its windows. The chunks
   then drop the words covered.

Windows are grouped by 128 bits of hash. Hot passages cost no more than one entry
in each chunk, and no group of documents is ever gathered.

Defined cases: null or empty texts have no words and nothing is removed; texts
with fewer than ``width`` words lose nothing; very long texts are cut whole; rows
with a null id take no part and lose nothing; rows that share an id don't remove words of each other; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Rows of the count-min sketch.
ROWS = 2
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        n = max(1024, 1 << (n - 1).bit_length())
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        found = _powers[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return found


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(base, n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down[:n], dtype=np.uint64)])
    return _mix((sums[k:] - sums[:-k]) * up[: n - k + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every k consecutive values."""
    n, have = len(a) - k + 1, 1
    while have * 2 <= k:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[:n], a[k - have : k - have + n])


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchor of every window."""
    half = max(1, width // 2)
    grams = rolling(hashes, half, _B1)
    return sliding_min(grams, width - half + 1).view(np.int64)


def sketch_cell(anchor: Column, row: int, bits: int) -> Column:
    """The cell of an anchor in a row of the sketch; rows follow each other."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(row), anchor), 64 - bits) + F.lit(row << bits)


def repeated_cells(anchors: DataFrame, bits: int) -> DataFrame:
    """(cell) of the merged sketch's cells that were counted twice or more; ``anchors`` has a column anchor."""
    cells = anchors.select(F.explode(F.array(*(sketch_cell(F.col("anchor"), r, bits) for r in range(ROWS)))).alias("cell"))
    return cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")


def estimated_repeated(anchors: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """The rows of ``anchors`` whose least count is two or more: all of their cells are in ``cells``."""
    for r in range(ROWS):
        anchors = anchors.join(cells, sketch_cell(F.col("anchor"), r, bits) == F.col("cell")).drop("cell")
    return anchors


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profile(width: int):
    def run(batches):
        for batch in batches:
            n_words, content, sha, cells = [], [], [], []
            for text in batch["text"]:
                words = _words(text.as_py())
                n_words.append(len(words))
                sha.append(_sha(words))
                if len(words) >= width:
                    h = word_hashes(words)
                    cells.append(np.unique(window_anchors(h, width)))
                else:
                    cells.append(np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, cells)]).astype("i4")
            flat = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tx"], pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                names=["doc_id", "tx", "n_words", "sha", "cells"],
            )

    return run


_CHUNK = "chunk long, n_words long, ids array<long>, texts array<string>, cells array<array<long>>"


def _pack(batches):
    """Rows to chunks of at most 256 rows or about a million characters."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            end, size = at, 0
            while end < batch.num_rows and end - at < 256 and size < 1_000_000:
                size += len(batch["text"][end].as_py())
                end += 1
            ids, texts, cells = (batch[c].slice(at, end - at) for c in ("doc_id", "text", "cells"))
            one = pa.array([0, end - at], pa.int32())
            pack = [pa.ListArray.from_arrays(one, pa.concat_arrays([x])) for x in (ids, texts, cells)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([size // 4], pa.int64()), *pack],
                names=["chunk", "n_words", "ids", "texts", "cells"],
            )
            made += 1
            at = end


def _windows(row: dict, width: int):
    """Of a chunk: per text its words and the positions of its windows to compare,
    and for all of these windows their hashes, checks and texts' indices."""
    texts, hashes, checks, docs = [], [], [], []
    for k, (text, cells) in enumerate(zip(row["texts"], row["cells"], strict=True)):
        words = _words(text)
        h = word_hashes(words)
        at = np.flatnonzero(np.isin(window_anchors(h, width), np.array(cells, np.int64)))
        texts.append((words, at))
        hashes.append(rolling(h, width, _B1)[at])
        checks.append(rolling(h, width, _B2)[at])
        docs.append(np.full(len(at), row["ids"][k], np.int64))
    return texts, np.concatenate(hashes), np.concatenate(checks), np.concatenate(docs)


def _entries(hashes, checks, docs):
    """Distinct windows in order of hash and check, each with its smallest id; and the entry of every window."""
    order = np.lexsort((docs, checks, hashes))
    h, c, d = hashes[order], checks[order], docs[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(first) - 1
    return h[first], c[first], d[first], entry


def _by_slice(hashes: np.ndarray, slices: int) -> dict[int, np.ndarray]:
    """The entries of each slice that has any, in order."""
    to = ((hashes >> np.uint64(20)) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    have, first = np.unique(to[order], return_index=True)
    return dict(zip(have.tolist(), np.split(order, first[1:]), strict=True)) if len(have) else {}


def _send(width: int, slices: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, hashes, checks, docs = _windows(row, width)
                h, c, d, _ = _entries(hashes, checks, docs)
                rows = list(_by_slice(h, slices).items())
                tables = [np.unique(d[i], return_inverse=True) for _, i in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _ in rows], pa.int32()),
                        pa.array([row["chunk"]] * len(rows), pa.int64()),
                        pa.array([h[i].tobytes() for _, i in rows], pa.binary()),
                        pa.array([c[i].tobytes() for _, i in rows], pa.binary()),
                        pa.array([t.tobytes() for t, _ in tables], pa.binary()),
                        pa.array([x.astype("u2").tobytes() for _, x in tables], pa.binary()),
                    ],
                    names=["slice", "chunk", "hashes", "checks", "ids", "which"],
                )

    return run


def _answer(group: pa.Table) -> pa.Table:
    """For each chunk's windows of a slice: whether another chunk has a smaller id."""
    rows = group.to_pylist()
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    checks = np.concatenate([np.frombuffer(r["checks"], np.uint64) for r in rows])
    docs = np.concatenate([np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["which"], np.uint16)] for r in rows])
    _, _, least, entry = _entries(np.concatenate(hashes), checks, docs)
    later = least[entry] < docs
    cuts = np.cumsum([0, *map(len, hashes)])
    bits = [np.packbits(later[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "slice": pa.array([r["slice"] for r in rows], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _remove(width: int, slices: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts, hashes, checks, docs = _windows(row, width)
                h, _, least, entry = _entries(hashes, checks, docs)
                entries = _by_slice(h, slices)
                later = np.zeros(len(h), bool)
                for answer in row["answers"] or ():
                    own = entries[answer["slice"]]
                    later[own] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=len(own)).astype(bool)
                gone = later[entry] | (least[entry] < docs)
                n_words, removed, sha, kept, lo = [], [], [], [], 0
                for words, at in texts:
                    starts = at[gone[lo : lo + len(at)]]
                    lo += len(at)
                    change = np.zeros(len(words) + 1, np.int64)
                    change[starts] += 1
                    np.subtract.at(change, starts + width, 1)
                    covered = np.cumsum(change[:-1]) > 0
                    left = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    n_words.append(len(words))
                    removed.append(len(words) - len(left))
                    sha.append(_sha(left))
                    kept.append(b" ".join(left).decode() if keep_text else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def dedup_substrings(documents: DataFrame, *, width: int = 50, bits: int = 44, slice_windows: int = 200_000, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined
    by one space); with ``keep_text`` also kept_text, for texts that lost words (for
    the others it is null: they stay as they are). Ids must be integers."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tx", F.xxhash64("text"))
    profile, _ = written(
        rows.mapInArrow(_profile(width), "doc_id long, tx long, n_words long, sha string, cells array<long>"), "anchors"
    )
    # Whole copies. The hash of the joined words is the content's; a hot group is one partial aggregate.
    firsts = profile.where(f"doc_id IS NOT NULL AND n_words >= {width}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # Written, so that the join reads two plain exchanges and AQE can split a hot text.
    firsts, _ = written(firsts.where("n > 1").select("sha", "first"), "firsts")
    settled, _ = written(profile.join(firsts, "sha", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("first"), "settled")
    live = settled.where(f"NOT copy AND doc_id IS NOT NULL AND n_words >= {width}")
    cells, _ = written(repeated_cells(live.select(F.explode("cells").alias("anchor")), bits), "sketch")
    hits = estimated_repeated(live.select("doc_id", "tx", F.explode("cells").alias("anchor")), cells, bits)
    hits, _ = written(hits.groupBy("doc_id", "tx").agg(F.collect_set("anchor").alias("cells")), "hits")
    chunks, _ = written(
        rows.join(hits.hint("shuffle_hash"), ["doc_id", "tx"]).select("doc_id", "text", "cells").mapInArrow(_pack, _CHUNK), "chunks"
    )
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    slices = max(1, -(-total // slice_windows))
    sent = chunks.mapInArrow(_send(width, slices), "slice int, chunk long, hashes binary, checks binary, ids binary, which binary")
    answers = sent.groupBy("slice").applyInArrow(_answer, "chunk long, slice int, bits binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("slice", "bits")).alias("answers"))
    final = chunks.join(answers, "chunk", "left").mapInArrow(
        _remove(width, slices, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])]
    easy = settled.join(hits.select("doc_id", "tx"), ["doc_id", "tx"], "left_anti")
    easy = easy.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).alias("kept_text"),
    )
    return final.select(*names).unionByName(easy.select(*names))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word windows of all documents, removed."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH wd AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM wd WHERE len(w) >= 50)),
mn AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN mn USING (s) WHERE m < doc_id)),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM wd),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS s FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT wd.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM wd LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
