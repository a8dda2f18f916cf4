"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test items are cut into windows of ``width`` words (a shorter item is one
window). Windows of one length form a searcher: its shift table tells for each
block of two words how far the search may move on without missing a window, and
is consulted at every ``width - 1`` words of ordinary text; blocks that end some
window (shift 0) select by their suffix hash a bucket of test strings, which are
compared directly.

The windows are cut by the executors and broadcast in blocks of at most ``block``
windows, one block at a time, so what is broadcast, and what a worker builds of it,
has a fixed bound however many test items there are. Documents are never
shuffled: with one block the search is one narrow pass; with more, each block is a
pass that leaves the hits only, which are merged and joined to the documents' rows
by id and text hash. Workers take texts in slices of bounded size and keep their
searchers from task to task.

Defined cases: null or wordless texts have no words, no hits and are clean;
null ids are carried; items without words or without an id are ignored; equal
windows of several items count for each of them; very long texts and items are
searched whole; repeated rows are returned each; other columns of either table
are not read, so clashing names do no harm; empty tables give empty results or
zero hits.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

#: Bytes to normalised bytes: A-Z to a-z; ASCII other than letters and digits to space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Bytes of text that a worker takes at once.
SLICE_BYTES = 4 << 20


def bench_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def item_windows(words: list[bytes], width: int) -> set[bytes]:
    """All windows of ``width`` words, joined by spaces; the whole item if it is shorter, none if empty."""
    if not words:
        return set()
    width = min(width, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class WuManber:
    """Search for word sequences of one length ``m``, given joined by spaces.

    The shift table is an array indexed by a hash of a block; blocks that share a cell
    share the least shift, so a collision costs a look and never a match."""

    def __init__(self, patterns: dict[bytes, list[str]], m: int):
        self.m = m
        self.b = b = min(2, m)
        self.step = m - b + 1
        self.mask = (1 << max(10, min(22, (len(patterns) * m * 4).bit_length()))) - 1
        self.shift = bytearray([min(self.step, 255)]) * (self.mask + 1)
        self.buckets: dict[bytes, dict[bytes, list[str]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            words = pattern.split(b" ")
            for end in range(b, m + 1):
                cell = hash(b" ".join(words[end - b : end])) & self.mask
                self.shift[cell] = min(self.shift[cell], m - end)
            self.buckets[b" ".join(words[m - b :])][pattern] = items

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, item ids) of every occurrence."""
        m, two, shift, mask, n = self.m, self.b == 2, self.shift, self.mask, len(words)
        buckets = self.buckets
        end = m
        while end <= n:
            block = words[end - 2] + b" " + words[end - 1] if two else words[end - 1]
            move = shift[hash(block) & mask]
            if move:
                end += move
                continue
            bucket = buckets.get(block)
            if bucket is not None:
                items = bucket.get(b" ".join(words[end - m : end]))
                if items is not None:
                    yield end - m, items
            end += 1


def _searchers(windows: Iterable[tuple[str, bytes]]) -> list[WuManber]:
    by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, window in windows:
        by_length[window.count(b" ") + 1][window].append(item)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


_kept: tuple[str, list[WuManber]] = ("", [])


def _searchers_of(windows, token: str) -> list[WuManber]:
    """The searchers of a broadcast block, kept by the worker until it gets another."""
    global _kept
    if _kept[0] != token:
        _kept = ("", [])
        _kept = (token, _searchers(windows.value))
    return _kept[1]


def _blocks(benchmark: DataFrame, width: int, block: int, text_col: str, item_col: str) -> Iterator[list]:
    """Windows of the test items in lists of at most ``block``; they stream in, one partition at a time."""

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                items, windows = [], []
                for i, t in zip(part["i"].to_pylist(), part["t"].to_pylist(), strict=True):
                    found = sorted(item_windows(bench_words(t), width))
                    items += [i] * len(found)
                    windows += found
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary())], names=["i", "w"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    windows = rows.where("i IS NOT NULL AND t IS NOT NULL").mapInArrow(cut, "i string, w binary").distinct()
    windows, path = written(windows, "windows")
    found: list[tuple[str, bytes]] = []
    for row in windows.toLocalIterator():
        found.append((row.i, bytes(row.w)))
        if len(found) == block:
            yield found
            found = []
    discard(benchmark.sparkSession, path)
    if found:
        yield found


_RANGES = "array<struct<start:long,end:long>>"
_HITS = f"n_words long, hits {_RANGES}, items array<string>"
_RANGES_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_BYTES of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["sw_text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _search(windows, only_hits: bool):
    """Adds n_words, hits and items; with ``only_hits`` the text is left out, and so are rows without a hit."""
    token = uuid.uuid4().hex

    def search(batches):
        searchers = _searchers_of(windows, token) if windows is not None else []
        for batch in batches:
            for part in _slices(batch):
                n_words, hits, items = [], [], []
                for text in part["sw_text"]:
                    words = bench_words(text.as_py())
                    ranges, found = [], set()
                    for s in searchers:
                        for start, ids in s.find(words):
                            ranges.append((start, start + s.m))
                            found.update(ids)
                    n_words.append(len(words))
                    hits.append(_merged(ranges))
                    items.append(sorted(found))
                made = [pa.array(n_words, pa.int64()), pa.array(hits, _RANGES_TYPE), pa.array(items, pa.list_(pa.string()))]
                names = [c for c in part.schema.names if not (only_hits and c == "sw_text")]
                out = pa.RecordBatch.from_arrays([*(part[c] for c in names), *made], names=[*names, "n_words", "hits", "items"])
                yield out.filter(pa.array([bool(h) for h in hits], pa.bool_())) if only_hits else out

    return search


def _together(batches):
    """Ranges of several blocks merged, and their items in order."""
    for batch in batches:
        hits = [_merged([(h["start"], h["end"]) for h in x]) for x in batch["hits"].to_pylist()]
        items = [sorted(set(x)) for x in batch["items"].to_pylist()]
        made = [pa.array(hits, _RANGES_TYPE), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sw_key"], *made], names=batch.schema.names)


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 13,
    block: int = 50_000,
    extra: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: n_words, hits (sorted, merged [start, end) word ranges) and
    items (ids, as strings, of the items with an occurring window), with the columns
    of ``extra`` carried along."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("sw_text"), *(F.col(c) for c in extra if c != text_col))
    schema = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {_HITS}"
    blocks = _blocks(benchmark, width, block, item_text_col, item_col)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        windows = None if first is None else spark.sparkContext.broadcast(first)
        out = rows.mapInArrow(_search(windows, False), schema(rows))
    else:
        keys = rows.select("doc_id", F.xxhash64("sw_text").alias("sw_key"), "sw_text")
        kept = keys.drop("sw_text")
        found = None
        for windows in _chained(first, second, blocks):
            shared = spark.sparkContext.broadcast(windows)
            part, _ = written(keys.mapInArrow(_search(shared, True), schema(kept)), "hits")
            shared.destroy()
            found = part if found is None else found.unionByName(part)
        # As many arrays for a text as blocks hit it.
        found = found.groupBy("doc_id", "sw_key").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.flatten(F.collect_set("items")).alias("items"))
        joined = found.mapInArrow(_together, f"{schema(kept).rpartition(', n_words')[0]}, hits {_RANGES}, items array<string>")
        joined = joined.withColumnsRenamed({"doc_id": "sw_id", "sw_key": "sw_k"})
        # Every row once more for its number of words; the hits are joined to it.
        base = rows.mapInArrow(_search(None, False), schema(rows)).drop("hits", "items").withColumn("sw_key", F.xxhash64("sw_text"))
        out = base.join(joined, F.col("doc_id").eqNullSafe(F.col("sw_id")) & (F.col("sw_key") == F.col("sw_k")), "left").drop("sw_id", "sw_k", "sw_key")
        none = {"hits": _RANGES, "items": "array<string>"}
        out = out.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})
    return out.withColumnRenamed("sw_text", text_col) if text_col in extra else out.drop("sw_text")


def _chained(first, second, rest):
    yield first
    yield second
    yield from rest


def contamination_digest(found: DataFrame, *extra: str) -> DataFrame:
    """The digest columns of ``find_contamination``'s result."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.withColumn("n_hit", n_hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *extra,
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the items of ``benchmark``."""
    return contamination_digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

ORACLE_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT item, len(w) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p, least(13, len(w)) AS m
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
occ AS (SELECT doc_id, i, win.m, item FROM win JOIN pat ON win.p = pat.p AND win.m = pat.m),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
