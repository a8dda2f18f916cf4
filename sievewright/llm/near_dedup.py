"""Near-duplicates by a chosen-path set similarity join.

A document's set holds the hashes of its distinct word shingles. Rows with equal
sets form a class (keyed by a 128-bit signature and the size of the set), which is
one vertex; rows that share an id join their classes. Each class has ``WIDTH`` minwise
tokens. Independent trees branch the classes by selected ones: a node selects one
of the tokens, or two in a quarter of the nodes, and sends a class to one child for
each of them, so that a pair of similarity 0.8 keeps one child in common on the
average. Nodes of a single component are done; of the others

* those of at most ``small`` classes are compared exhaustively, leaving out pairs that
  are connected already;
* larger ones in which at most ``small`` classes lie outside of the greatest component:
  these meet each other and the whole of that component;
* larger ones with more outside branch on, by two tokens a level; at the last level
  they are compared exhaustively, in blocks.

Before this, each class is compared with one other: the pivot (smallest class) that
most of its nodes have. So a large group of copies collapses into one component with
as many pairs as it has classes, and its nodes close. Pairs are first compared by
their minwise tokens (fewer than ``CUT`` of ``WIDTH`` in common: not similar), then
confirmed on full sets made anew from the texts.

``trees`` follows from the target recall: it is the least number for which a pair at
the threshold without any other link shares a node of the last level, and passes the
comparison of minwise tokens, with at least that probability (``recall_bound``). Pairs
that end in smaller depths, or are more similar, are found more often.

Defined cases: null or wordless texts have an empty set, are kept and linked with
nothing; fewer words than ``k`` are one shingle; rows that share an id are one
vertex, linked with what any of them is linked with; rows with a null id are
their own, unlinked (component_id null, kept); very long texts are one set like any
other; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written
from .components import connected_components, merged_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Minwise tokens of a class, and how many of them two classes must have in common to be compared in full.
WIDTH, CUT = 64, 36
#: Bytes of sets that a worker keeps, and of a batch of texts or pairs of texts on its way to it.
CACHE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


def _trim() -> None:
    """Give memory that a finished task, of whatever operator, left to its worker back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out ^ one[i : len(one) - k + 1 + i])
    return np.unique(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


_SEEDS = _mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minwise(tokens: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, 32 bits of each."""
    out = None
    for lo in range(0, len(tokens), 4096):  # bounded memory for long texts
        # Tokens are random already: one multiplication spreads them well enough for a minimum.
        h = (tokens[None, lo : lo + 4096] ^ _SEEDS[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        part = (h ^ (h >> np.uint64(32))).min(1)
        out = part if out is None else np.minimum(out, part)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def survival(agreement: float, steps: int) -> float:
    """Probability that a pair shares a node after so many steps of one tree, if a
    selected token is the same with the given probability."""
    extinct = 0.0
    for _ in range(steps):
        child = 1 - agreement + agreement * extinct
        extinct = 0.75 * child + 0.25 * child * child
    return 1 - extinct


def recall_bound(similarity: float, trees: int, steps: int) -> float:
    """Probability that a pair shares a node in one of the trees and is compared."""
    law = ((a, comb(WIDTH, a) * similarity**a * (1 - similarity) ** (WIDTH - a)) for a in range(CUT, WIDTH + 1))
    return sum(p * (1 - (1 - survival(a / WIDTH, steps)) ** trees) for a, p in law)


@lru_cache
def trees_for(recall: float, similarity: float, steps: int) -> int:
    """The least number of trees that reaches the recall."""
    if recall > recall_bound(similarity, 10_000, steps):
        raise ValueError(f"no number of trees reaches a recall of {recall}")
    return next(t for t in range(1, 10_000) if recall_bound(similarity, t, steps) >= recall)


def _profile(k: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, sign, mins = [], [], []
                for text in part["text"]:
                    tokens = shingle_set(text.as_py(), k)
                    n.append(len(tokens))
                    sign.append(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64))
                    mins.append(minwise(tokens) if len(tokens) else np.zeros(0, np.int32))
                s1, s2 = np.stack(sign).T
                offsets = pa.array(np.cumsum([0, *map(len, mins)]).astype("i4"))
                flat = pa.array(np.concatenate(mins), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["tx"], pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(offsets, flat)],
                    names=["doc_id", "tx", "n", "s1", "s2", "mins"],
                )
        _trim()

    return run


def _child(node: Column, token: Column, mins: Column) -> Column:
    return F.xxhash64(node, token, F.get(mins, token))


def _branch(nodes: Column, mins: Column) -> Column:
    """The children of an array of nodes that a class goes to: one, or two in a quarter of them."""

    def children(v: Column) -> Column:
        pick = lambda i: F.pmod(F.xxhash64(v, F.lit(i)), F.lit(WIDTH)).cast("int")
        second = F.when(F.pmod(F.xxhash64(v, F.lit(3)), F.lit(4)) == 0, _child(v, pick(2), mins))
        return F.array(_child(v, pick(1), mins), second)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(nodes, children))))


def _confirm(k: int, percent: int):
    def run(batches):
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            ids = {c: batch[c].to_pylist() for c in ("a", "b")}
            keep = []
            for i in range(batch.num_rows):
                two = []
                for c, text in (("a", "ta"), ("b", "tb")):
                    x = ids[c][i]
                    found = sets.get(x)
                    if found is None:
                        found = shingle_set(batch[text][i].as_py(), k)
                        if held + found.nbytes > CACHE_BYTES:
                            sets, held = {}, 0
                        sets[x] = found
                        held += found.nbytes
                    two.append(found)
                m, n = map(len, two)
                if min(m, n) * 100 < percent * max(m, n):
                    continue
                both = len(np.intersect1d(*two, assume_unique=True))
                if both and 100 * both >= percent * (m + n - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        sets.clear()
        _trim()

    return run


def _confirm_block(k: int, percent: int):
    """Links of the left classes of a block (``side`` <= 0) with its right ones (>= 0):
    a spanning forest of them, as only their components count."""

    def run(block: pa.Table) -> pa.Table:
        ids, comps, side = (block[c].to_numpy() for c in ("cid", "comp", "side"))
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = [shingle_set(t.as_py(), k) for t in block["text"]]
            n = np.array([len(s) for s in sets], np.int64)
            both = _common(sets, left, right)
            union = n[left][:, None] + n[right][None, :] - both
            found = (100 * both >= percent * union) & (both > 0) & (comps[left][:, None] != comps[right][None, :])
            root = {int(c): int(c) for c in comps}
            for i, j in zip(*np.nonzero(found), strict=True):
                a, b = int(left[i]), int(right[j])
                x, y = int(comps[a]), int(comps[b])
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x != y:
                    root[x] = y
                    out.append((min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of tokens that left and right sets have in common, a slice of tokens at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    owner, token = owner[shared], (np.cumsum(count > 1) - 1)[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(left), len(right)), np.int64)
    width = 2048
    for lo in range(0, int((count > 1).sum()), width):
        s, e = np.searchsorted(token, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[s:e], token[s:e] - lo] = 1
        both += (has[left] @ has[right].T).astype(np.int64)
    return both


def _near(n: Column, m: Column, percent: int) -> Column:
    """Sets of sizes n and m can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


class _Join:
    """One search: the tables that its steps share, and those to delete at its end."""

    def __init__(self, rows: DataFrame, k: int, percent: int, small: int, block: int):
        self.spark, self.rows, self.k, self.percent, self.small, self.block = rows.sparkSession, rows, k, percent, small, block
        self.paths: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        out, path = written(df, label, BATCH_BYTES)
        self.paths.append(path)
        return out

    def classes_of(self, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the classes, links of classes that share an id)."""
        usable = profile.where("n > 0 AND doc_id IS NOT NULL")
        firsts = usable.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "tx", "mins")).alias("m"))
        numbered = firsts.select("s1", "s2", "n", "m.*", F.monotonically_increasing_id().alias("cid"))
        classes, _ = written(numbered, "classes")  # numbers hold once they are written
        self.classes = classes
        ids = self.keep(usable.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "shared")
        self.shared_ids = ids
        cids = usable.join(ids, "doc_id").join(classes.select("s1", "s2", "n", "cid"), ["s1", "s2", "n"]).select("doc_id", "cid")
        ends = cids.groupBy("doc_id").agg(F.min("cid").alias("a"))
        return classes, self.keep(cids.join(ends, "doc_id").where("a < cid").select("a", F.col("cid").alias("b")).distinct(), "idlinks")

    def texts_of(self, involved: DataFrame) -> DataFrame:
        """(cid, text) of the classes' carriers: the row with the class's smallest id."""
        shared = self.shared_ids.select("doc_id", F.lit(True).alias("often"))
        carriers = self.classes.select("cid", "doc_id", "tx").join(involved, "cid").join(shared, "doc_id", "left")
        found = self.rows.join(carriers.hint("shuffle_hash"), ["doc_id", "tx"]).select("cid", "text", "often")
        if self.shared_ids.isEmpty():
            return self.keep(found.select("cid", "text"), "texts")
        # Rows may be repeated; only ids that several rows have need a second look. Written, so that texts move once.
        found = self.keep(found, "found")
        once = found.where("often").groupBy("cid").agg(F.min("text").alias("text"))
        return self.keep(found.where("often IS NULL").select("cid", "text").unionByName(once), "texts")

    def confirmed(self, pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) that are links: by minwise tokens first, then on full sets."""
        mins = self.classes.select("cid", "mins")
        joined = pairs.join(mins.selectExpr("cid AS a", "mins AS ma"), "a").join(mins.selectExpr("cid AS b", "mins AS mb"), "b")
        agree = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        likely = self.keep(joined.where(agree >= CUT).select("a", "b"), f"likely-{label}")
        joined = likely.join(texts.selectExpr("cid AS a", "text AS ta"), "a").join(texts.selectExpr("cid AS b", "text AS tb"), "b")
        return self.keep(joined.select("a", "b", "ta", "tb").mapInArrow(_confirm(self.k, self.percent), "a long, b long"), f"links-{label}")

    def pivots(self, nodes: DataFrame) -> DataFrame:
        """One pair for each class: the smallest class of most of its nodes."""
        least = self.keep(nodes.groupBy("node").agg(F.min("cid").alias("p"), F.count("*").alias("c")).where("c > 1").select("node", "p"), "pivots")
        met = nodes.select("node", "cid").join(least, "node").where("p < cid")
        return self.keep(met.groupBy("cid").agg(F.mode("p", True).alias("a")).select("a", F.col("cid").alias("b")), "pairs-pivots")

    def open_nodes(self, nodes: DataFrame, comps: DataFrame, label: str) -> DataFrame:
        """(node, cid, n, comp) of the nodes with several components, with their size,
        greatest component (main) and number of classes outside of it."""
        labelled = nodes.join(comps.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        parts = labelled.groupBy("node", "comp").agg(F.count("*").alias("c"))
        shape = parts.groupBy("node").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1")
        # Written, so that the join reads two plain exchanges and AQE can split a hot node.
        shape = self.keep(shape.select("node", "size", F.col("top.comp").alias("main"), (F.col("size") - F.col("top.c")).alias("others")), f"shape-{label}")
        return self.keep(labelled.join(shape, "node"), f"open-{label}")

    def exhaustive(self, rows: DataFrame) -> DataFrame:
        """All pairs of different components of nodes that hold at most ``small`` rows here."""
        lists = rows.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("cid", "comp", "n"))).alias("m"))
        other = lambda x, y: (y["cid"] > x["cid"]) & (y["comp"] != x["comp"]) & _near(x["n"], y["n"], self.percent)
        pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: other(x, y)), lambda y: F.struct(x["cid"].alias("a"), y["cid"].alias("b")))))
        return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    def blocks(self, crowded: DataFrame, few: DataFrame, comps: DataFrame, texts: DataFrame, label: str) -> DataFrame:
        """Links of the classes outside of the main components of ``crowded`` and ``few`` nodes with
        these components, and of those of crowded nodes with each other. A text moves
        once for each block of classes that it meets, not for each pair."""
        size = F.lit(self.block)
        slot = lambda n, *key: F.pmod(F.xxhash64(*key, F.lit(5)), n).cast("int")
        key = lambda kind, g, x, y, side: F.struct(F.lit(kind).alias("kind"), g.alias("g"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        # Inside a crowded node: blocks of the classes outside meet each other.
        outside = crowded.where("comp <> main").withColumn("ob", F.ceil(F.col("others") / size).cast("int"))
        outside = outside.withColumn("i", slot(F.col("ob"), "cid", "node"))
        among = F.transform(upto(F.col("ob")), lambda j: key(0, F.col("node"), F.least("i", j), F.greatest("i", j), F.signum(F.col("i") - j) * -1))
        cells = outside.select("cid", "comp", F.explode(among).alias("key"))
        # With the main components, each taken once however many nodes it fills.
        met = crowded.unionByName(few).where("comp <> main").select("cid", "comp", F.col("main").alias("g")).distinct()
        met = self.keep(met, f"outside-{label}")
        # A main component of one class has no row in comps.
        members = comps.select(F.col("v").alias("cid"), F.col("comp").alias("g"))
        mains = met.select("g").distinct()
        lone = mains.join(comps.select(F.col("v").alias("g")), "g", "left_anti").select(F.col("g").alias("cid"), "g")
        members = self.keep(members.join(mains, "g", "left_semi").select("cid", "g").unionByName(lone), f"members-{label}")
        grid = met.groupBy("g").agg(F.ceil(F.count("*") / size).cast("int").alias("ob"))
        grid = grid.join(members.groupBy("g").agg(F.ceil(F.count("*") / size).cast("int").alias("mb")), "g")
        grid = self.keep(grid, f"grid-{label}")
        across = met.join(grid, "g").withColumn("i", slot(F.col("ob"), "cid"))
        across = across.select("cid", "comp", F.explode(F.transform(upto(F.col("mb")), lambda j: key(1, F.col("g"), F.col("i"), j, F.lit(-1)))).alias("key"))
        inward = members.join(grid, "g").withColumn("j", slot(F.col("mb"), "cid"))
        inward = inward.select("cid", F.col("g").alias("comp"), F.explode(F.transform(upto(F.col("ob")), lambda i: key(1, F.col("g"), i, F.col("j"), F.lit(1)))).alias("key"))
        cells = self.keep(cells.unionByName(across).unionByName(inward), f"cells-{label}")
        full = cells.join(texts, "cid").select("cid", "comp", "text", "key.*")
        return self.keep(full.groupBy("kind", "g", "x", "y").applyInArrow(_confirm_block(self.k, self.percent), "a long, b long").distinct(), f"blocks-{label}")


def near_duplicates(
    documents: DataFrame, *, k: int = 5, percent: int = 80, recall: float = 0.9999, levels: int = 2, small: int = 24,
    block: int = 256, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (the smallest id with an equal set),
    component_id (the smallest id reachable over links) and kept."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tx", F.xxhash64("text"))
    profile, _ = written(rows.mapInArrow(_profile(k), "doc_id long, tx long, n long, s1 long, s2 long, mins array<int>"), "sets", BATCH_BYTES)
    search = _Join(rows, k, percent, small, block)
    classes, links = search.classes_of(profile)

    trees = trees_for(recall, percent / 100, 2 * levels)
    mins = F.col("mins")
    roots = F.array(*(F.lit(v) for v in _mix(np.arange(1, trees + 1, dtype=np.uint64)).view(np.int64).tolist()))
    nodes = classes.select("cid", "n", F.explode(_branch(_branch(roots, mins), mins)).alias("node"))
    busy = search.keep(nodes.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"), "busy")
    nodes = search.keep(nodes.join(busy, "node"), "nodes")  # a class alone in a node meets nobody there
    texts = search.texts_of(nodes.select("cid").distinct())
    tried = search.pivots(nodes)
    comps = connected_components(links.unionByName(search.confirmed(tried, texts, "pivots")))
    for level in range(1, levels + 1):
        found = search.open_nodes(nodes, comps, str(level))
        few = found.where(f"size > {small} AND others <= {small}")
        many = found.where(f"size > {small} AND others > {small}")
        pairs = search.exhaustive(found.where(f"size <= {small}").unionByName(few.where("comp <> main")))
        pairs = search.keep(pairs.distinct().join(tried, ["a", "b"], "left_anti"), f"pairs-{level}")
        links = search.confirmed(pairs, texts, str(level))
        tried = tried.unionByName(pairs)
        last = level == levels
        if not (many if last else few).isEmpty() or not few.isEmpty():
            links = links.unionByName(search.blocks(many if last else many.limit(0), few, comps, texts, str(level)))
        comps = merged_components(comps, links)
        if last or many.isEmpty():
            break
        on = many.select("cid", "n", "node").join(classes.select("cid", "mins"), "cid")
        nodes = search.keep(on.select("cid", "n", F.explode(_branch(_branch(F.array("node"), mins), mins)).alias("node")), f"nodes-{level}")

    component = classes.select("cid", "doc_id").join(comps.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = component.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    final, _ = written(component.join(least, "comp").select("cid", "component_id"), "components")
    discard(search.spark, *search.paths)
    final = classes.select("s1", "s2", "n", "cid", F.col("doc_id").alias("class_id")).join(final, "cid").drop("cid")
    out = profile.drop("mins", "tx").join(final, ["s1", "s2", "n"], "left")
    lone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on sets of 4-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Pairs are of sets, equal sets first made one; SQL of the components of a table sh (doc_id, s).
COMPONENTS_SQL = r"""
wd AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM {docs}),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({k}, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k} + 1, 1) + 1)) AS i FROM wd WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT x, y FROM pr JOIN sz p ON x = p.doc_id JOIN sz q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM lk UNION ALL SELECT y, x FROM lk),
reach AS (SELECT x AS v, x AS r FROM sym UNION SELECT reach.v, sym.y FROM reach JOIN sym ON reach.r = sym.x),
comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)"""

ORACLE_SQL = f"""
WITH RECURSIVE {COMPONENTS_SQL.format(low=_LOW, docs='documents', k=4)}
SELECT wd.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(component_id, wd.doc_id) AS BIGINT) AS component_id,
  coalesce(component_id, wd.doc_id) = wd.doc_id AS kept
FROM wd LEFT JOIN sz ON wd.doc_id = sz.doc_id LEFT JOIN comp ON v = wd.doc_id
"""
