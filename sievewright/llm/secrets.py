"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its bytes.
The ledger holds the (blob, rule version) pairs that were scanned; only pairs
it does not hold are scanned, once each, however many paths or versions share
the blob, and the findings are then joined back to all paths.

A blob's carrier is the smallest id among its copies, found by a partial
aggregate over (hash, id) pairs; only carriers' texts are moved (one hash join,
without a sort), and of these only such as hold one of the literals, or a run of hex
digits, that every finding contains. The others are entered in the ledger as free of
findings. Findings are few, so joining them back moves hashes alone, and
a hot blob is a skewed side of an ordinary join, which AQE splits.

Defined cases: a null text is the empty blob; repeated rows and equal texts are
separate paths with equal findings; null ids are carried; very long texts take time
in proportion to their length; other columns of the
input are not read; empty tables give empty findings and an empty ledger.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

RULE_VERSION = "2"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more is just the match that [0-9a-f]+ with that length is
#: Kinds in the order in which they are listed where spans start together.
BASE_KINDS = ("assign", "access", "hex")
#: Further kinds: (name, a literal that any match contains, pattern). Repetitions that could start
#: again inside their own run have a bound, so that time is in proportion to the text.
_MORE = (
    ("private_key", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)")),
    ("jwt", "eyJ", None),
    ("vcs_token", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat_token", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("pay_key", "k_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}")),
    ("url_login", "://", re.compile(r"(?:\b[a-z][a-z0-9+.-]{0,20})://[^\s/:@]+:([^\s/:@]{6,})@")),
)
KINDS = (*BASE_KINDS, *(k for k, _, _ in _MORE))
#: What findings of the kinds contain; texts with none of it aren't moved.
LITERALS, HEX_RUN = ("AKIA", "eyJ", "-----BEGIN", "xox", "://"), "[0-9a-f]{16}"
KEYWORDS, PREFIXES = "(?i)password|passwd|secret|token|api_?key", "gh[pousr]_|k_live_"
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")


def _web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of three dotted parts of which the first begins with eyJ at a word's
    border, has 8 characters more, and the others 8. Every dotted run is walked once."""
    for run in _DOTTED.finditer(text):
        parts, at, free = run[0].split("."), run.start(), 0
        for i, part in enumerate(parts[:-2]):
            if i >= free and len(parts[i + 1]) >= 8 and len(parts[i + 2]) >= 8:
                k = part.find("eyJ")
                while k > 0 and part[k - 1] != "-":
                    k = part.find("eyJ", k + 1)
                if 0 <= k <= len(part) - 11:
                    yield at + k, at + len(part) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                    free = i + 3
            at += len(part) + 1


def scan_text(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every finding, by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (_, literal, pattern) in enumerate(_MORE, len(BASE_KINDS)):
        if literal in text:
            spans = _web_tokens(text) if pattern is None else (m.span() for m in pattern.finditer(text))
            found += [(a, k, b) for a, b in spans]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


_SPANS = "array<struct<start:int,kind:string,end:int>>"


def _scan(batches):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    for batch in batches:
        spans = [
            [{"start": a, "kind": k, "end": b} for a, k, b in scan_text(t.as_py() or "")] for t in batch["text"]
        ]
        yield pa.RecordBatch.from_arrays([batch["blob"], pa.array(spans, kind)], names=["blob", "spans"])


class Ledger:
    """The durable ledger: a Parquet table of (blob, rule_version, spans) at ``path``,
    any path that Spark reads, to which scans append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(conf).exists(at):
            return None
        return self.spark.read.schema(f"blob string, rule_version string, spans {_SPANS}").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select("blob", "rule_version", "spans").write.mode("append").parquet(self.path)


def may_hold(text: Column) -> Column:
    """False only for texts in which no kind can match: a test without Python, before any
    text is moved. The patterns are tried on texts that hold a sign they need."""
    out = F.when(text.contains(":") | text.contains("="), text.rlike(KEYWORDS)).otherwise(False)
    out = out | F.when(text.contains("_"), text.rlike(PREFIXES)).otherwise(False)
    for literal in LITERALS:
        out = out | text.contains(literal)
    return out | text.rlike(HEX_RUN)


def scan_versions(
    versions: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    rule_version: str = RULE_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """(findings per path, ledger rows to append).

    ``ledger`` has (blob, rule_version, spans); its rows of this rule version are
    reused. The returned rows are those of newly scanned blobs only, and already
    written to the shared folder; the findings have doc_id, blob and spans (never
    null) for every input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    paths = versions.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
    # Written, as the test of the text and its hash are needed twice, and the text isn't.
    keyed, _ = written(paths.select("doc_id", "blob", may_hold(F.col("text")).alias("may")), "blobs")
    # A null id stands for itself where a blob has no other.
    carriers = keyed.groupBy("blob").agg(F.min("doc_id").alias("carrier"), F.first("may").alias("may"))
    known = None
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])
        carriers = carriers.join(known.select("blob"), "blob", "left_anti")
    carriers, _ = written(carriers, "carriers")
    # Only a blob's carrier is scanned; a repeated carrier row is the same blob, kept once below.
    texts = paths.where(may_hold(F.col("text"))).alias("p").join(
        carriers.where("may").alias("c").hint("shuffle_hash"),
        (F.col("p.doc_id").eqNullSafe(F.col("c.carrier"))) & (F.col("p.blob") == F.col("c.blob")),
        "left_semi",
    )
    scanned = texts.select("blob", "text").mapInArrow(_scan, f"blob string, spans {_SPANS}")
    scanned = scanned.unionByName(carriers.where("NOT may").select("blob", F.array().cast(_SPANS).alias("spans")))
    fresh, _ = written(scanned.withColumn("rule_version", F.lit(rule_version)), "ledger")
    fresh = fresh.dropDuplicates(["blob"])
    all_known = fresh.select("blob", "spans") if known is None else fresh.select("blob", "spans").unionByName(known)
    # Written, so that the join below reads two plain exchanges and AQE can split a hot blob.
    hits, _ = written(all_known.where(F.size("spans") > 0), "hits")
    none = F.array().cast(_SPANS)
    findings = keyed.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", none))
    return findings.select("doc_id", "blob", "spans"), fresh.select("blob", "rule_version", "spans")


def scan_with_ledger(versions: DataFrame, ledger: Ledger, **options) -> DataFrame:
    """Findings per path; the ledger is read first and what was scanned newly is appended."""
    findings, fresh = scan_versions(versions, ledger.read(), **options)
    ledger.append(fresh)
    return findings


def secret_digest(findings: DataFrame) -> DataFrame:
    """Counts of the base kinds and the listings of base and of all spans."""

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listing(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return findings.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


def redact(versions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The input with every found span of the text column replaced by ``mark``;
    overlapping spans are replaced together. All columns, in order."""
    names = versions.columns
    row = "sw_row_blob"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    findings, _ = scan_versions(versions, id_col=id_col, text_col=text_col)
    hits = findings.where(F.size("spans") > 0).select(F.col("blob").alias(row), "spans").dropDuplicates([row])
    hits, _ = written(hits.withColumnRenamed("spans", "sw_spans"), "redactions")
    # Only texts that may hold a finding are joined and go through Python.
    may = may_hold(text)
    joined = versions.where(may).withColumn(row, F.sha2(text, 256)).join(hits, row, "left")
    replaced = F.pandas_udf(lambda texts, spans: pd.Series([_without(t, s, mark) for t, s in zip(texts, spans, strict=True)], dtype=object), "string")
    return joined.withColumn(text_col, replaced(F.col(text_col), F.col("sw_spans"))).select(*names).unionByName(versions.where(~may))


def _without(text: str | None, spans, mark: str) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for s in spans:  # in order of their starts
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join([*out, text[at:]])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per distinct text, with a ledger of the query's own."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    return secret_digest(scan_with_ledger(table(spark, sf_dir, "documents"), ledger))
