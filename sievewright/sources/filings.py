"""Filing listings, structured rows and document archives.

``FilingListing`` is a Python data source over a paged service: one input partition
for each (date window, company class, filing type), each of which walks its pages
with retries. The transport is a function from (endpoint, parameters) to the decoded
answer, so tests and offline runs need no network.
"""

from __future__ import annotations

import importlib
import io
import json
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timedelta
from typing import Any
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen
from xml.etree import ElementTree
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import text, ymd

FIELDS = ("corp_cls", "corp_name", "corp_code", "stock_code", "report_nm", "rcept_no", "flr_nm", "rcept_dt", "rm")
#: Endpoints by kind, statuses, and limits of the service.
STRUCTURED = {"acquisition": "otcprStkInvscrInhDecsn.json", "cb": "cvbdIsDecsn.json", "bw": "bdwtIsDecsn.json", "equity_issuance": "piicDecsn.json"}
OK_STATUSES, EMPTY_STATUS, RETRYABLE = ("", "000"), "013", ("020", "800", "900")
RETRY_HTTP = (429, 500, 502, 503, 504)
MAX_SPAN_DAYS, MAX_PAGE = 80, 100
SERVICE = "https://opendart.fss.or.kr/api"


class FilingError(Exception):
    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


def date_windows(start: str, end: str, span: int = MAX_SPAN_DAYS) -> list[tuple[str, str]]:
    """Inclusive windows of at most ``span`` days."""
    a, b = (date(int(x[:4]), int(x[4:6]), int(x[6:])) for x in (start, end))
    if a > b:
        raise FilingError(f"start is after end: {start}>{end}")
    out = []
    while a <= b:
        last = min(b, a + timedelta(days=max(int(span), 1) - 1))
        out.append((f"{a:%Y%m%d}", f"{last:%Y%m%d}"))
        a = last + timedelta(days=1)
    return out


def window_frame(spark: SparkSession, start: str, end: str, span: int = MAX_SPAN_DAYS) -> DataFrame:
    """The same windows as a DataFrame expression."""
    a, b = ymd(F.lit(start)), ymd(F.lit(end))
    step = F.make_interval(days=F.lit(max(int(span), 1)))
    rows = spark.range(1).select(F.explode(F.sequence(a, b, step)).alias("a"))
    last = F.least(F.date_add("a", max(int(span), 1) - 1), b)
    return rows.select(F.date_format("a", "yyyyMMdd").alias("window_start"), F.date_format(last, "yyyyMMdd").alias("window_end"))


def url_transport(key: str, base: str = SERVICE, timeout: float = 20.0) -> Callable[[str, dict], tuple[int, Any]]:
    """A transport over HTTP: answers of .json endpoints are decoded, others are bytes."""
    key = key.strip()
    if not key:
        raise FilingError("the service asks for a key")

    def get(endpoint: str, params: dict) -> tuple[int, Any]:
        url = f"{base.rstrip('/')}/{endpoint.lstrip('/')}?{urlencode({**params, 'crtfc_key': key})}"
        try:
            with urlopen(url, timeout=timeout) as answer:  # noqa: S310
                code, content = answer.status, answer.read()
        except HTTPError as e:
            return e.code, None
        try:
            return code, json.loads(content) if endpoint.endswith(".json") else content
        except ValueError as e:
            raise FilingError(f"the answer isn't JSON: {e}", retryable=True) from e

    return get


def _answer(transport: Callable[[str, dict], Any], endpoint: str, params: dict, attempts: int = 3, sleep=time.sleep) -> tuple[int, Any]:
    """The transport's answer; network failures and busy codes are retried with
    doubling pauses of at most 4 s."""
    for attempt in range(1, max(attempts, 1) + 1):
        try:
            code, payload = transport(endpoint, params)
            if code not in RETRY_HTTP:
                return code, payload
            problem = f"HTTP {code}"
        except OSError as e:
            problem = str(e)
        if attempt < attempts:
            sleep(min(0.5 * 2 ** (attempt - 1), 4.0))
    raise FilingError(f"request failed: {problem}", retryable=True)


def fetch(transport: Callable[[str, dict], Any], endpoint: str, params: dict, attempts: int = 3, sleep=time.sleep) -> dict:
    """The decoded answer. Status 013 is an empty listing."""
    code, payload = _answer(transport, endpoint, params, attempts, sleep)
    if code >= 400 or not isinstance(payload, dict):
        raise FilingError(f"unexpected answer: HTTP {code}")
    status = str(payload.get("status") or "").strip()
    if status == EMPTY_STATUS:
        return payload | {"list": []}
    if status not in OK_STATUSES:
        raise FilingError(f"status {status}: {payload.get('message', '')}", retryable=status in RETRYABLE)
    return payload


def fetch_document(transport: Callable[[str, dict], Any], receipt: str, **options) -> bytes:
    """The archive of a receipt's document; the service's own error otherwise."""
    code, content = _answer(transport, "document.xml", {"rcept_no": str(receipt)}, **options)
    if code >= 400:
        raise FilingError(f"unexpected answer: HTTP {code}")
    return archive_content(content)


def documents_of(receipts: DataFrame, transport: str) -> DataFrame:
    """(rcept_no, content, problem) of every receipt, fetched by the executors; ``transport``
    is the dotted name of a transport function. A failure is its row's problem."""

    def run(batches):
        module, _, function = transport.rpartition(".")
        get = getattr(importlib.import_module(module), function)
        for batch in batches:
            contents, problems = [], []
            for receipt in batch["rcept_no"].to_pylist():
                try:
                    contents.append(fetch_document(get, receipt))
                    problems.append(None)
                except FilingError as e:
                    contents.append(None)
                    problems.append(f"document: {e}")
            yield pa.RecordBatch.from_arrays([batch["rcept_no"], pa.array(contents, pa.binary()), pa.array(problems, pa.string())], names=["rcept_no", "content", "problem"])

    return receipts.select(F.col("rcept_no").cast("string")).mapInArrow(run, "rcept_no string, content binary, problem string")


def find_receipt(rows: Iterable[dict], receipt: str) -> dict | None:
    """The first row of a receipt, compared without surrounding blanks."""
    wanted = str(receipt).strip()
    return next((dict(r) for r in rows if str(r.get("rcept_no") or "").strip() == wanted), None)


def list_rows(payload: dict) -> list[dict]:
    rows = payload.get("list") or []
    if not isinstance(rows, list):
        raise FilingError("list has an unexpected form", retryable=True)
    return [r for r in rows if isinstance(r, dict)]


def fetch_structured(transport: Callable[[str, dict], Any], kind: str, corp_code: str, start: str, end: str, **options) -> list[dict]:
    """Structured rows of one company within dates, straight from the service."""
    if kind not in STRUCTURED:
        raise FilingError(f"unknown structured kind: {kind}")
    params = {"corp_code": str(corp_code), "bgn_de": str(start), "end_de": str(end)}
    return list_rows(fetch(transport, STRUCTURED[kind], params, **options))


def archive_content(content: bytes | None) -> bytes:
    """A document answer that is a ZIP archive; otherwise the service's error."""
    content = content or b""
    if zipfile.is_zipfile(io.BytesIO(content)):
        return content
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        root = None
    status = (root.findtext("status") or "").strip() if root is not None else ""
    if status:
        raise FilingError(f"document status {status}: {(root.findtext('message') or '').strip()}", retryable=status in RETRYABLE)
    raise FilingError("the document is not a ZIP archive", retryable=True)


def default_dates(now: datetime | None = None) -> tuple[str, str]:
    """Yesterday and today in Seoul."""
    today = (now or datetime.now(ZoneInfo("Asia/Seoul"))).date()
    return f"{today - timedelta(days=1):%Y%m%d}", f"{today:%Y%m%d}"


class Span(InputPartition):
    def __init__(self, order: int, start: str, end: str, corp_cls: str, kind: str):
        self.order, self.start, self.end, self.corp_cls, self.kind = order, start, end, corp_cls, kind


class FilingListing(DataSource):
    """Options: start, end, corp_classes, public_types, page_count and transport, the
    dotted name of the transport function."""

    @classmethod
    def name(cls) -> str:
        return "filing_listing"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS) + ", fetch_order long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Span]:
        o = self.options
        split = lambda k, d: [x.strip() for x in o.get(k, d).split(",") if x.strip()]
        spans = [(w, c, t) for w in date_windows(o["start"], o["end"]) for c in split("corp_classes", "Y,K") for t in split("public_types", "B,C,E,I")]
        return [Span(i, w[0], w[1], c, t) for i, (w, c, t) in enumerate(spans)]

    def read(self, partition: Span) -> Iterator[tuple]:
        module, _, function = self.options["transport"].rpartition(".")
        transport = getattr(importlib.import_module(module), function)
        page, count, n = 1, max(1, min(int(self.options.get("page_count", MAX_PAGE)), MAX_PAGE)), 0
        while True:
            params = {
                "bgn_de": partition.start, "end_de": partition.end, "last_reprt_at": "N", "pblntf_ty": partition.kind, "corp_cls": partition.corp_cls,
                "sort": "date", "sort_mth": "asc", "page_no": page, "page_count": count,
            }
            payload = fetch(transport, "list.json", params)
            for row in list_rows(payload):
                yield (*(str(row.get(f) or "").strip() for f in FIELDS), (partition.order << 32) + n)
                n += 1
            if page >= int(payload.get("total_page") or 1):
                return
            page += 1


def listing(spark: SparkSession, **options: str) -> DataFrame:
    """All filings of a range: rows without a receipt are dropped, of a repeated
    receipt the last fetched stays; the result's order is left to its reader."""
    spark.dataSource.register(FilingListing)
    return last_fetched(spark.read.format("filing_listing").options(**options).load())


def last_fetched(rows: DataFrame) -> DataFrame:
    from ..operators.cluster import latest_by_key

    return latest_by_key(from_listing(rows, "fetch_order").where("rcept_no <> ''"), "rcept_no", "fetch_order").drop("fetch_order")


def from_listing(rows: DataFrame, *extra: str) -> DataFrame:
    """Trimmed text fields; nulls and absent fields are empty."""
    have = set(rows.columns)
    return rows.select(*((text(F.col(f)) if f in have else F.lit("")).alias(f) for f in FIELDS), *extra)


def structured_rows(rows: DataFrame, kind: str, corp_code: str, start: str, end: str) -> DataFrame:
    """Rows of a stored structured table; company and dates are pushed to the scan."""
    if kind not in STRUCTURED:
        raise FilingError(f"unknown structured kind: {kind}")
    return rows.where((F.col("structured_kind") == kind) & (F.col("corp_code") == corp_code) & F.col("rcept_dt").between(start, end))
