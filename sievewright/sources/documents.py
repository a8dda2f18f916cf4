"""Table rows of filing documents: ZIP archives or markup, parsed on the executors.

Parsing HTML has no built-in expression, so it is a batch function over Arrow rows;
what follows on the rows (phrases, financial figures) are expressions again.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compact_cell, parse_number, strip

#: Fixed values.
SUFFIXES = (".xml", ".html", ".htm", ".xhtml", ".txt")
ENCODINGS = ("utf-8", "cp949", "euc-kr")
MARKERS = ("사업목적", "사업다각화", "신규사업", "신성장동력", "정관변경")
METRICS = {
    "assets": ("자산총계", "총자산"), "liabilities": ("부채총계", "총부채"), "equity": ("자본총계", "자기자본"),
    "revenue": ("매출액", "영업수익"), "operating_profit": ("영업이익", "영업손실"), "net_income": ("당기순이익", "당기순손실"),
}
_CELLS = ("td", "th")


class _Tokens(HTMLParser):
    """Tags and texts of a markup, in order: ("<", tag), (">", tag) and ("", text)."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.found.append(("<", tag))

    def handle_endtag(self, tag):
        self.found.append((">", tag))

    def handle_data(self, data):
        self.found.append(("", data))


def _cells(tokens: list[tuple[str, str]]) -> Iterator[tuple[int, str]]:
    """(row number, text) of every closed cell; an opening cell replaces an unclosed one."""
    row, texts = 0, None
    for kind, value in tokens:
        if not kind:
            if texts is not None:
                texts.append(value)
        elif value == "tr":
            row += 1
        elif value in _CELLS:
            if kind == ">" and texts is not None:
                yield row, _plain(" ".join(texts))
            texts = [] if kind == "<" else None


def _plain(text: str) -> str:
    """Text with single spaces."""
    return " ".join(text.split())


def decode(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", errors="replace")


def markup_rows(markup: str) -> list[list[str]]:
    """Table rows with some text; without any table row the whole text as one cell."""
    try:
        rows = [[text for _, text in cells] for _, cells in groupby(_cells(_Tokens(markup).found), key=itemgetter(0))]
    except Exception:  # broken markup: its text is still worth a row
        rows = []
    if not rows:
        rows = [[_plain(re.sub(r"<[^>]+>", " ", markup))]]
    return [r for r in rows if any(r)]


def archive_rows(content: bytes) -> list[list[str]]:
    """Rows of all markup files of an archive, in its order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        texts = (decode(archive.read(name)) for name in archive.namelist() if name.lower().endswith(SUFFIXES))
        return list(chain.from_iterable(map(markup_rows, texts)))


def document_rows(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, rows, problem) of documents whose content is a ZIP archive (binary) or
    markup (text). A broken archive has no rows and says so instead of failing."""
    schema = documents.select(key, content).schema

    def parse(batches):
        for batch in batches:
            rows, problems = [], []
            for value in batch[content].to_pylist():
                try:
                    rows.append([] if value is None else archive_rows(value) if isinstance(value, bytes) else markup_rows(value))
                    problems.append(None)
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows.append([])
                    problems.append(f"document: {e}")
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(rows, pa.list_(pa.list_(pa.string()))), pa.array(problems, pa.string())], names=[key, "rows", "problem"])

    return documents.select(key, content).mapInArrow(parse, f"`{key}` {schema[key].dataType.simpleString()}, rows array<array<string>>, problem string")


def _joined(row: Column) -> Column:
    return F.array_join(F.filter(F.transform(row, strip), lambda c: c != ""), " | ")


def purpose_phrases(rows: Column) -> Column:
    """Of rows with a purpose marker the row and the next two, each text once, 20 at most."""
    marked = lambda r: F.exists(F.array(*map(F.lit, MARKERS)), lambda m: compact_cell(_joined(r)).contains(m))
    groups = F.transform(rows, lambda r, i: F.when(marked(r), F.transform(F.slice(rows, i + 1, 3), _joined)).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(F.flatten(groups), lambda p: p != "")), 1, 20)


def financial_snapshot(rows: Column) -> Column:
    """map of metric to number: the first row whose first matching cell has a number to its right."""
    entries = []
    for metric, labels in METRICS.items():
        found = F.get(F.filter(F.transform(rows, _right_of(labels)), lambda x: x.isNotNull()), F.lit(0))
        entries.append(F.struct(F.lit(metric).alias("key"), found.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _right_of(labels: tuple[str, ...]):
    def value(row: Column) -> Column:
        at = F.array_position(F.transform(row, lambda c: _has(compact_cell(c), labels)), True)
        right = F.when(at > 0, F.slice(row, (at + 1).cast("int"), F.size(row)))
        return F.get(F.filter(F.transform(right, parse_number), lambda x: x.isNotNull()), F.lit(0))

    return value


def _has(x: Column, labels: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for label in labels:
        out = out | x.contains(label)
    return out
