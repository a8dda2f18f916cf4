"""Command line: opportunities, orders and filings.

    python -m sievewright opportunities --input FILE [--limit 3] [--output FILE]
    python -m sievewright orders --order FILE --catalog FILE [--seen-pos FILE]
    python -m sievewright filings --listing DIR --output-dir DIR [--state DIR] [--min-band watch]
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import axes, gates, orders, reports, select
from .operators.state import StateTable
from .plans.candidates import CandidatePipeline, FrameSource, Scorer, Selector
from .plans.filings import scan
from .sources import filings
from .sources import orders as order_files
from .sources.opportunities import read_opportunities
from .streaming.filings import KEPT


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievewright")
    sub = p.add_subparsers(dest="command", required=True)
    o = sub.add_parser("opportunities", help="rank opportunity records")
    o.add_argument("--input", required=True)
    o.add_argument("--output")
    o.add_argument("--title", default="Opportunities", help="the report's heading")
    o.add_argument("--limit", type=int, default=3)
    o.add_argument("--min-signals", type=int, default=2)
    o.add_argument("--max-cash", type=float, default=500.0)
    o.add_argument("--max-hours", type=float, default=24.0)
    v = sub.add_parser("orders", help="validate purchase orders")
    v.add_argument("--order", required=True)
    v.add_argument("--catalog", required=True)
    v.add_argument("--seen-pos")
    f = sub.add_parser("filings", help="scan a filing listing")
    source = f.add_mutually_exclusive_group(required=True)
    source.add_argument("--listing", help="folder of listing rows as parquet or JSON lines")
    source.add_argument("--transport", help="dotted name of a transport function of the paged service")
    f.add_argument("--start", default=filings.default_dates()[0], help="yyyymmdd")
    f.add_argument("--end", default=filings.default_dates()[1], help="yyyymmdd")
    f.add_argument("--corp-classes", default="Y,K")
    f.add_argument("--public-types", default="B,C,E,I")
    f.add_argument("--archives", help="folder of <receipt>.zip documents")
    f.add_argument("--state", help="state folder; none: stateless")
    f.add_argument("--output-dir", required=True)
    f.add_argument("--min-band", choices=list(gates.S.BAND_RANK), default="watch")
    f.add_argument("--report-limit", type=int, help="candidates that the report lists; none: all")
    f.add_argument("--include-seen", action="store_true")
    f.add_argument("--no-persist", action="store_true")
    f.add_argument("--cluster-lookback-days", type=int, default=30)
    return p


def opportunity_pipeline(path: str, min_signals: int = 2, max_cash: float = 500.0, max_hours: float = 24.0) -> CandidatePipeline:
    return CandidatePipeline(
        sources=[FrameSource("opportunity_jsonl", lambda s, q: read_opportunities(s, path))],
        gates=(gates.permission_gate(), gates.minimum_evidence_gate(min_signals), gates.validation_budget_gate(max_cash, max_hours)),
        scorers=[Scorer("opportunity_axes", lambda q: axes.opportunity_axes())],
        selector=Selector("pareto", lambda q, rows: select.pareto_select(rows, q.limit)),
    )


def run_opportunities(spark: SparkSession, args) -> int:
    pipeline = opportunity_pipeline(args.input, args.min_signals, args.max_cash, args.max_hours)
    report = reports.opportunity_report(pipeline.run(spark, gates.Query(limit=args.limit)), args.title)
    if args.output:
        Path(args.output).parent.mkdir(parents=True, exist_ok=True)
        Path(args.output).write_text(report, encoding="utf-8")
    else:
        print(report)
    return 0


def validate_files(spark: SparkSession, order: str, catalog: str, seen: str | None) -> list[dict]:
    headers, lines = order_files.read_order(spark, order)
    checked = orders.validate_lines(lines, order_files.read_catalog(spark, catalog))
    return reports.order_json(orders.summarise_orders(headers, checked, order_files.read_seen(spark, seen)))


def run_orders(spark: SparkSession, args) -> int:
    found = validate_files(spark, args.order, args.catalog, args.seen_pos)
    print(json.dumps(found[0] if len(found) == 1 else found, indent=2, ensure_ascii=False))
    return 0 if all(x["status"] == "ready_for_draft" for x in found) else 2


def run_filings(spark: SparkSession, args) -> int:
    try:
        if args.transport:
            rows = filings.listing(spark, start=args.start, end=args.end, corp_classes=args.corp_classes, public_types=args.public_types, transport=args.transport)
            rows = select.stored(rows)  # the service is asked once
        else:
            reader = spark.read.json if args.listing.endswith((".json", ".jsonl")) else spark.read.parquet
            rows = gates.with_receipt(filings.from_listing(reader(args.listing)))
        archives = None
        if args.archives:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(args.archives)
            archives = files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("rcept_no"), "content")
        table = StateTable(spark, args.state) if args.state else None
        found = scan(
            rows, archives=archives, seen=table.seen() if table else None, stored=table.read() if table else None,
            include_seen=args.include_seen, lookback_days=args.cluster_lookback_days,
        )
        scored = select.stored(found.candidates)
    except (OSError, ValueError, PySparkException, filings.FilingError) as e:
        print(f"scan failed: {e}", file=sys.stderr)
        return 2
    now = datetime.now()
    counters = found.counters.first().asDict()
    if table and not args.no_persist:
        table.save(scored.select(*KEPT).withColumn("updated_at", F.lit(int(now.timestamp()))))
    kept = gates.at_least_band(scored, args.min_band)
    out, run_id = Path(args.output_dir), f"{now:%Y%m%d_%H%M%S}"
    out.mkdir(parents=True, exist_ok=True)
    reports.write_jsonl(kept, str(out / f"{run_id}_candidates.jsonl"))
    (out / f"{run_id}_report.md").write_text(reports.filing_report(kept, counters, now.isoformat(timespec="seconds"), args.report_limit), encoding="utf-8")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sievewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"opportunities": run_opportunities, "orders": run_orders, "filings": run_filings}[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
