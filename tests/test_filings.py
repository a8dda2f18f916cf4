"""Listing, documents, taxonomy, enrichment, clustering, scores, state and streaming."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sievewright.__main__ import main, parser
from sievewright.operators import cluster, facts, reports, risk, taxonomy
from sievewright.operators.state import StateTable
from sievewright.plans import filings as plan
from sievewright.sources import documents, filings
from sievewright.streaming import filings as streaming

ROW = {"corp_cls": "Y", "corp_name": "Corp", "corp_code": "1", "stock_code": "000001", "flr_nm": "F", "rm": ""}
ACQ, CB, PIVOT = "주요사항보고서(타법인 주식 및 출자증권 양수결정)", "[기재정정]전환사채권 발행결정", "신규시설투자"


def listing(spark, *rows):
    return filings.from_listing(spark.createDataFrame([ROW | r for r in rows]))


def transport(endpoint, params):
    """A listing of two pages; every receipt appears in both."""
    page = params["page_no"]
    rows = [ROW | {"rcept_no": f"{params['bgn_de']}{params['corp_cls']}", "rcept_dt": params["bgn_de"], "report_nm": f" page {page} "}, "junk", {"rcept_no": None}]
    return 200, {"status": "000", "total_page": 2, "list": rows}


def test_windows(spark):
    want = [("20240101", "20240320"), ("20240321", "20240401")]
    assert filings.date_windows("20240101", "20240401") == want
    assert [tuple(r) for r in filings.window_frame(spark, "20240101", "20240401").collect()] == want
    with pytest.raises(filings.FilingError, match="after end"):
        filings.date_windows("20240102", "20240101")


def test_listing_source_reads_pages_and_keeps_the_last(spark):
    got = filings.listing(spark, start="20240101", end="20240401", public_types="B", transport="tests.test_filings.transport").collect()
    assert len(got) == 4 and {r.report_nm for r in got} == {"page 2"}


def test_fetch_retries_and_statuses():
    calls = []

    def flaky(endpoint, params):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("down")
        return (503, None) if len(calls) == 2 else (200, {"status": "013"})

    pauses = []
    assert filings.fetch(flaky, "x", {}, sleep=pauses.append)["list"] == [] and pauses == [0.5, 1.0]
    with pytest.raises(filings.FilingError) as e:
        filings.fetch(lambda *_: (200, {"status": "020", "message": "limit"}), "x", {})
    assert e.value.retryable
    with pytest.raises(filings.FilingError, match="failed"):
        filings.fetch(lambda *_: (500, None), "x", {}, sleep=lambda s: None)
    with pytest.raises(filings.FilingError, match="form"):
        filings.list_rows({"list": "x"})


def test_direct_answers():
    ok = lambda endpoint, params: (200, {"status": "000", "list": [{"a": 1}, "x"]})
    assert filings.fetch_structured(ok, "cb", "1", "20240101", "20240102") == [{"a": 1}]
    with pytest.raises(filings.FilingError, match="unknown"):
        filings.fetch_structured(ok, "zz", "1", "20240101", "20240102")
    assert filings.archive_content(archive(a_txt="x"))[:2] == b"PK"
    with pytest.raises(filings.FilingError, match="020: busy") as e:
        filings.archive_content(b"<r><status>020</status><message>busy</message></r>")
    assert e.value.retryable
    with pytest.raises(filings.FilingError, match="ZIP"):
        filings.archive_content(b"text")


def test_command_line(spark, tmp_path):
    args = ["filings", "--transport", "tests.test_filings.transport", "--start", "20240101", "--end", "20240105", "--output-dir", str(tmp_path / "out"), "--min-band", "low"]
    assert main([*args, "--state", str(tmp_path / "state")]) == 0
    report = next((tmp_path / "out").glob("*_report.md")).read_text(encoding="utf-8")
    assert "조회 공시: 2건" in report and "신규 후보가 없습니다" in report
    assert main([*args[:4], "20250101", *args[5:]]) == 2


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("_", "."), content)
    return out.getvalue()


def test_documents(spark):
    table = "<table><tr><td>신 규-사업</td><td>진출<tr><td>매출액</td><td>-</td><td>51,000원</td></tr><tr><td> </td></tr></table>"
    rows = [(1, archive(a_html=table, b_png=b"x")), (2, archive(a_txt="<p>plain  text</p>".encode("cp949"))), (3, b"broken"), (4, None), (5, archive(a_xml="한글 <b>x</b>".encode("cp949")))]
    got = {r.id: r for r in documents.document_rows(spark.createDataFrame(rows, "id int, content binary"), "id", "content").collect()}
    assert got[1]["rows"] == [["신 규-사업"], ["매출액", "-", "51,000원"]] and got[2]["rows"] == [["plain text"]] and got[3].problem and got[4]["rows"] == []
    assert got[5]["rows"] == [["한글 x"]]
    found = spark.createDataFrame([(got[1]["rows"],)], "rows array<array<string>>").select(documents.purpose_phrases(F.col("rows")).alias("p"), documents.financial_snapshot(F.col("rows")).alias("s")).first()
    assert found.p == ["신 규-사업", "매출액 | - | 51,000원"] and found.s == {"revenue": 51000.0}


def test_taxonomy_order(spark):
    names = [ACQ, "최대주주변경을수반하는주식양수도계약체결", "최대주주변경", CB, "주주총회소집공고", "기업설명회개최", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, report_nm string")
    got = taxonomy.classify(rows).orderBy("i").collect()
    assert [r.category for r in got] == ["acquisition_control", "acquisition_control", "governance_change", "financing_dilution", "portfolio_pivot", "other", "other"]
    assert [r.structured_kind for r in got[:4]] == ["acquisition", None, None, "cb"] and [r.requires_document for r in got[:2]] == [False, True]
    assert got[3].is_correction and got[3].normalized_report_name == "전환사채권 발행결정"


def test_structured_facts(spark):
    row = {"rcept_no": "r", "atinh_eqrt": "51.00", "inh_pp": "사업다각화", "dl_pym": "인수금융 차입", "inhdtl_tast_vs": "120.5%", "iscmp_mbsn": " 배터리 "}
    got = facts.normalise({"acquisition": spark.createDataFrame([row]), "zz": spark.createDataFrame([{"rcept_no": "q"}])}, "rcept_no").orderBy("rcept_no").collect()
    a = got[1]
    assert (a.control_acquisition, a.new_business_language, a.debt_like_payment, a.asset_ratio_pct, a.target_business) == (True, True, True, 120.5, "배터리")
    assert got[0].raw_structured == '{"rcept_no":"q"}'
    e = facts.equity_facts(spark.createDataFrame([{"nstk_ostk_cnt": "1,000", "nstk_estk_cnt": "-", "bfic_tisstk_ostk": "4,000"}])).first()
    assert e.dilution_ratio_pct == 25.0


def test_report_lists_and_counts_all_candidates(spark):
    found = plan.scan(listing(spark, {"rcept_no": "2", "rcept_dt": "20240110", "report_nm": ACQ}))
    many = found.candidates.crossJoin(spark.range(1001).select()).cache()
    counters = found.counters.first().asDict()
    whole = reports.filing_report(many, counters, "now")
    assert "리포트 후보: 1001건" in whole and whole.count("|Corp(000001)|") == 1001 and "표시하지 않은" not in whole
    short = reports.filing_report(many, counters, "now", 2)
    assert "리포트 후보: 1001건" in short and "표시하지 않은 후보: 999건" in short and short.count("|Corp(000001)|") == 2
    args = parser().parse_args(["filings", "--listing", "x", "--output-dir", "y", "--report-limit", "5"])
    assert args.report_limit == 5


def test_leveraged_acquisition_scores(spark):
    """A financing filing ten days before an acquisition: attention at its cap, risk 75."""
    rows = listing(spark, {"rcept_no": "2", "rcept_dt": "20240110", "report_nm": ACQ}, {"rcept_no": "1", "rcept_dt": "20240101", "report_nm": CB}, {"rcept_no": "3", "rcept_dt": "20240301", "report_nm": PIVOT})
    fact = spark.createDataFrame([("2", True, 120.0, 110.0, True, "바이오", True, None), ("1", None, None, None, None, None, None, "제3자배정")],
                                 "rcept_no string, control_acquisition boolean, asset_ratio_pct double, equity_ratio_pct double, new_business_language boolean, target_business string, debt_like_payment boolean, issue_method string")
    found = plan.scan(rows, structured=fact)
    got = {r.rcept_no: r for r in found.candidates.collect()}
    assert (got["2"].attention_score, got["2"].financing_risk_score, got["2"].band) == (100.0, 75.0, "urgent")
    assert got["2"].related_receipts == ["1"] and got["2"].cluster_tags == ["leveraged_transformation"]
    assert got["1"].cluster_tags == [] and got["1"].financing_risk_score == 5.0 and got["3"].attention_score == 28.0 and got["3"].band == "low"
    assert "정정" in " ".join(got["1"].reasons) and len(got["2"].reasons) == 7
    report = reports.filing_report(found.candidates, found.counters.first().asDict(), "now")
    assert "|urgent|Corp(000001)|" in report and "연관 접수번호: 1" in report
    assert risk.ranked(found.candidates).first().rcept_no == "2"


def test_stored_events_of_the_same_day(spark):
    rows = risk.with_facts(taxonomy.classify(listing(spark, {"rcept_no": "5", "rcept_dt": "20240110", "report_nm": ACQ})))
    stored = risk.with_facts(taxonomy.classify(listing(spark, {"rcept_no": "9", "rcept_dt": "20240110", "report_nm": CB}, {"rcept_no": "4", "rcept_dt": "20231211", "report_nm": CB}, {"rcept_no": "3", "rcept_dt": "20231210", "report_nm": CB})))
    near = lambda **o: [e.rcept_no for e in cluster.related_events(rows, stored, **o).first().related]
    assert near() == ["4", "9"] and near(strict_causal=True) == ["4"] and near(lookback_days=0) == ["9"]


def test_documents_only_where_needed(spark):
    rows = listing(spark, {"rcept_no": "1", "rcept_dt": "20240101", "report_nm": "주주총회소집공고"}, {"rcept_no": "2", "rcept_dt": "20240101", "report_nm": ACQ})
    zipped = archive(a_html="<tr><td>사업목적 추가</td></tr><tr><td>자산총계</td><td>7</td></tr>")
    files = spark.createDataFrame([("1", zipped), ("2", b"never read")], "rcept_no string, content binary")
    fact = spark.createDataFrame([("2", True)], "rcept_no string, control_acquisition boolean")
    got = {r.rcept_no: r for r in plan.scan(rows, structured=fact, archives=files).candidates.collect()}
    assert got["1"].attention_score == 38.0 and got["1"].document_financial_snapshot == {"assets": 7.0} and got["2"].warnings == []


def test_state_and_streaming_equal_batch(spark, tmp_path):
    names = [ACQ, CB, PIVOT, "최대주주변경"]
    rows = [{"rcept_no": f"202401{d:02d}{i}", "rcept_dt": f"202401{d:02d}", "report_nm": names[(d + i) % 4], "corp_code": str(i)} for d in range(1, 9) for i in range(2)]
    folder = tmp_path / "in"
    for k in range(2):
        listing(spark, *(rows[:10] if k == 0 else rows[6:])).coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    streaming.start(spark, str(folder), schema, str(tmp_path / "state"), str(tmp_path / "ck"), files_per_batch=1).awaitTermination()
    table = StateTable(spark, str(tmp_path / "state"))
    got = {r.rcept_no: r.attention_score for r in table.read().collect()}
    want = {r.rcept_no: r.attention_score for r in plan.scan(listing(spark, *rows)).candidates.collect()}
    assert got == want and table.version() == 2
    assert [r.rcept_no for r in table.recent_events("1", "20240101", "20240103", "202401021").collect()] == ["202401011", "202401031"]
    assert plan.scan(listing(spark, *rows), seen=table.seen()).counters.first().skipped_seen == len(rows)
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0)], "ts string, event_type string, value double")
    assert streaming.event_rates(events).first().total == 3.0


def test_state_versions_fold_and_compact(spark, tmp_path):
    table, want = StateTable(spark, str(tmp_path / "state"), compact=3), {}
    schema = "rcept_no string, corp_code string, rcept_dt string, band string, updated_at long"
    for i in range(1, 6):
        rows = [(str(k), "c", f"2024010{k}", f"b{i}", i) for k in range(i, i + 3)]
        assert table.save(spark.createDataFrame(rows, schema)) == i
        for r in rows:
            want[r[0]] = (r[3], i, want[r[0]][2] if r[0] in want else i)
        assert {r.rcept_no: (r.band, r.updated_at, r.first_seen_at) for r in table.read().collect()} == want
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["b3", "d1", "d2", "d4", "d5"]
    assert [r.rcept_no for r in table.recent_events("c", "20240102", "20240106", "3").collect()] == ["2", "4", "5", "6"]
    assert table.recent_events("other", "20240102", "20240106", "3").count() == 0 and table.seen().count() == 7
    assert StateTable(spark, str(tmp_path / "none")).read() is None


def document_service(endpoint, params):
    receipt = params["rcept_no"]
    if receipt == "1":
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("a.xml", "<TABLE><TR><TD>총자산</TD><TD>7</TD></TR></TABLE>".encode("cp949"))
        return 200, buffer.getvalue()
    return (404, None) if receipt == "3" else (200, b"<r><status>020</status><message>busy</message></r>" if receipt == "2" else b"junk")


def test_documents_are_fetched_by_receipt(spark):
    rows = filings.documents_of(spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "rcept_no string"), "tests.test_filings.document_service")
    got = {r.rcept_no: r for r in rows.collect()}
    assert got["1"].problem is None and got["2"].problem == "document: document status 020: busy" and "404" in got["3"].problem and "ZIP" in got["4"].problem
    with pytest.raises(filings.FilingError) as e:
        filings.fetch_document(document_service, "2")
    assert e.value.retryable
    parsed = documents.document_rows(rows.where("content IS NOT NULL"), "rcept_no", "content").first()
    assert parsed.rows == [["총자산", "7"]]
    assert filings.find_receipt([{"rcept_no": " 5 "}, {"rcept_no": None}], "5") == {"rcept_no": " 5 "} and filings.find_receipt([], "5") is None
    with pytest.raises(filings.FilingError):
        filings.url_transport("  ")
