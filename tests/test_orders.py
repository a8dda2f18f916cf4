"""Order intake: codes, quarantine and exact totals."""

import json

from sievewright.__main__ import main, validate_files

CATALOG = {"A": {"price": "12.50", "inventory": 100}, "B": {"price": "9.00", "inventory": 5}, "N": {"price": None, "inventory": None}}


def run(spark, tmp_path, order, seen=()):
    for name, value in (("order", order), ("catalog", CATALOG), ("seen", list(seen))):
        (tmp_path / f"{name}.json").write_text(json.dumps(value), encoding="utf-8")
    return validate_files(spark, *(str(tmp_path / f"{n}.json") for n in ("order", "catalog", "seen")))[0]


def test_mixed_order(spark, tmp_path):
    lines = [("A", 10, "12.50"), ("B", 9, "9.00"), ("", 1, "1"), ("A", 1.5, "12.5"), ("A", 1, "-1"), ("X", 1, "1"), ("N", 2, "3.0"), ("A", 2, "12.51"), ("A", 1, "12.52")]
    order = {"purchase_order_number": " PO-1 ", "customer_id": "", "currency": "usd", "lines": [dict(zip(("sku", "quantity", "unit_price"), x, strict=True)) for x in lines]}
    got = run(spark, tmp_path, order, ["PO-1"])
    assert [(e["code"], e["line_index"]) for e in got["exceptions"]] == [
        ("duplicate_po", None), ("missing_customer", None), ("insufficient_inventory", 1), ("missing_sku", 2), ("invalid_quantity", 3), ("invalid_price", 4),
        ("unknown_sku", 5), ("catalog_price_missing", 6), ("inventory_missing", 6), ("price_mismatch", 8),
    ]
    assert [x["line_index"] for x in got["normalized_lines"]] == [0, 7]
    assert (got["order_total"], got["quarantined_total"], got["currency"], got["status"]) == ("150.02", "99.52", "USD", "needs_review")


def test_clean_and_empty_orders(spark, tmp_path, capsys):
    good = {"purchase_order_number": "P", "customer_id": "C", "currency": "USD", "lines": [{"sku": "A", "quantity": 2, "unit_price": "12.50"}]}
    assert run(spark, tmp_path, good)["order_total"] == "25.00"
    args = ["orders", "--order", str(tmp_path / "order.json"), "--catalog", str(tmp_path / "catalog.json")]
    assert main(args) == 0 and json.loads(capsys.readouterr().out)["status"] == "ready_for_draft"
    got = run(spark, tmp_path, good | {"lines": []})
    assert [e["code"] for e in got["exceptions"]] == ["missing_lines"] and got["order_total"] == "0"
    assert main(args) == 2
