"""Printed journals as files come: split headers, page headers, continuation rows, totals that differ."""

import pytest
from pyspark.sql import functions as F

from quillmint.operators import carry
from quillmint.operators.carry import filled_in_blocks
from quillmint.sources import printed
from quillmint.sources.printed import read_printed, report_rows

HEAD = ['"Document",,,,,,,,,,,,,,,"Address"', 'Number,Co,G/L Date,Account Number,,,,Description,,Debit Amount,,Credit Amount,,Remark,,Number,Name']


def row(document="", company="", date="", account="", debit="", credit="", remark="", supplier="", name=""):
    cells = [""] * 17
    for at, x in zip((0, 1, 2, 3, 9, 11, 13, 15, 16), (document, company, date, account, debit, credit, remark, supplier, name), strict=True):
        cells[at] = f'"{x}"' if "," in x else x
    return ",".join(cells)


def total(debit, credit, text="Grand Total"):
    return ",".join([text, *[""] * 8, f'"{debit}"', "", f'"{credit}"'])


def read(spark, folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    got = read_printed(report_rows(spark, f"file://{folder}"), ["4110"], ["4250"])
    key = lambda r: (r["file"].split("/")[-1][:-4], r.asDict().get("voucher", 0))
    return {key(r): r for r in got.vouchers.collect()}, {key(r)[0]: r for r in got.files.collect()}


def test_report_as_it_comes(spark, tmp_path):
    body = [
        row(account="1.5200", debit="9.00"),  # before any voucher
        row("PV", "00010", "3/25/2025", "12.5200.10", "1,200.50", remark="A, B", supplier="77", name="Mill"),
        row(account="12.4250", debit=".26"),
        *HEAD,
        row(account="1.4110", credit="1,200.76", supplier="78"),
        ",,,,",
        row("PV", "00010", "3/4/2025", "12.5200", "n/a"),
        row(account="12.5200", debit="5.00", credit="5.00"),
        row(account="12.5200", company="00010", debit="1.00"),  # neither a first row nor a next one
        row(account="12.", debit="1.00"),
        row("PC", "00010", "4/5/2025", "12.5200", credit="(3.00)"),
        row(account="1.4110", debit="3.00-"),
        total("1,205.76", "1,205.76", "Company Total"),
    ]
    sums = total("1,202.76", "1,202.76")
    vouchers, files = read(spark, tmp_path, a=["Journal,,R1", "page 1", *HEAD, *body, sums], b=["Journal", *HEAD, *body, total("1,202.77", "1,202.76")], c=[line for line in body if line not in HEAD])
    a = vouchers["a", 6]
    assert (a["n_lines"], a["net"], a["gross"], a["tax"], a["balanced"], a["supplier"], a["name"], str(a["gl_date"])) == (3, 0, 120076, 26, True, "77", "Mill", "2025-03-25")
    odd = vouchers["a", 12]  # its first row cannot be read, yet it begins the voucher
    assert (odd["n_lines"], odd["net"], odd["both_columns"], str(odd["gl_date"])) == (1, 0, True, "2025-03-04")
    assert (vouchers["a", 16]["net"], vouchers["a", 16]["gross"]) == (0, 300)
    assert sorted(k for k in vouchers if k[0] == "c") == [("c", 2), ("c", 6), ("c", 10)]  # standard columns
    f = files["a"]
    assert (f["n_lines"], f["unreadable"], f["total_rows"], f["titles"], f["headed"], f["debit"], f["credit"], f["differs"]) == (6, 4, 2, 6, True, 120276, 120276, False)
    assert files["b"]["differs"] and not files["c"]["headed"] and not files["c"]["differs"]


def test_order_of_dates_and_headers_that_lack_a_column(spark, tmp_path):
    lines = lambda *dates: [row("PV", "1", d, "1.52", "1.00") for d in dates]
    bare = [h.replace("Remark", "") for h in HEAD]
    vouchers, files = read(spark, tmp_path, day=lines("25/3/2025", "4/5/2025"), month=lines("3/25/2025", "4/5/2025"), both=lines("25/3/2025", "3/25/2025", "4/5/2025"), bare=[*bare, *lines("3/4/2025")], empty=[""])
    assert str(vouchers["day", 2]["gl_date"]) == "2025-05-04"
    assert str(vouchers["month", 2]["gl_date"]) == "2025-04-05" and str(vouchers["both", 3]["gl_date"]) == "2025-04-05"
    assert files["bare"]["problem"] == "remark" and files["bare"]["n_lines"] == 0
    assert "empty" not in files


def test_rows_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"{n},y\n" for n in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = report_rows(spark, f"file://{tmp_path}", 2).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(int(r["cells"][0]) == r["row"] for r in got)


def test_vouchers_go_on_over_blocks(spark):
    """The last value before a row, over block borders, empty blocks and keys, for numbers with gaps."""
    rows = [(f, n * 3 - 40, n if n % 11 == f else None, "x") for f in range(2) for n in range(60)] + [(1, 1 << 60, None, "x")]
    df = spark.createDataFrame(rows, "file int, row long, head int, cells string")
    want, last = {}, {}
    for f, n, head, _ in rows:
        last[f] = head if head is not None else last.get(f)
        want[f, n] = last[f]
    for block in (1, 7, 1000):
        assert {(r["file"], r["row"]): r["head"] for r in filled_in_blocks(df, "file", "row", "head", block).collect()} == want


def test_layouts_are_not_carried_by_shuffles(spark, monkeypatch):
    """A file's rows are dealt once for its vouchers, by blocks, not by ranges that need a sample and once more for its layout."""
    monkeypatch.setattr(carry, "filled", lambda *_: pytest.fail("dealt by ranges"))
    assert not hasattr(printed, "filled")
    got = read_printed(spark.createDataFrame([("f", n, ["PV" if n % 3 == 0 else "", "", "", "1.5200", *[""] * 5, "1.00", *[""] * 7]) for n in range(1, 200)], "file string, row long, cells array<string>"), ["4110"], ["4250"])
    assert got.files.first()["n_lines"] == 197 and got.vouchers.count() == 66


def test_ordinary_amounts_are_read_as_others(spark):
    """The quick pattern for ordinary amounts reads no text in another way."""
    texts = ["1.00", ".26", "0.26", "1,200.50", "1,200,300.05", "1200.50", "12,00.50", ",200.50", "1,20.50", "(3.00)", "3.00-", "1.234", "1,234", "7", "7.5", ".", "n/a", "1.200,50", "99999999999999999.00", "\n1.00", "1.00\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = (printed.printed_amount(F.regexp_replace("t", "^\\.", "0.")) * 100).cast("long")
    assert [r[0] == r[1] for r in df.select(printed._cents(F.col("t")), plain).collect()] == [True] * len(texts)
