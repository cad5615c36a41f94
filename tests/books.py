"""Minimal workbook files for tests."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from leasemill.functions import vocabulary as V

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(col: int) -> str:
    text = ""
    while col:
        col, rest = divmod(col - 1, 26)
        text = chr(65 + rest) + text
    return text


def workbook(sheets: dict[str, dict[tuple[int, int], object]], shared: bool = True) -> bytes:
    """Strings go to the shared table or inline; ('date', serial) uses a date style."""
    table: list[str] = []

    def cell(address, value):
        where = f'r="{letters(address[1])}{address[0]}"'
        if isinstance(value, tuple):
            return f'<c {where} s="1"><v>{value[1]}</v></c>'
        if isinstance(value, str):
            if shared:
                table.append(value)
                return f'<c {where} t="s"><v>{len(table) - 1}</v></c>'
            return f'<c {where} t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        if value is None:
            return f"<c {where}/>"
        return f"<c {where}><v>{value}</v></c>"

    parts = {}
    for i, cells in enumerate(sheets.values(), start=1):
        rows = ""
        for row in sorted({r for r, _ in cells}):
            inside = "".join(cell(a, cells[a]) for a in sorted(cells) if a[0] == row)
            rows += f'<row r="{row}">{inside}</row>'
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>'
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, start=1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(
        f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
    ) + "</Relationships>"
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">' + "".join(
        f"<si><t>{escape(t)}</t></si>" for t in table) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def monthly_book(month: int, rent: float = 1000.0, suites: dict[str, tuple] | None = None, expenses: bool = True) -> bytes:
    """Dashboard up to ``month`` and a lease sheet of {suite: (tenant, area, monthly rent)}."""
    dashboard: dict[tuple[int, int], object] = {(29, 8): "Collection Target"}
    for m in range(1, month + 1):
        col = V.FIRST_MONTH_COLUMN - 1 + m
        dashboard[29, col] = V.MONTH_NAMES[m - 1].title()
        for row, value in zip(V.LEDGER_METRIC_ROWS.values(), (rent + m, rent, m, 500, 24.5)):
            dashboard[row, col] = value
        if expenses:
            dashboard[40, col] = V.MONTH_NAMES[m - 1].title()
            dashboard[45, col] = 10 * m
    lease: dict[tuple[int, int], object] = {(4, i + 1): h for i, h in enumerate(V.LEASE_HEADERS)}
    for row, (suite, (tenant, area, monthly)) in enumerate((suites or {"1A": ("Acme", 100, 200)}).items(), start=5):
        for col, value in enumerate((suite, tenant, area, monthly, monthly * 12), start=1):
            lease[row, col] = value
    return workbook({"Dashboard (2025)": dashboard, "Lease Rate": lease})
