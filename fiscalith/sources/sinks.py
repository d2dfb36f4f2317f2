"""Writers: Parquet, CSV, JSON, partitioned tables, and a workbook for reports of bounded size."""

from __future__ import annotations

import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one sheet of a workbook.
SHEET_ROWS = 1_048_575


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", one_file: bool = False) -> str:
    """Writes ``df`` as parquet, csv (with header) or json. ``one_file`` is for exports that one task can write."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = (df.coalesce(1) if one_file else df).write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    return path


def save_by(df: DataFrame, path: str, columns: Sequence[str]) -> str:
    """A partitioned Parquet table; only the partitions that ``df`` has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
    return path


def append(df: DataFrame, path: str) -> str:
    df.write.mode("append").parquet(path)
    return path


def as_nested_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON text per ``key`` with its rows in order; for hierarchies whose groups are small by nature."""
    rest = [c for c in df.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct(*rest)))
    return df.groupBy(key).agg(F.to_json(rows).alias("json"))


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value: object, style: int) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b" s="{style}"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _style_of(column: str) -> int:
    return 2 if "pct" in column or "%" in column else 1 if column.isdigit() or "_$" in column or column.endswith("_m") else 0


def _sheet(rows: list[tuple], columns: Sequence[str], sparklines: bool) -> str:
    years = [i for i, c in enumerate(columns) if c.isdigit() or "_$" in c]
    widths = [min(60, max([len(c), *(len(str(r[i])) for r in rows[:1000])]) + 2) for i, c in enumerate(columns)]
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    head = "".join(_cell(f"{_letters(i)}1", c, 3) for i, c in enumerate(columns))
    body = "".join(
        f'<row r="{n}">' + "".join(_cell(f"{_letters(i)}{n}", v, _style_of(columns[i])) for i, v in enumerate(r)) + "</row>"
        for n, r in enumerate(rows, 2)
    )
    last = len(rows) + 1
    rules = "".join(
        f'<conditionalFormatting sqref="{_letters(i)}2:{_letters(i)}{last}"><cfRule type="cellIs" dxfId="0" priority="{i + 1}" operator="lessThan">'
        f"<formula>0</formula></cfRule></conditionalFormatting>"
        for i, c in enumerate(columns)
        if _style_of(c)
    )
    extra = ""
    if sparklines and years and rows:
        a, b, at = _letters(years[0]), _letters(years[-1]), _letters(len(columns))
        lines = "".join(f"<x14:sparkline><xm:f>'S'!{a}{n}:{b}{n}</xm:f><xm:sqref>{at}{n}</xm:sqref></x14:sparkline>" for n in range(2, last + 1))
        extra = (
            '<extLst><ext uri="{05C60535-1F16-4fd2-B633-F4F36F0B64E0}" xmlns:x14="http://schemas.microsoft.com/office/spreadsheetml/2009/9/main">'
            '<x14:sparklineGroups xmlns:xm="http://schemas.microsoft.com/office/excel/2006/main"><x14:sparklineGroup type="column">'
            f"<x14:sparklines>{lines}</x14:sparklines></x14:sparklineGroup></x14:sparklineGroups></ext></extLst>"
        )
    return (
        '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        f"<cols>{cols}</cols><sheetData><row r=\"1\">{head}</row>{body}</sheetData>{rules}{extra}</worksheet>"
    )


_STYLES = (
    '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<numFmts count="2"><numFmt numFmtId="164" formatCode="&quot;$&quot;#,##0"/><numFmt numFmtId="165" formatCode="0.0&quot;%&quot;"/></numFmts>'
    "<fonts count=\"2\"><font/><font><b/></font></fonts><fills count=\"1\"><fill/></fills><borders count=\"1\"><border/></borders>"
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf numFmtId="164" applyNumberFormat="1"/>'
    '<xf numFmtId="165" applyNumberFormat="1"/><xf fontId="1" applyFont="1"/></cellXfs>'
    '<dxfs count="1"><dxf><font><color rgb="FFFF0000"/></font></dxf></dxfs></styleSheet>'
)


def write_workbook(sheets: Mapping[str, DataFrame], path: str, sparklines: bool = True) -> str:
    """A workbook with a sheet per frame: bold header, money and percent formats, negatives in red, fitted widths, column
    sparklines over the years. A report is for people: a frame with more rows than a sheet can hold is refused, not cut."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
            + "".join(
                f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                for i in range(1, len(names) + 1)
            )
            + "</Types>",
        )
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr(
            "_rels/.rels",
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            + "".join(f'<Relationship Id="rId{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            + f'<Relationship Id="rId{len(names) + 1}" Type="{relation}/styles" Target="styles.xml"/></Relationships>',
        )
        z.writestr(
            "xl/workbook.xml",
            f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{relation}"><sheets>'
            + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
            + "</sheets></workbook>",
        )
        z.writestr("xl/styles.xml", _STYLES)
        for i, name in enumerate(names, 1):
            df = sheets[name]
            rows = [tuple(r) for r in df.limit(SHEET_ROWS + 1).collect()]
            if len(rows) > SHEET_ROWS:
                raise ValueError(f"{name} has more rows than a sheet holds; write it with save()")
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows, df.columns, sparklines).replace("'S'!", f"'{escape(name[:31])}'!"))
    return path
