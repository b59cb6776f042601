"""XLSX workbooks with the standard library alone: reading, sniffing, banner sheets, writing."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
COVER = re.compile(r"cover|index|contents?|toc|notes?|read.?me|instructions?|legend|method", re.I)
BASE = re.compile(r"base|unweighted|weighted|effective|kish|n\s*=|count", re.I)
SIGNIFICANCE = re.compile(r"^\s*(?:[A-Za-z](?:\s+[A-Za-z])*|\+{1,2}|-{1,2}|–)?\s*$")


class Workbook:
    """Cells of a workbook, read sheet by sheet on demand."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))
            self.strings = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in root.findall(f"{NS}si")]
        self.percent: list[bool] = []
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            codes = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(f"{NS}numFmt")}
            cells = root.find(f"{NS}cellXfs")
            self.percent = [x.get("numFmtId") in ("9", "10") or "%" in codes.get(x.get("numFmtId"), "") for x in (cells if cells is not None else [])]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): "xl/" + links[s.get(REL)].lstrip("/").removeprefix("xl/") for s in book.iter(f"{NS}sheet")}

    def rows(self, sheet: str, most: int | None = None):
        """Lists of (value, is percent); numbers as text without a needless fraction."""
        at = 0
        for _, e in ElementTree.iterparse(self.zip.open(self.sheets[sheet])):
            if e.tag != f"{NS}row":
                continue
            number = int(e.get("r", at + 1))
            while at + 1 < number and (most is None or at < most):
                at += 1
                yield []
            row: list[tuple[str | None, bool]] = []
            for c in e.findall(f"{NS}c"):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                if ref:
                    place = 0
                    for ch in ref[0]:
                        place = place * 26 + ord(ch) - 64
                    row += [(None, False)] * (place - 1 - len(row))
                v, kind = c.find(f"{NS}v"), c.get("t")
                if kind == "s" and v is not None:
                    value = self.strings[int(v.text)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                else:
                    value = v.text if v is not None else None
                    if value is not None and kind in (None, "n") and re.fullmatch(r"-?\d+\.0+", value):
                        value = value.split(".")[0]
                style = int(c.get("s", 0))
                row.append((value if value not in (None, "") else None, style < len(self.percent) and self.percent[style]))
            at += 1
            e.clear()
            yield row
            if most is not None and at >= most:
                return


def find_table(book: Workbook) -> tuple[str, int, bool]:
    """Sheet, header row (from 0) and whether it is already tabulated.

    Sheets named like covers come last. A "Total" cell among the first 25 rows with a base row close below
    marks a banner sheet; else the header is the first row of distinct texts over half the widest row.
    """
    ordered = sorted(book.sheets, key=lambda s: bool(COVER.search(s)))
    for sheet in ordered:
        rows = list(book.rows(sheet, 30))
        for i, row in enumerate(rows[:25]):
            if any((v or "").strip().lower() == "total" for v, _ in row) and any(BASE.search(r[0][0] or "") for r in rows[i + 1 : i + 6] if r):
                return sheet, i, True
        width = max((sum(v is not None for v, _ in r) for r in rows[:10]), default=0)
        for i, row in enumerate(rows[:10]):
            texts = [v.strip() for v, _ in row if v]
            if texts and len(texts) * 2 >= width and len(set(texts)) == len(texts) and not any(re.fullmatch(r"-?[\d.,]+", t) for t in texts):
                return sheet, i, False
    return ordered[0], 0, False


def sheet_frame(spark: SparkSession, book: Workbook, sheet: str, header: int = 0) -> DataFrame:
    """A sheet below its header as text columns; unnamed and repeated headers get numbers."""
    rows = list(book.rows(sheet))
    names: list[str] = []
    for i, (v, _) in enumerate(rows[header] if len(rows) > header else []):
        name = (v or f"column_{i + 1}").strip()
        names.append(name if name not in names else f"{name}_{i + 1}")
    body = [tuple([v for v, _ in r][: len(names)] + [None] * (len(names) - len(r))) for r in rows[header + 1 :] if any(v for v, _ in r)]
    return spark.createDataFrame(body, ", ".join(f"`{n.replace('`', '``')}` string" for n in names) or "column_1 string")


def parse_count(value: str | None) -> float | None:
    """A base cell: ``1,075`` or ``(n=1,075)``."""
    m = re.fullmatch(r"\s*\(?\s*(?:[nN]\s*=\s*)?([\d,  ]+(?:\.\d+)?)\s*\)?\s*", value or "")
    digits = re.sub(r"[,\s ]", "", m[1]) if m else ""
    return float(digits) if digits else None


#: Words in the stub of a significance row, as fixed values.
COMPARISONS = ("col comparison", "letters", "benchmark", "vs. total", "sig")


def is_significance_row(stub: str | None, cells: list[str | None]) -> bool:
    """Letters and signs only, under a row with values; its stub is empty or says what they are.

    Cells without a letter or plus are empty ones of a data row, unless all are signs.
    """
    named = (stub or "").strip().lower()
    if named and not any(word in named for word in COMPARISONS):
        return False
    return any(cells) and all(SIGNIFICANCE.match(c or "") for c in cells)


def banner_sheet(spark: SparkSession, book: Workbook, sheet: str, header: int) -> DataFrame:
    """A tabulated sheet in the long form of a crosstab; unknown bases stay null.

    Values count as shares only if their number format has a per cent sign.
    """
    rows = list(book.rows(sheet))
    heads = [v for v, _ in rows[header]]
    first = next(i for i, v in enumerate(heads) if (v or "").strip().lower() == "total")
    columns = [(i, heads[i]) for i in range(first, len(heads)) if heads[i]]
    bases: dict[str, list[float | None]] = {"base_n": [None] * len(columns), "base_w": [None] * len(columns), "neff": [None] * len(columns)}
    letters, out, last = [""] * len(columns), [], None
    for row in rows[header + 1 :]:
        if not any(v for v, _ in row):
            continue
        cell = lambda i, row=row: row[i] if i < len(row) else (None, False)
        stub, values = cell(0)[0] if first > 0 else None, [cell(i)[0] for i, _ in columns]
        name = (stub or "").lower()
        counts = [parse_count(v) for v in values]
        if last is None and BASE.search(name) and any(c is not None for c in counts):
            kind = "neff" if re.search("effective|kish", name) else "base_w" if "weighted" in name and "unweighted" not in name else "base_n"
            bases[kind] = counts
        elif last is None and not any(letters) and all(re.fullmatch(r"\s*\(?[A-Z]{1,2}\)?\s*", v or "") or not v for v in values) and any(values):
            letters = [re.sub(r"[^A-Z]", "", v or "") for v in values]
        elif last is not None and is_significance_row(stub, values):
            for k, v in enumerate(values):
                out[last + k][8 if re.search("[A-Za-z]", v or "") else 9] = (v or "").strip()
        else:
            last = len(out)
            for k, (i, head) in enumerate(columns):
                text, share = cell(i)
                try:
                    number = float((text or "").rstrip("%").replace(",", "")) if text else None
                except ValueError:
                    number = None
                out.append([len(out) // len(columns), stub or "(no label)", k, head, letters[k], bases["base_n"][k], bases["base_w"][k], bases["neff"][k], "", "", number, bool(share or (text or "").endswith("%"))])
    schema = "row_ord int, label string, col_ord int, col_label string, letter string, base_n double, base_w double, neff double, letters string, benchmark string, value double, is_share boolean"
    return spark.createDataFrame([tuple(r) for r in out], schema)


# --- writing -------------------------------------------------------------------


def guarded(value: object) -> object:
    """Text that a spreadsheet would run as a formula gets an apostrophe; the signs + ++ - -- stay."""
    if isinstance(value, str) and value not in ("+", "++", "-", "--") and value.lstrip(" ")[:1] in ("=", "+", "-", "@", "\t", "\r"):
        return "'" + value
    return value


def sheet_names(titles: list[str]) -> list[str]:
    """Numbered, without forbidden characters, at most 31 long and unique."""
    out: list[str] = []
    for i, t in enumerate(titles, 1):
        base = re.sub(r"[\[\]:*?/\\']", " ", f"T{i}_{t}").strip()[:31]
        name, k = base, 2
        while name.lower() in {o.lower() for o in out}:
            name, k = f"{base[: 30 - len(str(k))]}~{k}", k + 1
        out.append(name)
    return out


def _cell(r: int, c: int, value: object) -> str:
    column, n = "", c
    while n:
        n, d = divmod(n - 1, 26)
        column = chr(65 + d) + column
    if value is None or value != value:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(guarded(value) if isinstance(value, str) else value))
        return f'<c r="{column}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f'<c r="{column}{r}"><v>{value!r}</v></c>'


def write(sheets: list[tuple[str, list[list[object]]]], levels: dict[str, list[int]] | None = None) -> bytes:
    """A workbook of (name, rows); ``levels`` gives outline levels of a sheet's rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (name, rows) in enumerate(sheets, 1):
            depth = (levels or {}).get(name, [])
            body = "".join(f'<row r="{r}"' + (f' outlineLevel="{depth[r - 1]}"' if r <= len(depth) and depth[r - 1] else "") + ">" + "".join(_cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
