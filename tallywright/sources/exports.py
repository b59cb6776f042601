"""Reports from results: workbooks, HTML and an audit trail. Results are small; respondents stay in Spark."""

from __future__ import annotations

from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.sources import workbook

MAX_CELLS = 200_000


def _small(df: DataFrame) -> list:
    rows = df.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("a report has too many cells; export the table as Parquet")
    return rows


def banner_rows(table: DataFrame, title: str) -> list[list[object]]:
    """A crosstab as lines: columns, letters, three bases, then value, letters and benchmark of each row from line 12."""
    cells = sorted(_small(table), key=lambda r: (r.row_ord, r.col_ord))
    cols = sorted({(c.col_ord, c.col_label, c.letter, c.base_n, c.base_w, c.neff) for c in cells})
    out: list[list[object]] = [[title], [], ["", *[c[1] for c in cols]], ["", *[f"({c[2]})" if c[2] else "" for c in cols]], ["Base (unweighted)", *[c[3] for c in cols]], ["Base (weighted)", *[c[4] for c in cols]], ["Effective base", *[c[5] for c in cols]]]
    out += [[] for _ in range(11 - len(out))]
    for row in sorted({(c.row_ord, c.label) for c in cells}):
        line = {c.col_ord: c for c in cells if c.row_ord == row[0]}
        out.append([row[1], *[line[c[0]].value for c in cols]])
        out.append(["", *[line[c[0]].letters for c in cols]])
        out.append(["", *[line[c[0]].benchmark for c in cols]])
    return out


def banner_book(tables: dict[str, DataFrame], method: list[str]) -> bytes:
    """A methodology sheet, then a sheet per table."""
    names = workbook.sheet_names(list(tables))
    return workbook.write([("Methodology", [[m] for m in method]), *[(n, banner_rows(t, title)) for n, (title, t) in zip(names, tables.items())]])


def codeframe_book(frame: dict) -> bytes:
    """Nets, subnets and codes one below the other, as outline levels."""
    rows, levels, last = [["Code", "Label", "Keywords"]], [0], ("", "")
    for t in sorted(frame["topics"], key=lambda t: (t.get("net", ""), t.get("subnet", ""))):
        net, subnet = t.get("net", ""), t.get("subnet", "")
        if net != last[0]:
            rows.append(["", f"{net} (NET)", ""])
            levels.append(0)
        if (net, subnet) != last:
            rows.append(["", f"{subnet} (Subnet)", ""])
            levels.append(1)
        last = (net, subnet)
        for c in t["codes"].values():
            rows.append([c["code_id"], c["label"], ", ".join(t.get("keywords", ()))])
            levels.append(2)
    return workbook.write([("Codeframe", rows)], {"Codeframe": levels})


def hierarchy_book(table: DataFrame) -> bytes:
    """A hierarchy table with whole per cents, * below one half."""
    cells = _small(table)
    cols = sorted({c.banner for c in cells if c.banner is not None})
    keys = sorted({(c.net, c.subnet or "", c.leaf or "", c.level) for c in cells})
    value = {(c.net, c.subnet or "", c.leaf or "", c.banner): c for c in cells}
    show = lambda c: "" if c is None else "*" if c.n == 0 or c.pct < 0.5 else round(c.pct)
    rows = [["", "Total", *cols]] + [["  " * (k[3] - 1) + str(k[k[3] - 1]), show(value.get((*k[:3], None))), *[show(value.get((*k[:3], b))) for b in cols]] for k in keys]
    return workbook.write([("Hierarchy", rows)], {"Hierarchy": [0, *[k[3] - 1 for k in keys]]})


def html_table(df: DataFrame, title: str) -> str:
    """A result as an escaped HTML table."""
    rows = _small(df)
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else escape(str(v))
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


#: Looks of an A4 page.
STYLE = "body{font-family:sans-serif;max-width:210mm;margin:auto}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ccc}"


def report_html(sections: list[tuple[str, DataFrame]], title: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>' + "".join(html_table(d, t) for t, d in sections) + "</body></html>"


def frequency_tables(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """variable, category, n, percent, weighted count of categorical columns, in one pass."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in columns])
    t = df.select(w.alias("w"), F.explode(pairs).alias("p")).select("w", "p.*").filter("category is not null").groupBy("variable", "category").agg(F.count("*").alias("n"), F.sum("w").alias("weighted"))
    from pyspark.sql import Window

    return t.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("variable")))


def top_two_box(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """n and weighted share of 4 and above on a scale up to five; 97 to 99 are missing."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = F.col(column).cast("double")
    t = df.filter(x.isNotNull() & ~x.isin(97.0, 98.0, 99.0))
    return t.agg(F.count("*").alias("n"), (F.sum(F.when(x >= 4, w).otherwise(0.0)) / F.sum(w)).alias("share"))


@dataclass(frozen=True)
class Section:
    """A table of a report: its lines, the first being the head, and a line below them."""

    title: str
    rows: list[list[object]]
    note: str = ""


def section(df: DataFrame, title: str, note: str = "") -> Section:
    """A small result as a section, in its own order."""
    return Section(title, [list(df.columns), *[list(r) for r in _small(df)]], note)


def sections_book(sections: list[Section]) -> bytes:
    """A workbook with a sheet per section."""
    return workbook.write([(name, [[s.title], [], *s.rows, *([[], [s.note]] if s.note else [])]) for name, s in zip(workbook.sheet_names([s.title for s in sections]), sections)])


def sections_page(sections: list[Section], title: str) -> str:
    """The sections as one HTML page; everything in them is escaped."""
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else escape(str(v))
    line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{show(v)}</{tag}>" for v in r) + "</tr>"
    parts = [
        f"<h2>Table {i}. {escape(s.title)}</h2><table>{line(s.rows[0], 'th')}{''.join(line(r, 'td') for r in s.rows[1:])}</table>" + (f"<p><i>Note.</i> {escape(s.note)}</p>" if s.note else "")
        for i, s in enumerate(sections, 1)
    ]
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>' + "".join(parts) + "</body></html>"


def append_audit(log: DataFrame, path: str) -> None:
    """Add an audit log's rows to a Parquet table; readers see whole appends."""
    log.write.mode("append").parquet(path)
