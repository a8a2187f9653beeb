"""Table files by extension. Spark reads what it can; workbooks and statistical files, which hold single tables of office size, are unpacked on the driver."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import clean_name
from ..operators.links import Link
from .access import read_access

BLANK = "\u0000blank"


@dataclass
class Loaded:
    """Tables of a file, links it declares, and what a reader has to say; errors are said here, never raised."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    links: list[Link] = field(default_factory=list)
    notices: list[str] = field(default_factory=list)


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field goes over lines: then, and only then, a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """Types are inferred over all rows; NA is null; in text columns an empty field is an empty text, not null.

    Files are split among tasks unless a quoted field goes over lines; `multi_line` says so if it is known.
    """
    whole = breaks_in_quotes(spark, path) if multi_line is None else multi_line
    how = spark.read.option("header", True).option("sep", sep).option("multiLine", whole).option("escape", '"')
    typed = how.option("inferSchema", True).option("nullValue", "NA").csv(path)
    if not any(isinstance(f.dataType, T.StringType) for f in typed.schema):
        return typed
    raw = how.option("nullValue", BLANK).option("emptyValue", "").csv(path)
    out = []
    for f in typed.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(F.coalesce(c, F.lit("")) != "NA", F.coalesce(c, F.lit(""))).alias(f.name))
        else:
            out.append(F.when(~F.trim(c).isin("", "NA"), c).try_cast(f.dataType).alias(f.name))
    return raw.select(*out)


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as dotted columns, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`").getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def read_json(spark: SparkSession, path: str, stem: str) -> dict[str, DataFrame]:
    """A list of objects is one table; an object whose members are all lists of objects is several."""
    raw = spark.read.option("multiLine", True).json(path)
    lists = [f for f in raw.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists and len(lists) == len(raw.columns) and len(raw.take(2)) == 1:
        return {f.name: flattened(raw.select(F.inline(F.col(f"`{f.name}`")))) for f in lists}
    if raw.columns == ["_corrupt_record"]:
        raise ValueError("no objects in it")
    return {stem: flattened(raw)}


# ---------------------------------------------------------------- workbooks

_XLSX = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_ODS = {"office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_sheets(path: str) -> dict[str, list[list[str | None]]]:
    """Cells of each sheet as text. Dates are those of cells in a date format."""
    from datetime import datetime, timedelta

    with zipfile.ZipFile(path) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{_XLSX}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        dates = set()
        if "xl/styles.xml" in z.namelist():
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(f"{_XLSX}numFmt")}
            for i, xf in enumerate(styles.find(f"{_XLSX}cellXfs") if styles.find(f"{_XLSX}cellXfs") is not None else ()):
                code = int(xf.get("numFmtId", 0))
                if 14 <= code <= 22 or 45 <= code <= 47 or re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, "")), re.I):
                    dates.add(i)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_XLSX}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_XLSX}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{_XLSX}c"):
                    at = _column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v, kind = c.find(f"{_XLSX}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_XLSX}t"))
                    elif v is None or v.text is None or kind == "e":
                        pass
                    elif kind == "s":
                        cells[at] = strings[int(v.text)]
                    elif kind == "b":
                        cells[at] = "true" if v.text == "1" else "false"
                    elif kind != "str" and int(c.get("s", 0)) in dates:
                        when = datetime(1899, 12, 30) + timedelta(days=float(v.text))
                        cells[at] = when.strftime("%Y-%m-%d" if when.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
                    else:
                        cells[at] = v.text
                rows.append(cells)
            out[sheet.get("name")] = rows
    return out


def ods_sheets(path: str) -> dict[str, list[list[str | None]]]:
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    q = lambda ns, n: f"{{{_ODS[ns]}}}{n}"
    out = {}
    for sheet in root.iter(q("table", "table")):
        rows = []
        for row in sheet.iter(q("table", "table-row")):
            cells: list[str | None] = []
            for c in row:
                if not c.tag.endswith("table-cell"):
                    continue
                value = c.get(q("office", "date-value")) or c.get(q("office", "boolean-value")) or c.get(q("office", "value"))
                text = "\n".join("".join(p.itertext()) for p in c.iter(q("text", "p")))
                cells += [value or text or None] * min(int(c.get(q("table", "number-columns-repeated"), 1)), 16_384)
            while cells and cells[-1] is None:
                cells.pop()
            rows += [cells] * min(int(row.get(q("table", "number-rows-repeated"), 1)), 1 if not cells else 1_048_576)
        out[sheet.get(q("table", "name"))] = rows
    return out


def guess_types(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Text columns as the narrowest of bigint, double, boolean, date and timestamp that fits all values, or the first rows.

    Also says how many values of each column don't fit a guess from the first rows, and so are lost.
    """
    kinds = ["bigint", "double", "boolean", "date", "timestamp_ntz"]
    text = lambda c: F.col(f"`{c}`")
    fits = lambda c, k: F.coalesce(F.every(F.coalesce(F.trim(text(c)) == "", F.lit(True)) | text(c).try_cast(k).isNotNull()), F.lit(True))
    head = df.limit(rows) if rows else df
    some = head.agg(*[F.struct(F.count(F.nullif(F.trim(text(c)), F.lit(""))).alias("n"), *[fits(c, k).alias(k) for k in kinds]).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    chosen = {}
    for i, c in enumerate(df.columns):
        if some[i]["n"]:
            chosen[c] = next((k for k in kinds if some[i][k]), None)
    chosen = {c: k for c, k in chosen.items() if k}
    lost = {}
    if rows and chosen:
        counts = df.agg(*[F.count_if(text(c).isNotNull() & (F.trim(text(c)) != "") & text(c).try_cast(k).isNull()).alias(c) for c, k in chosen.items()]).first()
        lost = {c: n for c, n in zip(chosen, counts, strict=True) if n}
    return df.select(*[text(c).try_cast(chosen[c]).alias(c) if c in chosen else text(c) for c in df.columns]), lost


def sheets_to_tables(spark: SparkSession, sheets: dict[str, list[list[str | None]]], stem: str, types: str, notices: list[str]) -> dict[str, DataFrame]:
    """A table for each sheet that has rows; named like the file if there is one, else file_sheet."""
    if types not in ("sample", "all", "text"):
        raise ValueError(f"unknown type policy {types!r}")
    full = {n: [r for r in rows if any(c not in (None, "") for c in r)] for n, rows in sheets.items()}
    full = {n: rows for n, rows in full.items() if len(rows) > 1}
    out = {}
    for sheet, rows in full.items():
        width = max(map(len, rows))
        names = [(c or f"...{i + 1}") for i, c in enumerate(rows[0] + [None] * (width - len(rows[0])))]
        names = [n if names.index(n) == i else f"{n}...{i + 1}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.createDataFrame([tuple(r + [None] * (width - len(r))) for r in rows[1:]], schema)
        name = stem if len(full) == 1 else f"{stem}_{clean_name(sheet)}"
        if types != "text":
            df, lost = guess_types(df, 1000 if types == "sample" else None)
            notices += [f"{name}.{c}: {n} values don't fit the type guessed from the first 1,000 rows" for c, n in lost.items()]
        out[name] = df
    return out


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path


def _pandas(reader: str):
    def read(spark: SparkSession, path: str, stem: str, **_) -> Loaded:
        import pandas as pd

        frame = getattr(pd, reader)(_local(path))
        for c in frame.columns:
            if frame[c].dtype == object:
                frame[c] = frame[c].map(lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else v)
        return Loaded({stem: spark.createDataFrame(frame)})

    return read


def _sheets(read: Callable):
    return lambda spark, path, stem, types="sample", **_: (lambda out: Loaded(sheets_to_tables(spark, read(_local(path)), stem, types, out.notices), notices=out.notices))(Loaded())


def _unsupported(what: str):
    return lambda spark, path, stem, **_: Loaded(notices=[f"{PurePosixPath(path).name}: {what} files can't be read here"])


READERS: dict[str, Callable[..., Loaded]] = {
    "csv": lambda spark, path, stem, multi_line=None, **_: Loaded({stem: read_delimited(spark, path, ",", multi_line)}),
    "tsv": lambda spark, path, stem, multi_line=None, **_: Loaded({stem: read_delimited(spark, path, "\t", multi_line)}),
    "txt": lambda spark, path, stem, multi_line=None, **_: Loaded({stem: read_delimited(spark, path, "\t", multi_line)}),
    "parquet": lambda spark, path, stem, **_: Loaded({stem: spark.read.parquet(path)}),
    "json": lambda spark, path, stem, **_: Loaded(read_json(spark, path, stem)),
    "ndjson": lambda spark, path, stem, **_: Loaded({stem: flattened(spark.read.json(path))}),
    "jsonl": lambda spark, path, stem, **_: Loaded({stem: flattened(spark.read.json(path))}),
    "xlsx": _sheets(xlsx_sheets),
    "xlsm": _sheets(xlsx_sheets),
    "ods": _sheets(ods_sheets),
    "dta": _pandas("read_stata"),
    "sas7bdat": _pandas("read_sas"),
    "xpt": _pandas("read_sas"),
    "mdb": lambda spark, path, stem, **how: Loaded(*read_access(spark, path, **how)),
    "accdb": lambda spark, path, stem, **how: Loaded(*read_access(spark, path, **how)),
    "xls": _unsupported("old binary workbook"),
    "sav": _unsupported("SPSS"),
    "por": _unsupported("SPSS"),
    "rds": _unsupported("R"),
    "rdata": _unsupported("R"),
    "rda": _unsupported("R"),
}


def read_tables(spark: SparkSession, path: str, name: str | None = None, **how) -> Loaded:
    """The tables of a file by its extension. `types` (sample, all, text) is how workbooks are typed; `multi_line` says
    whether quoted fields of delimited files go over lines."""
    from ..sinks.documents import own_export

    place = PurePosixPath(name or path)
    reader = READERS.get(place.suffix.lower().lstrip("."))
    if reader is None:
        return Loaded(notices=[f"{place.name}: unknown extension {place.suffix!r}"])
    try:
        out = reader(spark, path, place.stem, **how)
    except Exception as e:  # a file that can't be read must not stop others
        return Loaded(notices=[f"{place.name}: {type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"])
    for t, df in list(out.tables.items()):
        if kind := own_export(df):
            out.notices.append(f"{place.name}: this is an exported {kind}, not data")
            del out.tables[t]
    return out

