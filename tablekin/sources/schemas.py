"""Schema documents: tables, links, keys and dictionary entries that a file declares."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.dictionary import format_values
from ..operators.links import Link
from ..operators.review import declared_link
from ..sinks.documents import EXTENSION

#: Types of schema documents.
TYPES = {"integer": "bigint", "int": "bigint", "bigint": "bigint", "numeric": "double", "number": "double", "float": "double", "double": "double", "decimal": "double", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "timestamp", "timestamp": "timestamp"}
JOIN = re.compile(r"^\s*([^.\s]+)\.([^=\s]+)\s*=\s*([^.\s]+)\.([^=\s]+)\s*$")


@dataclass
class Declared:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    links: list[Link] = field(default_factory=list)
    keys: dict[str, list[str]] = field(default_factory=dict)
    dictionary: dict[str, dict] = field(default_factory=dict)
    notices: list[str] = field(default_factory=list)


def _empty(spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(n, T._parse_datatype_string(TYPES.get(re.sub(r"\(.*", "", str(t or "")).lower(), "string"))) for n, t in columns]))


def _first(d: dict, *names: str):
    return next((d[n] for n in names if d.get(n) is not None), None)


def parse_schema(spark: SparkSession, text: str, name: str) -> Declared:
    """A schema of JSON or YAML, or a data-dict document. Errors are notices."""
    kind = PurePosixPath(name).suffix.lower()
    try:
        if kind == ".json":
            doc = json.loads(text)
        elif kind in (".yaml", ".yml"):
            import yaml

            doc = yaml.safe_load(text)
        else:
            return Declared(notices=[f"{name}: a schema is a .json or .yaml file"])
        if not isinstance(doc, dict):
            return Declared(notices=[f"{name}: no schema in it"])
        return parse_data_dict(spark, doc) if "$version" in doc else parse_plain(spark, doc)
    except Exception as e:  # a broken document must not stop others
        return Declared(notices=[f"{name}: {type(e).__name__}: {e}"])


def parse_plain(spark: SparkSession, doc: dict) -> Declared:
    """tables with columns (or fields), keys and foreign keys, and a list of relationships. Links without both tables are left out."""
    out = Declared()
    for t in doc.get("tables") or ():
        columns = [c for c in _first(t, "columns", "fields") or () if c.get("name")]
        name = t.get("name")
        if not name or not columns:
            continue
        out.tables[name] = _empty(spark, [(c["name"], c.get("type")) for c in columns])
        key = _first(t, "primary_key", "primary_keys")
        if key is None or isinstance(key, bool):
            key = [c["name"] for c in columns if c.get("primary_key") is True or c.get("pk") is True]
        if key:
            out.keys[name] = [key] if isinstance(key, str) else list(key)
        for c in columns:
            fk = c.get("foreign_key")
            if fk and fk.get("table"):
                out.links.append(declared_link(name, c["name"], fk["table"], fk.get("column")))
    for r in doc.get("relationships") or ():
        a, b = _first(r, "from_table", "from"), _first(r, "to_table", "to")
        if a and b:
            out.links.append(declared_link(a, _first(r, "from_column", "from_col") or "", b, _first(r, "to_column", "to_col")))
    return out


def parse_data_dict(spark: SparkSession, doc: dict) -> Declared:
    """Typed empty tables, texts, keys and joins; candidates written by an export come back as detected links."""
    out, skipped = Declared(), 0
    text = lambda v: "" if v is None else " ".join(map(str, v)) if isinstance(v, list) else str(v).strip()
    tables = [dict(t) for t in doc.get("tables") or ()]
    if len(tables) == 1:
        for f in ("label", "description", "details"):
            tables[0].setdefault(f, doc.get(f))

    def note(key: str, d: dict, column: bool = False) -> None:
        e = {f: text(d.get(f)) for f in ("label", "description", "details", *["units"] * column) if text(d.get(f))}
        if column and d.get("values") is not None:
            e["values"] = format_values(d["values"])
        if column and d.get("display") == "restricted":
            e |= {"private": True, "private_source": "import"}
        if e:
            out.dictionary[key] = e

    for t in tables:
        if not (name := t.get("name")):
            continue
        columns = [c for c in t.get("columns") or () if c.get("name")]
        note(name, t)
        for c in columns:
            note(f"{name}|{c['name']}", c, True)
        out.keys[name] = [c["name"] for c in columns if "primary_key" in (c.get("constraints") or ())]
        out.tables[name] = _empty(spark, [(c["name"], c.get("type")) for c in columns])
    for r in doc.get("relationships") or ():
        m = JOIN.match(text(r.get("join")))
        if not m:
            skipped += 1
            continue
        names = r.get("aliases") or {}
        left, right = (names.get(m[1], m[1]), m[2]), (names.get(m[3], m[3]), m[4])
        if r.get("cardinality") == "one-to-many":
            left, right = right, left
        out.links.append(declared_link(*left, *right, reason="declared in data-dict"))
    if skipped:
        out.notices.append(f"{skipped} join(s) left out: a join has to equate one column with another, as in a.x = b.y")
    carried = 0
    for block in (v for k, v in doc.items() if str(k).startswith("x-") and isinstance(v, dict)):
        for c in block.get("candidate_relationships") or ():
            if any(c.get(f) is None for f in ("from_table", "from_col", "to_table", "to_col")):
                continue
            carried += 1
            why = ["was a candidate when the document was written", *([text(c["evidence"])] if c.get("evidence") else [])]
            score = c.get("score")
            out.links.append(
                Link(*(text(c[f]) for f in ("from_table", "from_col", "to_table", "to_col")), text(c.get("detected_by") or "import"), text(c.get("confidence") or "low"), None if score is None else float(score), {}, tuple(why), origin=EXTENSION)
            )
    if carried:
        out.notices.append(f"{carried} link(s) of the document were candidates; they come back for review, not as declared")
    return out
