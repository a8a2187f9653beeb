"""Dictionary, privacy, exports, readers, schema documents, databases, sessions and streams."""

import json
import math
import zipfile
from dataclasses import replace

import pandas as pd
import pytest
import yaml

from tablekin.operators.dictionary import build_dictionary, edit, filter_entries, format_values, markdown, merge_dictionary, number_text, parse_values
from tablekin.operators.erd import erd_model
from tablekin.operators.keys import Keys
from tablekin.operators.links import Link
from tablekin.operators.privacy import privacy_of, record_review, reset_decisions, review_queue, set_public
from tablekin.operators.profile import scan
from tablekin.operators.review import Review, declared_link
from tablekin.plans.discovery import discover
from tablekin.sinks.diagrams import dbml, elk_graph, mermaid, network_frames
from tablekin.sinks.documents import data_dict, data_dict_yaml, dbt_yaml, dictionary_csv, links_csv, own_export, renames_csv, table_details_csv
from tablekin.sinks.session import Session, load_session, restore_into, save_session
from tablekin.sources.access import access_links
from tablekin.sources.files import guess_types, read_tables
from tablekin.sources.jdbc import Database, introspect, keys_query, links_query, load_tables, row_limit_query, tables_query
from tablekin.sources.schemas import parse_schema
from tablekin.streaming.rescan import LiveDiscovery


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def books(spark):
    """customers, orders and staff, with declared and detected links."""
    tables = {
        "customers": frame(spark, "customer_id int, email string, tier string", [(1, "a@x.io", "gold"), (2, "b@x.io", "silver"), (3, None, "gold"), (4, "d@x.io", "bronze")]),
        "orders": frame(spark, "order_id int, customer_id int, amount double", [(i, c, a) for i, c, a in zip(range(1, 7), [1, 2, 1, None, 3, 4], [10.5, 20.0, 30.0, 15.5, 1.0, 2.0], strict=True)]),
        "staff": frame(spark, "staff_id int, manager_id int", [(1, None), (2, 1), (3, 1)]),
    }
    links = [
        declared_link("orders", "customer_id", "customers", "customer_id"),
        Link("staff", "manager_id", "staff", "staff_id", "manual", "high", 1.0),
        Link("orders", "order_id", "staff", "staff_id", "naming", "medium", 0.7),
    ]
    return tables, scan(tables), links, Keys({"customers": ["customer_id"], "orders": ["order_id"], "staff": ["staff_id"]})


def test_dictionary(spark, books):
    entries, _ = build_dictionary(*books)
    d = {(e.table, e.column): e for e in entries}
    assert [(e.table, e.column) for e in entries][:3] == [("customers", c) for c in ("customer_id", "email", "tier")]
    o = d["orders", "customer_id"]
    assert (o.keys, o.references, o.reference_source, o.nullable, o.pct_missing, o.n_unique) == ("FK2", "customers.customer_id", "declared", True, 16.7, 4)
    assert d["customers", "tier"].examples == "bronze, gold, silver" and d["orders", "amount"].examples.replace(".0", "") == "1, 2, 15.5, 20, 30"
    e = d["customers", "email"]
    assert (e.examples, e.examples_note, e.privacy_status, e.format) == ("", "private", "auto_unreviewed", "email address") and (e.len_min, e.len_median, e.len_max) == (6, 6, 6)
    a = d["orders", "amount"]
    assert (a.min, a.median, a.max, a.format) == ("1", "13", "30", "decimal") and d["orders", "order_id"].keys == "PK, FK1"
    off, _ = build_dictionary(*books, {".settings": {"examples": "off"}})
    assert {x.examples_note for x in off} == {"examples off", "private"}


def test_private_ranges_are_hidden(spark, books):
    entries, _ = build_dictionary(*books, {"orders|amount": {"private": True}})
    (a,) = [e for e in entries if e.column == "amount"]
    assert (a.min, a.median, a.max, a.examples) == ("hidden", "hidden", "hidden", "") and a in filter_entries(entries, "orders", "private")


def test_markdown_and_edits(books):
    d = edit(edit({}, "customers", description="People | buyers"), "customers|tier", label="Tier", values="gold = Gold", units="x")
    text = markdown(build_dictionary(*books, d)[0])
    assert "People \\| buyers" in text and "| `tier` | Tier |" in text and "- `tier`: units: x; values: gold = Gold" in text and "`customer_id` → `customers.customer_id` (declared)" in text
    assert edit(d, "customers|tier", label="", values=None, units="") == {"customers": {"description": "People | buyers"}} and "_No tables loaded._" in markdown([])


@pytest.mark.parametrize(("x", "text"), [(1234567.0, "1234570"), (0.000123456789, "0.000123457"), (13.0, "13"), (1e21, "1000000000000000000000"), (-2.50, "-2.5")])
def test_number_text(x, text):
    assert number_text(x) == text


def test_allowed_values():
    assert parse_values("A = Active; I = Inactive; A = x") == {"A": "Active", "I": "Inactive"} and parse_values("A; B") == ["A", "B"] and parse_values(" ; ") is None
    assert format_values({"A": "Active"}) == "A = Active" and format_values(["A", "B"]) == "A; B" and format_values(None) == ""


def test_privacy_decisions(spark, books):
    _, known, _, _ = books
    p = known.profiles["customers", "email"]
    assert privacy_of(p, {}).needs_review and review_queue(known, {}) == [("customers", "email", 'name contains "email"', 3)]
    rejected = record_review({}, known, [("customers", "email")], "rejected")
    assert privacy_of(p, rejected).status == "not_personal" and privacy_of(p, record_review({}, known, [("customers", "email")], "confirmed")).status == "confirmed"
    assert privacy_of(replace(p, content="other"), rejected).status == "auto_unreviewed"
    public = set_public({}, known, "customers", "email")
    assert privacy_of(p, public).status == "user_public" and privacy_of(replace(p, n_rows=9), public).private
    assert privacy_of(p, {"customers|email": {"private": True}}).status == "user_private" and privacy_of(p, {"customers|email": {"private": True, "private_source": "import"}}).status == "imported"
    assert privacy_of(known.profiles["orders", "amount"], {".settings": {"private_patterns": "orders.am*"}}).status == "pattern"
    assert reset_decisions(rejected | public | {"orders|amount": {"label": "x"}}) == {"orders|amount": {"label": "x"}}


def test_private_values(spark):
    t = frame(spark, "a string, b string, c string, d boolean", [(f"u{i}@x.org", f"555-123-{1000 + i}", f"{100 + i}-12-3456", True) for i in range(10)])
    known = scan({"t": t})
    assert [known.profiles["t", c].private for c in "abcd"] == ["100% of values look like email addresses", "100% of values look like phone numbers", "100% of values look like social security numbers", None]


def test_merging_dictionaries():
    new = {"Customers|Tier": {"label": "Theirs", "values": "A"}, "customers|email": {"private": True, "private_source": "import"}}
    out = merge_dictionary({"customers|tier": {"label": "Mine"}, "customers|email": {"private": False}}, new)
    assert out["customers|tier"] == {"label": "Mine", "values": "A"} and out["customers|email"]["private"] is False


@pytest.fixture(scope="module")
def export(spark):
    tables = {
        "customers": frame(spark, "customer_id int, email string", [(1, "a"), (2, "b"), (3, "c")]),
        "orders": frame(spark, "order_id int, customer_id int", [(1, 1), (2, None), (3, 2), (4, 3)]),
        "customer_profile": frame(spark, "customer_id int, bio string", [(1, "x"), (2, "y"), (3, "z")]),
        "order_items": frame(spark, "order_id int, product_id int", [(1, 1), (1, 2), (2, 1)]),
        "products": frame(spark, "product_id int, sku string", [(1, "A"), (2, "B")]),
    }
    k = lambda a, b, c, d, by="naming", yes=False: Link(a, b, c, d, by, "high", 0.87, confirmed=yes, reasons=("exact FK naming",))
    links = [
        k("orders", "customer_id", "customers", "customer_id"), k("customer_profile", "customer_id", "customers", "customer_id", "schema"),
        k("order_items", "order_id", "orders", "order_id", yes=True), k("order_items", "product_id", "products", "product_id", yes=True),
    ]
    keys = Keys({"customers": ["customer_id"], "orders": ["order_id"], "customer_profile": ["customer_id"], "products": ["product_id"]}, {"order_items": [["order_id", "product_id"]]})
    return scan(tables), links, keys


def test_mermaid(export):
    text = mermaid(erd_model(*export))
    for part in (
        'customers |o--o{ orders : "customer_id → customer_id (inferred 87%)"', 'customers ||--o| customer_profile : "customer_id → customer_id"', "orders ||--o{ order_items",
        'int customer_id FK "nullable"', "int order_id PK, FK", "direction LR",
    ):
        assert part in text
    known, links, keys = export
    assert mermaid(erd_model(known, links[::-1], keys)) == text


def test_dbml(export):
    text = dbml(erd_model(*export), {"customers": {"description": "it's\\"}})
    for part in ("Table customers [headerColor:", "customer_id int [pk, not null]", "Ref: orders.customer_id > customers.customer_id [color: #94a3b8]", "Ref: customer_profile.customer_id - customers.customer_id", "(order_id, product_id) [pk]", "TableGroup orders {", "it\\'s\\\\"):
        assert part in text


def test_elk(export):
    g = elk_graph(erd_model(*export))
    assert g["layoutOptions"]["elk.edgeRouting"] == "ORTHOGONAL" and len(g["children"]) == 5 and len(g["edges"]) == 4
    node = {n["id"]: n for n in g["children"]}
    assert {p["id"] for p in node["orders"]["ports"]} == {"orders.customer_id:out", "orders.order_id:in"}
    for n in g["children"]:
        names = [c["name"] for c in n["properties"]["columns"]]
        for p in n["ports"]:
            i = names.index(p["id"].split(":")[0].split(".", 1)[1])
            assert p["y"] == 28 + (i + 0.5) * 20 and p["x"] == (n["width"] if p["id"].endswith("out") else 0)
    ends = {x for e in g["edges"] for x in e["sources"] + e["targets"]}
    assert ends == {p["id"] for n in g["children"] for p in n["ports"]}
    (e,) = [e for e in g["edges"] if e["sources"] == ["orders.customer_id:out"]]
    assert e["properties"]["parentMin"] == "zero" and e["properties"]["provenance"] == "inferred"
    labelled = elk_graph(erd_model(*export), ref_labels=True, side=True)
    assert len(labelled["edges"]) < 4 and any(n["properties"].get("side") == "lookups" for n in labelled["children"])


def test_dbt(export):
    known, links, keys = export
    doc = yaml.safe_load(dbt_yaml(known, links, keys, erd_model(*export), {"customers": {"description": 'say "x"'}}))
    models = {m["name"]: m for m in doc["models"]}
    assert models["customers"]["description"] == 'say "x"' and models["customers"]["config"]["contract"]["enforced"]
    c = {x["name"]: x for x in models["order_items"]["columns"]}
    assert c["order_id"]["tests"] == ["not_null", {"relationships": {"to": "ref('orders')", "field": "order_id"}}]
    assert {"type": "foreign_key", "to": "ref('orders')", "to_columns": ["order_id"]} in c["order_id"]["constraints"]
    assert models["order_items"]["tests"] == [{"dbt_utils.unique_combination_of_columns": {"combination_of_columns": ["order_id", "product_id"]}}]
    orders = {x["name"]: x for x in models["orders"]["columns"]}
    assert "constraints" not in orders["customer_id"] and orders["order_id"]["tests"] == ["unique", "not_null"]
    assert "constraints" not in dbt_yaml(known, links, keys)


def test_csv_files(spark, export, tmp_path):
    known, links, keys = export
    for text, kind in ((links_csv(links), "relationships list"), (table_details_csv(known, links, keys), "table details")):
        (tmp_path / "x.csv").write_text(text)
        assert own_export(spark.read.option("header", True).csv(f"file://{tmp_path}/x.csv")) == kind
        assert read_tables(spark, f"file://{tmp_path}/x.csv").tables == {}
    assert "orders,customer_id,customers,customer_id,detected,naming,high,0.87,,exact FK naming,unreviewed" in links_csv(links)
    assert "from_table" in links_csv([replace(links[0], to_col=None)]) and renames_csv([("table", "f", "A", "a")]).splitlines()[1] == "table,f,A,a"
    nodes, edges = network_frames(spark, known, links, keys)
    assert nodes.count() == 5 and edges.count() == 4


def test_data_dict(spark, books):
    edits = {"customers": {"description": "People", "label": "Customers"}, "customers|tier": {"label": "Tier", "values": "gold = Gold; silver = Silver"}, "orders|amount": {"units": "GBP"}, "staff|manager_id": {"values": "1 = x"}}
    entries, model = build_dictionary(*books, edits)
    text = data_dict_yaml(entries, model, edits)
    doc = yaml.safe_load(text)
    assert doc["$version"] == "0.1.0" and [t["name"] for t in doc["tables"]] == ["customers", "orders", "staff"] and doc["tables"][0]["label"] == "Customers"
    c = {x["name"]: x for t in doc["tables"] for x in t["columns"]}
    assert c["tier"]["type"] == "enum" and c["tier"]["values"] == {"gold": "Gold", "silver": "Silver"} and "examples" not in c["tier"]
    assert c["email"]["display"] == "restricted" and c["email"]["examples"] == ["person@example.com"] and "a@x.io" not in text
    assert (c["amount"]["type"], c["amount"]["units"], c["amount"]["range"]) == ("number(quantity)", "GBP", [1.0, 30.0]) and "Allowed values: 1 = x" in c["manager_id"]["details"]
    assert [r["join"] for r in doc["relationships"]] == ["orders.customer_id = customers.customer_id", "child.manager_id = parent.staff_id"]
    assert doc["relationships"][1]["aliases"] == {"child": "staff", "parent": "staff"} and "orders.order_id = staff.staff_id (medium confidence)" in doc["todo"]
    back = parse_schema(spark, text, "data-dict.yaml")
    assert list(back.tables) == ["customers", "orders", "staff"], back.notices
    assert back.tables["orders"].columns == ["order_id", "customer_id", "amount"]
    assert [k.provenance for k in back.links] == ["declared", "declared", "detected"] and back.keys["customers"] == ["customer_id"]
    assert back.dictionary["customers|tier"]["values"] == "gold = Gold; silver = Silver" and back.dictionary["customers|email"]["private"] is True


def test_private_range_is_open(spark):
    known = scan(t := {"p": frame(spark, "id int, weight int", [(1, 50), (2, 60), (3, 60)])})
    d = {"p|weight": {"units": "kg", "private": True}}
    doc = data_dict(*build_dictionary(t, known, [], Keys({"p": ["id"]}), d), d)
    (w,) = [c for c in doc["tables"][0]["columns"] if c["name"] == "weight"]
    assert [math.isinf(x) for x in w["range"]] == [True, True] and dictionary_csv([]).startswith("table,")


def test_schema_documents(spark):
    doc = {
        "tables": [
            {"name": "customers", "columns": [{"name": "customer_id", "type": "integer", "primary_key": True}]},
            {"name": "orders", "fields": [{"name": "order_id", "pk": True}, {"name": "customer_id", "foreign_key": {"table": "customers", "column": "customer_id"}}]},
        ],
        "relationships": [{"from": "orders", "from_col": "x_id", "to_table": "xs", "to_col": "id"}, {"from": "orders"}],
    }
    for text, name in ((json.dumps(doc), "s.json"), (yaml.safe_dump(doc), "s.yaml")):
        got = parse_schema(spark, text, name)
        assert {k.key for k in got.links} == {"orders|customer_id|customers|customer_id", "orders|x_id|xs|id"} and got.keys == {"customers": ["customer_id"], "orders": ["order_id"]}
        assert got.tables["customers"].schema["customer_id"].dataType.simpleString() == "bigint"
    assert parse_schema(spark, "{", "s.json").notices and parse_schema(spark, "", "s.txt").notices and parse_schema(spark, "[]", "s.json").notices
    joined = parse_schema(spark, '{"$version": "0.1.0", "tables": [], "relationships": [{"join": "a.x = b.y", "cardinality": "one-to-many"}, {"join": "f(a) = b"}]}', "d.json")
    assert joined.links[0].key == "b|y|a|x" and "1 join" in joined.notices[0]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,note\n1,"x, y",\n2,NA,""\n3,z,"line\nbreak"\n')
    (tmp_path / "b.tsv").write_text("id\tv\n1\t2.5\n")
    (tmp_path / "c.txt").write_text("id\tv\n1\tx\n")
    (tmp_path / "d.json").write_text('[{"id": 1, "p": {"q": {"r": 2}}}, {"id": 2, "p": null}]')
    (tmp_path / "e.json").write_text('{"one": [{"id": 1}], "two": [{"k": "a"}, {"k": "b"}]}')
    (tmp_path / "f.ndjson").write_text('{"id": 1}\n{"id": 2}\n')
    spark.range(4).write.parquet(f"file://{tmp_path}/g.parquet")
    got = {x: read_tables(spark, f"file://{tmp_path}/{x}") for x in ("a.csv", "b.tsv", "c.txt", "d.json", "e.json", "f.ndjson", "g.parquet", "h.csv", "i.rds", "j.abc", "k.xls", "l.mdb")}
    rows = [tuple(r) for r in got["a.csv"].tables["a"].orderBy("id").collect()]
    assert rows == [(1, "x, y", ""), (2, None, ""), (3, "z", "line\nbreak")]
    assert got["b.tsv"].tables["b"].first().v == 2.5 and got["c.txt"].tables["c"].first().v == "x"
    assert got["d.json"].tables["d"].columns == ["id", "p.q.r"] and {t: d.count() for t, d in got["e.json"].tables.items()} == {"one": 1, "two": 2}
    assert got["f.ndjson"].tables["f"].count() == 2 and got["g.parquet"].tables["g"].count() == 4
    assert all(got[x].notices and not got[x].tables for x in ("h.csv", "i.rds", "j.abc", "k.xls", "l.mdb"))


def sheet_xml(rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i + 1}"{" s=\"1\"" if isinstance(v, complex) else ""}><v>{int(v.real) if isinstance(v, complex) else v}</v></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def write_xlsx(path, sheets):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", sheet_xml(rows))


def test_workbooks(spark, tmp_path):
    write_xlsx(tmp_path / "book.xlsx", {"My Sheet": [["id", "day", "v"], [1, 45000 + 0j, 1.5], [2, 45001 + 0j, None]], "Empty": [["a"]], "Other": [["k"], ["x"]]})
    got = read_tables(spark, f"file://{tmp_path}/book.xlsx", types="all")
    assert set(got.tables) == {"book_my_sheet", "book_other"}
    t = got.tables["book_my_sheet"]
    assert [f.dataType.simpleString() for f in t.schema] == ["bigint", "date", "double"] and str(t.orderBy("id").first().day) == "2023-03-15"
    write_xlsx(tmp_path / "one.xlsx", {"S": [["v"], *[[i] for i in range(1200)], ["late text"]]})
    sample = read_tables(spark, f"file://{tmp_path}/one.xlsx")
    assert list(sample.tables) == ["one"] and "1 values" in sample.notices[0] and sample.tables["one"].schema[0].dataType.simpleString() == "bigint"
    assert read_tables(spark, f"file://{tmp_path}/one.xlsx", types="text").tables["one"].schema[0].dataType.simpleString() == "string"
    assert guess_types(spark.createDataFrame([("true",), (None,)], "v string"))[0].schema[0].dataType.simpleString() == "boolean"


def test_open_documents(spark, tmp_path):
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda v: f'<table:table-cell office:value="{v}"/>' if not isinstance(v, str) else f"<table:table-cell><text:p>{v}</text:p></table:table-cell>"
    rows = "".join("<table:table-row>" + "".join(map(cell, r)) + '<table:table-cell table:number-columns-repeated="1000"/></table:table-row>' for r in [["id", "v"], [1, "a"], [2, "b"]])
    with zipfile.ZipFile(tmp_path / "x.ods", "w") as z:
        z.writestr("content.xml", f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="S">{rows}</table:table></office:spreadsheet></office:body></office:document-content>')
    got = read_tables(spark, f"file://{tmp_path}/x.ods")
    assert [tuple(r) for r in got.tables["x"].orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_statistical_files(spark, tmp_path):
    pd.DataFrame({"id": [1, 2], "v": ["a", "b"]}).to_stata(tmp_path / "s.dta", write_index=False)
    assert {r.v for r in read_tables(spark, f"file://{tmp_path}/s.dta").tables["s"].collect()} == {"a", "b"}
    assert read_tables(spark, f"file://{tmp_path}/missing.sas7bdat").notices


def test_access_relationships(spark):
    rows = [("r1", 2, 0, "tbl Orders", "CustomerID", "tbl Customers", "CustomerID"), ("r2", 1, 0, "A", "x", "B", "y"), ("r3", None, 0, "MSysX", "x", "B", "y")]
    a, b = access_links(frame(spark, "szRelationship string, grbit int, icolumn int, szObject string, szColumn string, szReferencedObject string, szReferencedColumn string", rows))
    assert a.key == "tbl_orders|customer_id|tbl_customers|customer_id" and "without referential" in a.reasons[0] and b.one_to_one and "with referential" in b.reasons[0]


def test_database_queries(spark):
    pg, ms, my, sf = (Database(k, "db", schema="o'x") for k in ("postgres", "sqlserver", "mysql", "snowflake"))
    assert pg.options()["url"] == "jdbc:postgresql://localhost:5432/db" and Database("mysql", "d", port=1).options()["url"].endswith(":1/d")
    assert row_limit_query(pg, 't"x', 10) == 'SELECT * FROM "o\'x"."t""x" LIMIT 10' and row_limit_query(ms, "t", 5) == "SELECT TOP (5) * FROM [o'x].[t]"
    assert row_limit_query(my, "t", float("inf")) == "SELECT * FROM `t`" and row_limit_query(pg, "t", 0, False) == 'SELECT * FROM "t" LIMIT 0'
    assert "'O''X'" in tables_query(sf) and "'o''x'" in keys_query(pg) and "DATABASE()" in links_query(my) and "position_in_unique_constraint" in links_query(pg)
    with pytest.raises(ValueError, match="row limit"):
        row_limit_query(pg, "t", -1)
    with pytest.raises(ValueError, match="unknown kind"):
        Database("oracle", "x")

    def run(query):
        if "PRIMARY KEY" in query:
            return frame(spark, "t string, c string, n int", [("orders", "b", 2), ("orders", "a", 1)])
        if "referential" in query:
            return frame(spark, "from_table string, from_col string, to_table string, to_col string", [("Orders", "CustomerID", "Customers", "ID")])
        if "information_schema.tables" in query:
            return frame(spark, "table_name string", [("orders",), ("gone",)])
        if "gone" in query or '"o\'x"."orders"' in query:
            raise RuntimeError("no such table\nmore")
        return spark.range(3).toDF("ID")

    found = introspect(pg, run)
    assert found.tables == ["orders", "gone"] and found.keys == {"orders": ["a", "b"]} and found.links[0].key == "orders|customer_id|customers|id"
    tables, notices = load_tables(pg, found.tables, run)
    assert list(tables) == ["orders"] and tables["orders"].columns == ["id"] and notices == ["gone: no such table"]
    assert introspect(pg, lambda q: (_ for _ in ()).throw(RuntimeError("down"))).notices


def test_sessions(spark, books, tmp_path):
    tables, _, links, _ = books
    review = Review()
    review.confirm(links[2])
    review.suppress("a|b|c|d")
    s = Session(tables, [links[2]], [links[1]], [links[0]], review, {"orders": {"label": "O"}}, {"orders": ["order_id"]}, {"examples": "off"})
    save_session(spark, s, f"file://{tmp_path}/s")
    back = load_session(spark, f"file://{tmp_path}/s")
    assert (back.detected, back.manual, back.declared, back.review, back.dictionary, back.declared_keys, back.settings) == (s.detected, s.manual, s.declared, s.review, s.dictionary, s.declared_keys, s.settings)
    assert {t: sorted(map(str, d.collect())) for t, d in back.tables.items()} == {t: sorted(map(str, d.collect())) for t, d in tables.items()}
    both = restore_into(Session(manual=[links[1]]), back)
    assert both.manual == [links[1]] and both.dictionary == s.dictionary


def test_streamed_tables_are_rescanned(spark, tmp_path):
    parents = frame(spark, "customer_id int, name string", [(i, f"n{i}") for i in range(1, 21)])
    seen = []
    live = LiveDiscovery(spark, f"file://{tmp_path}/out", {"customers": parents}, on_change=lambda d, changed: seen.append((changed, [k.key for k in d.detected])))
    for lot in range(2):
        frame(spark, "order_no int, customer_id int", [(100 * lot + i, i % 20 + 1) for i in range(40)]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("order_no int, customer_id int").parquet(f"file://{tmp_path}/in")
        live.attach("orders", stream, f"file://{tmp_path}/check").awaitTermination()
    assert len(seen) == 2 and all("orders|customer_id|customers|customer_id" in keys for _, keys in seen) and seen[1][0] == ["orders"]
    assert live.current.scan.rows("orders") == 80


def test_registered_queries_have_names_that_match():
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 20 and discover({}).detected == []


def test_delimited_files_are_split_unless_quotes_hold_line_breaks(spark, tmp_path):
    from tablekin.sources.files import breaks_in_quotes, read_delimited

    (tmp_path / "plain.csv").write_text('a,b\n1,"x, ""y"""\n2,\n')
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    plain, broken = f"file://{tmp_path}/plain.csv", f"file://{tmp_path}/broken.csv"
    assert not breaks_in_quotes(spark, plain) and breaks_in_quotes(spark, broken)
    assert [tuple(r) for r in read_delimited(spark, plain).collect()] == [(1, 'x, "y"'), (2, "")]
    assert [tuple(r) for r in read_delimited(spark, broken).collect()] == [(1, "x\ny"), (2, "z")]
    assert read_delimited(spark, broken, multi_line=False).count() == 3


def test_access_through_export_programs(spark, tmp_path, monkeypatch):
    from tablekin.sources.access import read_access

    relations = "szObject,szColumn,szReferencedObject,szReferencedColumn,grbit\\nvisits,who,people,id,0\\n"
    (tmp_path / "mdb-tables").write_text("#!/bin/sh\nprintf 'people\\nvisits\\nMSysObjects\\nbad\\n'\n")
    (tmp_path / "mdb-export").write_text(
        f'#!/bin/sh\ncase "$6" in\npeople) printf "id,name\\n1,Ann\\n2,Bo\\n";;\nvisits) printf "who,day\\n1,2024-01-02\\n";;\nMSysRelationships) printf "{relations}";;\n*) echo no >&2; exit 1;;\nesac\n'
    )
    for f in ("mdb-tables", "mdb-export"):
        (tmp_path / f).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    tables, links, notices = read_access(spark, "file:///there/is/none.mdb")
    assert sorted(tables) == ["people", "visits"] and tables["people"].count() == 2 and str(tables["visits"].collect()[0].day) == "2024-01-02"
    assert [(k.from_table, k.from_col, k.to_table, k.to_col) for k in links] == [("visits", "who", "people", "id")] and len(notices) == 1
