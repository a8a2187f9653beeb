"""Profiles, keys, links and their upkeep on small tables whose answers are known."""

import random
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from tablekin.config import Options, Switches
from tablekin.operators.erd import automatic_detail, erd_model, erd_view
from tablekin.operators.keys import Keys, apply_declared, detect_keys, is_lookup, key_candidates
from tablekin.operators.links import Link, detect_links, resolve_parents, score_pair, score_signals, sort_links
from tablekin.operators.profile import kind_of, null_patterns, scan
from tablekin.operators.review import Review, combine, declared_link, filter_links, manual_link, merge_declared_links, reviewed, scan_estimate, shared_columns_policy
from tablekin.operators.shared import shared_columns
from tablekin.plans.discovery import discover, rediscover
from tablekin.tables import TableSet, changed_tables


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def n(*values):
    return [(v,) for v in values]


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "customers": frame(spark, "customer_id int, name string, email string, country string", [(i, f"n{i}", f"n{i}@x.io", "UK" if i % 2 else "FR") for i in range(1, 6)]),
        "products": frame(spark, "product_id int, name string, price double", [(100 + i, f"p{i}", 9.99 + i) for i in range(1, 6)]),
        "orders": frame(spark, "order_id int, customer_id int, product_id int, quantity int", [(1000 + i, i % 3 + 1, 101 + i % 5, 71 + i % 4) for i in range(8)]),
        "order_items": frame(spark, "item_id int, order_id int, product_id int, unit_price double", [(5000 + i, 1000 + i, 101 + i % 4, 1.5 * i) for i in range(8)]),
        "customer_addresses": frame(spark, "customer_id int, street string", [(i % 5 + 1, f"s{i}") for i in range(7)]),
    }


def found(links):
    return {(k.from_table, k.from_col, k.to_table): k for k in links}


def test_profiles_against_duckdb(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 1.0, 2.5, float("nan")]), rng.choice([None, "", "a", "b"]), rng.random() < 0.5, i) for i in range(200)]
    t = frame(spark, "a int, b double, c string, d boolean, e bigint", rows)
    known = scan({"t": t})
    con = duckdb.connect()
    con.execute("create table t(a int, b double, c varchar, d boolean, e bigint)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", [(a, None if b != b else b, c, d, e) for a, b, c, d, e in rows])
    for c in "abcde":
        total, some, distinct = con.execute(f"select count(*), count({c}), count(distinct {c}) from t").fetchone()
        square = con.execute(f"select sum(n * n) from (select count(*) as n from t where {c} is not null group by {c})").fetchone()[0]
        p = known.profiles["t", c]
        assert (p.n_rows, p.n_null, p.n_distinct, p.square) == (total, total - some, distinct, square)
    assert known.profiles["t", "e"].unique and not known.profiles["t", "a"].unique
    assert [known.profiles["t", c].erd_type for c in "abcde"] == ["int", "float", "string", "bool", "int"]


def test_values_meet_by_kind_not_by_type(spark):
    known = scan({"a": frame(spark, "x int, s string", [(1, "1"), (2, "2")]), "b": frame(spark, "y double, d decimal(10,2)", [(1.0, None), (2.0, None), (2.5, None)])})
    assert known.overlap(("a", "x"), ("b", "y")) == 1 and known.overlap(("a", "s"), ("b", "y")) == 0
    assert known.overlap(("b", "y"), ("a", "x")) == pytest.approx(2 / 3) and known.cosine(("a", "x"), ("b", "y")) == pytest.approx(2 / (2 * 3) ** 0.5)
    assert known.profiles["b", "d"].n_distinct == 0 and known.profiles["b", "d"].n_null == 3


def test_big_integers_stay_apart(spark):
    known = scan({"a": frame(spark, "x bigint", n(2**60, 2**60 + 1)), "b": frame(spark, "y bigint", n(2**60 + 2))})
    assert known.profiles["a", "x"].n_distinct == 2 and known.overlap(("b", "y"), ("a", "x")) == 0


@pytest.mark.parametrize(
    ("values", "name"),
    [
        (["a@b.co"] * 4 + ["x"], "email"), (["2024-01-05"] * 3, "iso_date"), (["2024-01-05 10:00"] * 3, "iso_ts"), (["12345", "54321-1234"], "zip_us"), (["555-123-4567"] * 2, "phone"),
        (["#ff0000"], "hex_color"), (["42", "7"], "int_code"), (["us", "UK"], "alpha_code"), (["hello world", "x"], None), ([None, None], None),
        (["123e4567-e89b-12d3-a456-426614174000"], "uuid"),
    ],
)
def test_fingerprints(spark, values, name):
    assert scan({"t": frame(spark, "v string", n(*values))}).profiles["t", "v"].fingerprint == name


def test_fingerprints_of_numbers(spark):
    known = scan({"t": frame(spark, "a int, b double, c double", [(i, 12345.0 + i, 1234.56 + i) for i in range(5)])})
    assert [known.profiles["t", c].fingerprint for c in "abc"] == ["int_code", "zip_us", "phone"]


def test_fingerprints_of_numbers_are_those_of_their_text(spark):
    import re

    from tablekin.config import FORMATS

    rng = random.Random(8)
    numbers = [0, 1, 99999, 10000, 9999, 100000, 999999, 1000000, -100000, -99999, 10**15 - 1, 10**15, -(10**14) + 1, -(10**14), 2**62]
    fractions = [1234.56, 12345.5, 0.5, -1234.5, 123456789.25, 1e20, float("inf"), 2.5e-9]
    for values, kind in [(numbers, "bigint"), ([float(x) for x in numbers if abs(x) < 2**53], "double"), (fractions, "double")]:
        for v in values:
            rows = n(*[rng.choice([type(v)(v)]) for _ in range(3)], None)
            text = spark.createDataFrame(n(v), f"v {kind}").selectExpr("CASE WHEN v = floor(v) AND abs(v) < 1e18 THEN cast(cast(v AS bigint) AS string) ELSE cast(v AS string) END AS t").first().t if abs(v) < 9e18 else "1.0E20"
            want = next((k for k, p in FORMATS if re.search(p, text, re.I)), None)
            assert scan({"t": frame(spark, f"v {kind}", rows)}).profiles["t", "v"].fingerprint == want, v


def test_links_of_a_shop(spark, shop):
    known = discover(shop)
    links = found(known.links())
    for key in [("orders", "customer_id", "customers"), ("orders", "product_id", "products"), ("order_items", "order_id", "orders"), ("order_items", "product_id", "products"), ("customer_addresses", "customer_id", "customers")]:
        assert links[key].confidence == "high" and "naming_exact" in links[key].signals
    assert not [k for k in known.links() if k.confidence != "low" and k.key not in {links[x].key for x in links if "naming_exact" in links[x].signals}]
    assert key_candidates(known.scan, "customers")[0] == "customer_id"


def lookups(spark):
    eight = [(i, f"l{i}") for i in range(1, 9)]
    out = {f"tlk_{t}": frame(spark, "id int, label string", eight) for t in ("services", "sites", "providers", "programs")}
    return out | {"tbl_visits": frame(spark, "visit_id int, service_id int, site_id int, code int", [(i, i % 8 + 1, (i * 3) % 8 + 1, (i * 5) % 8 + 1) for i in range(1, 61)])}


def test_names_choose_between_lookups_and_values_alone_do_not(spark):
    tables = lookups(spark)
    for order in (list(tables), list(tables)[::-1]):
        links = found(discover({t: tables[t] for t in order}, composites=False).detected)
        assert links["tbl_visits", "service_id", "tlk_services"].confidence == "high"
        others = [k for k in links.values() if k.from_col == "service_id" and k.to_table != "tlk_services"]
        assert len(others) == 3 and all(k.confidence == "low" and k.demoted == "name points to tlk_services" for k in others)
        code = [k for k in links.values() if k.from_col == "code"]
        assert len(code) == 4 and all(k.demoted.startswith("ambiguous: values fit 4 tables") and k.confidence == "low" for k in code)


def test_resolving_twice_changes_nothing(spark):
    links, _ = detect_links(scan(lookups(spark)))
    again = sort_links(resolve_parents(links))
    assert [(k.key, k.score, k.confidence, k.reasons) for k in again] == [(k.key, k.score, k.confidence, k.reasons) for k in links]
    shuffled = sort_links(resolve_parents(random.Random(0).sample(links, len(links))))
    assert {(k.key, k.score) for k in shuffled} == {(k.key, k.score) for k in links}


def test_values_veto(spark):
    tables = {
        "tbl_payment": frame(spark, "payment_id int", n(*range(6001, 6061))),
        "tbl_client": frame(spark, "client_id int, amount double", [(i, float([5, 10, 20, 50][i % 4])) for i in range(1, 61)]),
    }
    assert not [k for k in discover(tables).detected if k.from_col == "amount"]


def test_single_parent_by_values(spark):
    tables = {"parent": frame(spark, "pk int, label string", [(i, f"x{i}") for i in range(1, 6)]), "child": frame(spark, "row int, cust_ref int", [(i, i % 5 + 1) for i in range(20)])}
    assert found(discover(tables).detected)["child", "cust_ref", "parent"].confidence == "high"


def test_self_references(spark):
    tables = {
        "employees": frame(spark, "id int, name string, manager_id int", [(i, f"e{i}", m) for i, m in zip(range(1, 7), [None, 1, 1, 2, 2, 3], strict=True)]),
        "categories": frame(spark, "id int, parent_category_id int", [(1, None), (2, 1), (3, 1), (4, 2)]),
        "orders": frame(spark, "id int, customer_id int", [(i, i) for i in range(10, 14)]),
    }
    own = {(k.from_table, k.from_col) for k in discover(tables).detected if k.from_table == k.to_table}
    assert own == {("employees", "manager_id"), ("categories", "parent_category_id")}


def test_one_to_one_tables_form_a_star(spark):
    ids = range(101, 151)
    tables = {t: frame(spark, "client_id int, x string", [(i, t + str(i % 3)) for i in ids]) for t in ("enrollment", "demographics", "hiv_status")}
    links = discover(tables).detected
    assert len(links) == 2 and len({k.to_table for k in links}) == 1 and all(k.one_to_one for k in links)


def test_empty_tables(spark):
    tables = {"tbl_clients": frame(spark, "client_id int", n(*range(1, 11))), "tbl_income": frame(spark, "client_id int, amount double", [])}
    (k,) = discover(tables).detected
    assert (k.from_table, k.to_table) == ("tbl_income", "tbl_clients") and k.reasons[-1] == "no rows to compare (child 0, parent 10)"


def test_odd_columns_do_not_stop_a_scan(spark):
    tables = {
        "a": frame(spark, "client_id int, uci string, v array<int>, note string", [(i, None, [i], "") for i in range(1, 6)]),
        "b": frame(spark, "client_id int, uci string, m map<string,int>, note string", [(3, None, {"x": 1}, "")]),
    }
    known = discover(tables)
    assert known.scan.profiles["a", "v"].kind is None and known.scan.profiles["a", "uci"].n_distinct == 0
    assert known.scan.overlap(("a", "note"), ("b", "note")) == 1
    assert discover({}).detected == [] and discover({"a": tables["a"]}).detected == []


def test_kinds_must_agree(spark):
    known = scan({"a": frame(spark, "x_id string", n("1", "2")), "x": frame(spark, "x_id int", n(1, 2))})
    assert score_pair(known, ("a", "x_id"), ("x", "x_id"), Switches.of()) is None
    assert kind_of(frame(spark, "x date", []).schema[0].dataType) == "datetime"


def test_scores():
    assert score_signals({"overlap_high": 1, "name_sim": 0.9}) == (0.96, "value_overlap")
    assert score_signals({"naming_exact": 1}) == (1.0, "naming") and score_signals({"what": 1}) == (0.1, "content")
    assert score_signals({"name_sim": 1, "name_identical": 1})[1] == "name_similarity"


def test_rescan_equals_full_scan(spark, shop):
    first = {t: shop[t] for t in ("customers", "orders")}
    before = discover(first)
    grown = shop | {"tbl_income": frame(spark, "income_id int, customer_id int", [(i, i % 5 + 1) for i in range(20)])}
    after, changed = rediscover(before, grown)
    assert set(changed) == set(grown) - set(first)
    full = discover(grown)
    assert {(k.key, k.score, k.confidence) for k in after.detected} == {(k.key, k.score, k.confidence) for k in full.detected}
    assert after.keys.single == full.keys.single and after.keys.composite == full.keys.composite
    same, none = rediscover(after, grown)
    assert none == [] and same is after
    moved = grown | {"orders": shop["orders"].where("order_id < 1004")}
    assert rediscover(after, moved)[1] == ["orders"]


def test_signatures(spark, shop):
    _, sig = changed_tables(shop, {})
    assert changed_tables(shop | {"orders": shop["orders"].orderBy("quantity")}, sig)[0] == []
    assert changed_tables(shop | {"orders": shop["orders"].limit(3)}, sig)[0] == ["orders"]


def test_composite_keys(spark):
    pair = frame(spark, "order_id int, product_id int, quantity int", [(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 2, 4)])
    triple = frame(spark, "a int, b int, c int, d int", [(i >> 2 & 1, i >> 1 & 1, i & 1, 1) for i in range(8)])
    none = frame(spark, "id int, x int", [(1, 1), (2, 1)])
    keys = detect_keys(t := {"order_items": pair, "grid": triple, "plain": none}, scan(t))
    assert keys.composite == {"order_items": [["order_id", "product_id"]], "grid": [["a", "b", "c"]]}


def test_composite_keys_by_slices(spark, monkeypatch):
    import tablekin.operators.keys as module

    monkeypatch.setattr(module, "SLICE_ROWS", 20)
    monkeypatch.setattr(module, "SETS_AT_ONCE", 1)
    rows = [(i // 20, i % 20, i // 2, i % 3, 7) for i in range(400)]
    tables = {"m": frame(spark, "a int, b int, c int, d int, e int", rows), "near": frame(spark, "a int, b int, c int", [(*r[:2], 1) for r in [*rows, rows[0]]])}
    assert detect_keys(tables, scan(tables)).composite == {"m": [["a", "b"]]}


def test_declared_keys(spark):
    known = scan({"t": frame(spark, "a int, b int", [(1, 1), (2, 1)]), "e": frame(spark, "x int", [])})
    keys = detect_keys({}, known)
    keys.single = {t: key_candidates(known, t) for t in known.tables}
    out = apply_declared(keys, {"t": ["a"], "e": []}, known)
    assert out.single == {"t": ["a"], "e": []} and out.declared == {"t", "e"}
    assert apply_declared(keys, {"t": ["a", "b"]}, known).composite == {"t": [["a", "b"]]}
    assert apply_declared(keys, {"t": ["zz"]}, known).single == keys.single


def test_lookup_tables(spark):
    known = scan({"tlk_x": frame(spark, "a int", []), "small": frame(spark, "code string, label string", [("A", "x"), ("B", "y")]), "wide": frame(spark, "id int, b int, c int, d int, e int", [(1, 1, 1, 1, 1)])})
    assert [is_lookup(known, t) for t in known.tables] == [True, True, False]


def test_shared_columns(spark):
    tables = {
        "toxicology": frame(spark, "member_item_id int, episode_year int", [(i, 2000 + i % 6) for i in range(30)]),
        "document": frame(spark, "document_id int, episode_year int", [(i, 2000 + i % 4) for i in range(40)]),
    }
    (k,) = shared_columns(scan(tables))
    assert (k.column, k.n_shared, k.overlap, k.contained) == ("episode_year", 4, 1.0, True)
    assert shared_columns_policy(Options(method="naming"))[0] is None and shared_columns_policy(Options(min_confidence="high")) == (0.8, "")


def test_null_patterns(spark):
    one = frame(spark, "k int, x int", [(i, None if i % 3 == 0 else i) for i in range(30)])
    other = frame(spark, "k int, y string", [(i, None if i % 3 == 0 else "v") for i in range(30)])
    third = frame(spark, "k long, z int, w int", [(i, None if i % 3 == 0 or i == 1 else i, None if i % 2 else 1) for i in range(30)])
    found = lambda **t: {(r.from_table, r.from_col, r.to_col): r.r for r in null_patterns(t, scan(t, content=False), "k").collect()}
    got = found(a=one, b=other, c=third)
    assert got["a", "x", "y"] == got["b", "y", "x"] == pytest.approx(1)
    x, z = [i % 3 == 0 for i in range(30)], [i % 3 == 0 or i == 1 for i in range(30)]
    assert got["a", "x", "z"] == pytest.approx(np.corrcoef(x, z)[0, 1]) and got["c", "w", "y"] == pytest.approx(np.corrcoef([i % 2 for i in range(30)], x)[0, 1])
    assert ("c", "z", "w") not in got and len(got) == 10
    assert not found(a=one, b=other.limit(20)) and not found(a=one.where("x is not null"), b=other) and not found(a=one)
    assert not found(a=one, b=frame(spark, "k int, y string", [(i + 1, None if i % 3 == 0 else "v") for i in range(30)]))


@pytest.fixture(scope="module")
def erd(spark):
    tables = {
        "customers": frame(spark, "customer_id int, email string", [(i, f"{i}@x.io") for i in range(1, 5)]),
        "orders": frame(spark, "order_id int, customer_id int, amount double", [(i, c, 1.5 * (i % 3)) for i, c in zip(range(1, 7), [1, 2, 1, None, 3, 4], strict=True)]),
        "customer_profile": frame(spark, "customer_id int, bio string", [(i, "b") for i in range(1, 5)]),
        "order_items": frame(spark, "order_id int, product_id int, qty int", [(1, 1, 2), (1, 2, 1), (2, 1, 1)]),
        "products": frame(spark, "product_id int, sku string", [(1, "A"), (2, "A")]),
        "tlk_status": frame(spark, "id int, label string", [(i, f"s{i}") for i in range(3)]),
        "audit_log": frame(spark, "msg string", [("x",), ("x",)]),
    }
    links = [
        Link("orders", "customer_id", "customers", "customer_id", "naming", "high", 0.87),
        declared_link("customer_profile", "customer_id", "customers", ""),
        replace(Link("order_items", "order_id", "orders", "order_id", "naming", "high", 0.9), confirmed=True),
        manual_link("order_items", "product_id", "products", "product_id"),
    ]
    keys = Keys({"customers": ["customer_id"], "orders": ["order_id"], "customer_profile": ["customer_id"], "products": ["product_id"], "tlk_status": ["id"]}, {"order_items": [["order_id", "product_id"]]})
    return scan(tables), links, keys


def test_model(erd):
    m = erd_model(*erd)
    assert {t.name: t.role for t in m.tables.values()} == {"customers": "entity", "orders": "entity", "customer_profile": "entity", "order_items": "junction", "products": "entity", "tlk_status": "lookup", "audit_log": "orphan"}
    k = {(k.link.from_table, k.link.from_col): k for k in m.links}
    assert (k["orders", "customer_id"].child_max, k["orders", "customer_id"].parent_min) == ("many", "zero")
    assert (k["customer_profile", "customer_id"].child_max, k["customer_profile", "customer_id"].to_col) == ("one", "customer_id")
    assert k["order_items", "order_id"].identifying and {x.provenance for x in m.links} == {"inferred", "declared", "confirmed", "manual"}
    areas = {t.name: t.subject_area for t in m.tables.values()}
    assert areas["tlk_status"] == "Lookups" and areas["audit_log"] == "Unconnected" and areas["products"] == areas["customers"] == "orders"
    assert m.tables["products"].is_reference and m.tables["order_items"].columns[0].pk and m.tables["order_items"].columns[0].fk_index == 1


def test_views(erd):
    m = erd_model(*erd)
    near, hidden = erd_view(m, focus="customers", hops=1)
    assert set(near.tables) == {"customers", "orders", "customer_profile"} and hidden["orphans"] == ["audit_log", "tlk_status"]
    assert len(erd_view(m, focus="customers", hops=4)[0].tables) == 5
    keys, _ = erd_view(m, detail="keys")
    assert [c.name for c in keys.tables["orders"].columns] == ["order_id", "customer_id"] and keys.tables["orders"].hidden_columns == 1
    assert set(erd_view(m, areas=["Lookups"])[0].tables) == {"tlk_status"} and automatic_detail(m) == "all"


def test_review(erd):
    _, links, _ = erd
    detected, declared = links[0], links[1]
    both = combine([detected, Link(*[declared.from_table, declared.from_col, declared.to_table, declared.to_col or None], score=0.7)], [links[3]], [declared])
    assert [k.provenance for k in both] == ["detected", "manual", "declared"] and both[-1].also_detected == 0.7
    review, tables = Review(), {"orders", "customers", "customer_profile", "order_items", "products"}
    review.confirm(detected)
    assert reviewed([], review, tables)[0].confirmed and reviewed([], review, {"orders"}) == []
    review.overrides[detected.key] = "low"
    assert reviewed([detected], review, tables)[0].score == 0.3
    review.suppress(detected.key)
    assert reviewed([detected], review, tables) == []
    review.restore(detected.key)
    assert [k.provenance for k in filter_links(both, "to_review")] == ["detected"] and len(filter_links(both, "declared")) == 2
    assert len(merge_declared_links([declared], [declared, declared_link("A b", "C", "D", None)])) == 2
    with pytest.raises(ValueError, match="two tables"):
        manual_link("a", "b", "a", "c")


def test_estimate():
    assert scan_estimate({"a": (100, 10), "b": (50, 5)})["tier"] == "fast"
    assert scan_estimate({f"t{i}": (10_000, 60) for i in range(30)})["tier"] == "slow"


def test_table_sets(spark):
    ts, df = TableSet(), spark.range(3).toDF("Some ID")
    assert ts.add("My Table", df) == "my_table" and ts["my_table"].columns == ["some_id"]
    assert ts.add("my_table", df, "keep_both") == "my_table_2" and ts.add("my_table", df, "skip") is None
    assert {tuple(r) for r in ts.rename_log(spark).collect()} == {("table", "My Table", "My Table", "my_table"), ("column", "My Table", "Some ID", "some_id"), ("column", "my_table", "Some ID", "some_id")}
    assert ts.add("my_table", df, skip_equal=True) is None and ts.add("my_table", df.limit(1), skip_equal=True) == "my_table"
    assert list(TableSet({"a": df, "b": df.limit(0)}).with_rows()) == ["a"]
    wide = TableSet({"w": spark.range(1).selectExpr("id as a", "id as b", "id as c", "id as x_id")})
    assert wide.narrowed(2)["w"].columns == ["a", "x_id"]


def access(spark, seed=7):
    """52 tables in the style of an office database, and the links that are true by construction."""
    rng = random.Random(seed)
    lookup = ["providers", "services", "sites", "statuses", "programs", "funders", "regions", "outcomes"]
    tables = {f"tlk_{t}": frame(spark, "id int, label string", [(i, f"{t}{i}") for i in range(1, 9)]) for t in lookup}
    words = [a + b for a in ("alpha", "bravo", "delta", "gamma") for b in ("form", "visit", "claim", "order", "grant", "event", "audit", "batch", "intake", "review")]
    truth, rows = set(), 60
    for i, e in enumerate(words):
        cols, names = [[1000 * (i + 1) + r for r in range(1, rows + 1)]], [f"{e}_id int"]
        for t in rng.sample(lookup, 2):
            from tablekin.functions.naming import singular

            c = f"{singular(t)}_id"
            cols.append([None if i % 3 == 0 and rng.random() < 0.1 else rng.randint(1, 8) for _ in range(rows)])
            names.append(f"{c} int")
            truth.add((f"tbl_{e}", c, f"tlk_{t}"))
        for p in rng.sample(range(i), min(2, i)):
            cols.append([1000 * (p + 1) + rng.randint(1, rows) for _ in range(rows)])
            names.append(f"{words[p]}_id int")
            truth.add((f"tbl_{e}", f"{words[p]}_id", f"tbl_{words[p]}"))
        if i % 10 == 0:
            cols.append([rng.randint(1, 8) for _ in range(rows)])
            names.append("code int")
        cols += [[rng.choice("abcdefgh") for _ in range(rows)], [float(rng.choice([5, 10, 20, 50])) for _ in range(rows)]]
        tables[f"tbl_{e}"] = frame(spark, ", ".join([*names, "notes string", "amount double"]), list(zip(*cols, strict=True)))
    for j in range(4):
        tables[f"tbl_misc{j}"] = frame(spark, "msg string, val double", [(f"m{r}", r * 1.5) for r in range(5)])
    return tables, truth


def test_fifty_two_tables(spark):
    tables, truth = access(spark)
    assert len(tables) == 52 and len(truth) == 157
    links, _ = detect_links(scan(tables))
    got = {(k.from_table, k.from_col, k.to_table) for k in links if k.confidence != "low"}
    assert got == truth
