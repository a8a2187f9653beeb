"""Names: cleaning, entities, keys and likeness."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tablekin import config
from tablekin.functions import naming as N
from tablekin.functions.private import matches_pattern, private_name


@pytest.mark.parametrize(
    ("name", "clean"),
    [("CustomerID", "customer_id"), ("order items", "order_items"), ("Sort#", "sort_number"), ("first.name", "first_name"), ("2024 sales", "x2024_sales"), ("HTTPServer", "http_server"), ("a%", "a_percent"), ("Größe", "grosse")],
)
def test_clean_name(name, clean):
    assert N.clean_name(name) == clean


def test_clean_names_tell_repeats_apart():
    assert N.clean_names(["A b", "a_b", "c"]) == ["a_b", "a_b_2", "c"]


@pytest.mark.parametrize(("word", "one"), [("customers", "customer"), ("people", "person"), ("categories", "category"), ("boxes", "box"), ("status", "status"), ("address", "address"), ("order_items", "order_item"), ("branches", "branch"), ("gas", "gas")])
def test_singular(word, one):
    assert N.singular(word) == one


@pytest.mark.parametrize(
    ("table", "entity"),
    [("tlk_providers", "provider"), ("dbo_customer_lookup", "customer"), ("tlk_town_id", "town"), ("episode_1_15_24", "episode"), ("visits_2024", "visit"), ("claims_20240630", "claim"), ("orders_v2", "order"), ("people_final", "person"), ("tbl_clients", "client")],
)
def test_table_entity(table, entity):
    assert N.table_entity(table) == entity


@pytest.mark.parametrize(
    ("column", "table", "lookup", "match"),
    [
        ("provider_id", "providers", False, "exact"), ("referring_provider_id", "tlk_providers", True, "role"), ("referring_provider_id", "providers", False, None),
        ("old_stock_clerk_id", "stock_clerks", False, "role"), ("id_customer", "customers", False, "exact"), ("state_code", "states", False, "exact"),
        ("order_id", "order_items", False, None), ("amount", "customers", False, None),
    ],
)
def test_fk_name_match(column, table, lookup, match):
    assert N.fk_name_match(column, table, lookup) == match


def test_key_names():
    assert all(map(N.is_key_name, ("customer_id", "k9id", "order_key", "id_customer", "x_uuid")))
    assert not any(map(N.is_key_name, ("id", "key", "paid", "l_orderkey", "notes")))
    assert N.is_pk_name("id", "x") and N.is_pk_name("order_id", "order_items") and N.is_pk_name("customer_id", "customers") and not N.is_pk_name("customer_id", "orders")
    assert N.owns_key("customer_id", "customers") and not N.owns_key("order_id", "order_items")


def test_jaro_winkler():
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert N.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-4)
    assert N.jaro_winkler("abc", "xyz") == 0 and N.jaro_winkler("", "a") == 0 and N.jaro_winkler("ab", "ab") == 1


@given(st.text("abcde_", max_size=12), st.text("abcde_", max_size=12))
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    x = N.jaro_winkler(a, b)
    assert 0 <= x <= 1 and x == pytest.approx(N.jaro_winkler(b, a))


def test_name_signals():
    assert N.name_signal("customer_id", "customers", "customer_id").signal == "naming_exact"
    assert N.name_signal("referring_provider_id", "tlk_providers", "id", True).signal == "naming_role"
    assert N.name_signal("episode_year", "documents", "episode_year").signal == "name_identical"
    assert N.name_signal("record_id", "documents", "record_id") is None and N.name_signal("id", "documents", "id") is None
    assert N.name_signal("o_custkey", "customer", "c_custkey").signal == "name_sim"
    assert N.name_signal("zzz", "customer", "c_custkey") is None


def test_weights_and_labels():
    assert all(0 <= w <= 1 for w in config.WEIGHTS.values()) and set(config.WEIGHTS) == set(config.LABELS)
    assert config.Switches.of("naming").content is False and config.Switches.of("content").naming is False
    assert config.Switches.of("both", format=False).format is False and config.Switches.of("both", True).content is False
    with pytest.raises(ValueError, match="unknown method"):
        config.Switches.of("magic")


@pytest.mark.parametrize(
    ("column", "hit"),
    [
        ("patient_mrn", "mrn"), ("zip5", "zip"), ("street1", "street"), ("DOB", "dob"), ("first_name", "first_name"), ("e_mail", "e_mail"), ("address_type", None), ("email_verified", None),
        ("product_name", None), ("name_count", None), ("zip_code_type", None), ("amount", None), ("customer_name", "name"), ("city_name", None),
    ],
)
def test_private_names(column, hit):
    assert private_name(column) == (hit and f'name contains "{hit}"')


def test_private_patterns():
    assert matches_pattern("*_name, dob*", "t", "Last_Name") and matches_pattern("clients.notes", "clients", "notes")
    assert not matches_pattern("clients.notes", "staff", "notes") and not matches_pattern("", "t", "x")
