"""What names of tables and columns say. Pure functions of names."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from ..config import NAME_HIGH, NAME_WEAK

# Affixes of tables and keys.
SCHEMA_PREFIX = re.compile(r"^(dbo|public|main|sys)_")
TABLE_PREFIX = re.compile(r"^(tbl|tlk|tlu|tb|lkp|lk|lu|lookup|ref|dim|fact|fct|stg|raw|mst|master)_")
TABLE_SUFFIX = re.compile(r"_(lookup|lkp|lu|ref|dim|tbl|table|codes|types)$")
TABLE_STAMP = re.compile(
    r"(_[0-9]{1,2}_[0-9]{1,2}_[0-9]{2,4}"
    r"|_[0-9]{4}[-_]?[0-9]{2}[-_]?[0-9]{2}"
    r"|_(19|20)[0-9]{2}"
    r"|_v[0-9]+"
    r"|_(final|draft|copy|bak|backup|old|new|tmp|temp|snapshot)"
    r")+$"
)
ENTITY_SUFFIX = re.compile(r"_(id|key|code|cd)$")
LOOKUP_NAME = re.compile(r"^(tlk|tlu|lkp|lk|lu|lookup|ref|code|cd)_|_(lookup|lkp|lu|ref|codes|types)$")
KEY_SUFFIX = re.compile(r"_(id|key|sk|fk|pk|code|cd|no|num|nbr|number|uuid|guid)$")
KEY_PREFIX = re.compile(r"^(id|fk|key)_")
KEY_NAME = re.compile(r"(_|[0-9])(id|key|sk|fk|uuid|guid)$|^(id|fk)_.")
ID_LIKE = re.compile(r"(_id|_key|id$|key$|_code|_num|_no)$")

# Names that identify a row by themselves, and surrogate keys that every table has.
GENERIC_KEYS = ("id", "pk", "key", "code", "uuid", "guid")
SURROGATE_KEYS = (
    "record_id", "row_id", "rowid", "record_key", "record_number", "seq", "seq_id", "sequence", "sk", "surrogate_key",
    "uid", "oid", "objectid", "object_id", "autonumber", "counter",
)

# Irregular plurals.
IRREGULAR = {
    "people": "person",
    "children": "child",
    "men": "man",
    "women": "woman",
    "geese": "goose",
    "mice": "mouse",
    "indices": "index",
    "matrices": "matrix",
    "criteria": "criterion",
}

# Words of a hierarchy within one table.
HIERARCHY = (
    "parent", "manager", "supervisor", "reports_to", "superior", "predecessor", "successor", "previous", "prior", "next",
    "root", "master", "boss",
)

_SIGNS = {"%": "_percent_", "#": "_number_", "'": "", '"': ""}


@lru_cache(maxsize=100_000)
def clean_name(name: str) -> str:
    """snake_case: CustomerID -> customer_id, `order items` -> order_items, Sort# -> sort_number."""
    x = "".join(_SIGNS.get(c, c) for c in str(name))
    x = unicodedata.normalize("NFKD", x.replace("ß", "ss"))
    x = "".join(c for c in x if not unicodedata.combining(c))
    x = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", x)
    x = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", x)
    x = re.sub(r"[^A-Za-z0-9]+", "_", x).strip("_").lower()
    return "x" + x if not x or x[0].isdigit() else x


def clean_names(names: Iterable[str]) -> list[str]:
    """clean_name() of each, with _2, _3, ... for repeats."""
    seen: Counter[str] = Counter()
    out = []
    for name in map(clean_name, names):
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def _without(pattern: re.Pattern, name: str) -> str:
    """name without the first match, unless nothing else is left."""
    return pattern.sub("", name, count=1) or name


def strip_table_prefix(table: str) -> str:
    short = TABLE_PREFIX.sub("", SCHEMA_PREFIX.sub("", table))
    return short or table


#: What a word's end becomes in the singular, and how long the word has to be; the first that holds counts.
ENDINGS = [("ies", "y", 5), ("ss", "ss", 0), ("us", "us", 0), ("is", "is", 0), ("ses", "s", 0), ("xes", "x", 0), ("zes", "z", 0), ("ches", "ch", 0), ("shes", "sh", 0), ("s", "", 4)]


def singular(name: str) -> str:
    """Batch_boxes -> batch_box: the last word of a clean name in the singular."""
    *before, last = name.split("_")
    one = IRREGULAR.get(last)
    if one is None:
        one = next((last[: len(last) - len(end)] + new for end, new, least in ENDINGS if last.endswith(end) and len(last) >= least), last)
    return "_".join([*before, one])


@lru_cache(maxsize=100_000)
def table_entity(table: str) -> str:
    """What a clean table name is about, in the singular: dim_warehouses_2021 -> warehouse, ref_colour_code -> colour."""
    name = strip_table_prefix(table)
    for affix in (TABLE_STAMP, TABLE_SUFFIX, ENTITY_SUFFIX):
        name = _without(affix, name)
    return singular(name)


class KeyEntity(NamedTuple):
    stem: str
    role: bool
    words: int


@lru_cache(maxsize=100_000)
def key_entities(column: str) -> tuple[KeyEntity, ...]:
    """What a clean key column may point at: all words of its stem, then ever fewer of the last ones, which then stand in a
    role. old_stock_clerk_id -> old_stock_clerk; stock_clerk and clerk in a role. Nothing for other columns."""
    affix = next((a for a in (KEY_SUFFIX, KEY_PREFIX) if a.search(column)), None)
    words = [w for w in affix.sub("", column).split("_") if w] if affix else []
    tails = [words[len(words) - n :] for n in range(len(words), 0, -1)]
    return tuple(KeyEntity(singular("_".join(tail)), len(tail) < len(words), len(tail)) for tail in tails)


@lru_cache(maxsize=500_000)
def fk_name_match(column: str, table: str, lookup: bool = False) -> str | None:
    """How a clean column name points at a clean table name: exact, role or not. One word in a role counts for lookups only."""
    entity = table_entity(table)
    if column == f"{entity}_id":
        return "exact"
    match = next((k for k in key_entities(column) if k.stem == entity and (not k.role or k.words >= 2 or lookup)), None)
    return match and ("role" if match.role else "exact")


def is_key_name(column: str) -> bool:
    return KEY_NAME.search(column) is not None


def is_generic_key(column: str) -> bool:
    return column in GENERIC_KEYS


def owns_key(column: str, table: str) -> bool:
    """The table is named for the key's entity: customers owns customer_id."""
    return table == column or fk_name_match(column, table) == "exact"


def is_pk_name(column: str, table: str) -> bool:
    """A clean column named like the key of a table (without its prefix): id, the table's own key, or the key of what the
    table's name begins with, such as invoice_id in invoice_lines."""
    own = column in ("id", f"{table}_id") or owns_key(column, table)
    return own or (column.endswith("_id") and table.startswith(column.removesuffix("_id")))


def is_lookup_name(table: str) -> bool:
    return LOOKUP_NAME.search(SCHEMA_PREFIX.sub("", clean_name(table))) is not None


def target_preference(target: str, source: str) -> int:
    """Which of several target columns is the better one at equal scores."""
    return 3 if target in GENERIC_KEYS else 2 if target == source else int(is_key_name(target))


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """Jaro-Winkler similarity; the common prefix, of 4 characters at most, counts at any similarity."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, pairs = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                pairs.append(x)
                break
    if not pairs:
        return 0.0
    others = [y for y, u in zip(b, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(pairs, others, strict=True)) / 2
    m = len(pairs)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return jaro + min(4, common) * prefix_weight * (1 - jaro)


class NameSignal(NamedTuple):
    signal: str
    strength: float
    reason: str


@lru_cache(maxsize=500_000)
def name_signal(column: str, table: str, target: str, lookup: bool = False) -> NameSignal | None:
    """Evidence from the names of a column, a parent table and its column, as they are or clean."""
    c, d = clean_name(column), clean_name(target)
    match = fk_name_match(c, clean_name(table), lookup)
    if match == "exact":
        return NameSignal("naming_exact", 1.0, "exact FK naming")
    if match == "role":
        return NameSignal("naming_role", 0.9, f"FK naming with prefix ({c})")
    if c == d:
        return None if c in GENERIC_KEYS or c in SURROGATE_KEYS else NameSignal("name_identical", 1.0, f"identical column name ({c})")
    likeness = jaro_winkler(*(re.sub(r"_(id|key|code|num|no)$", "", x) for x in (c, d)))
    if likeness >= NAME_HIGH:
        return NameSignal("name_sim", likeness, f"name similarity {likeness:.2f}")
    if likeness >= NAME_WEAK:
        return NameSignal("name_sim_weak", likeness, f"weak name similarity {likeness:.2f}")
    return None


def self_reference_rest(column: str) -> str | None:
    """What is left of a key column's stem without words of hierarchy; None if it has none."""
    stem = KEY_SUFFIX.sub("", column)
    rest = stem
    for word in HIERARCHY:
        rest = re.sub(rf"(^|_){word}(_|$)", "_", rest)
    rest = re.sub(r"_+", "_", rest).strip("_")
    return None if rest == stem else rest
