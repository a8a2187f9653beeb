"""Sessions: tables as Parquet beside a JSON manifest of everything people decided."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.links import Link
from ..operators.review import Review

VERSION = 1


@dataclass
class Session:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    detected: list[Link] = field(default_factory=list)
    manual: list[Link] = field(default_factory=list)
    declared: list[Link] = field(default_factory=list)
    review: Review = field(default_factory=Review)
    dictionary: dict[str, dict] = field(default_factory=dict)
    declared_keys: dict[str, list[str]] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)


def _plain(k: Link) -> dict:
    return {a: list(b) if isinstance(b, tuple) else dict(b) if isinstance(b, Mapping) else b for a, b in asdict(k).items() if b is not None}


def _link(d: dict) -> Link:
    d = dict(d)
    for f in ("reasons", "base_reasons"):
        if f in d:
            d[f] = tuple(d[f])
    return Link(**({"to_col": None} | d))


def save_session(spark: SparkSession, session: Session, path: str) -> None:
    """Write a session to a new folder that Spark can write to."""
    for name, df in session.tables.items():
        df.write.parquet(f"{path}/tables/{name}")
    manifest = {
        "version": VERSION,
        "tables": list(session.tables),
        **{f: [_plain(k) for k in getattr(session, f)] for f in ("detected", "manual", "declared")},
        "confirmed": {k: _plain(v) for k, v in session.review.confirmed.items()},
        "suppressed": sorted(session.review.suppressed),
        "overrides": session.review.overrides,
        "dictionary": session.dictionary,
        "declared_keys": session.declared_keys,
        "settings": session.settings,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_session(spark: SparkSession, path: str) -> Session:
    d = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if d.get("version") != VERSION:
        raise ValueError(f"a session of version {d.get('version')}, not {VERSION}")
    review = Review({k: _link(v) for k, v in d["confirmed"].items()}, set(d["suppressed"]), d["overrides"])
    tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in d["tables"]}
    lists = {f: [_link(k) for k in d[f]] for f in ("detected", "manual", "declared")}
    return Session(tables, review=review, dictionary=d["dictionary"], declared_keys=d["declared_keys"], settings=d["settings"], **lists)


def restore_into(current: Session, saved: Session) -> Session:
    """Tables, dictionary and declared keys replace present ones; links and reviews are added where not there yet."""
    add = lambda a, b: [*a, *[k for k in b if k.key not in {x.key for x in a}]]
    review = Review(saved.review.confirmed | current.review.confirmed, current.review.suppressed | saved.review.suppressed, saved.review.overrides | current.review.overrides)
    return Session(
        saved.tables, saved.detected, add(current.manual, saved.manual), add(current.declared, saved.declared), review, saved.dictionary, saved.declared_keys, saved.settings
    )
