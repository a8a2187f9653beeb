"""Registered queries over the test tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FORMATS, LABELS, PRIVATE_VALUES, WEIGHTS, Options
from .functions.naming import GENERIC_KEYS, ID_LIKE, clean_name, is_key_name, is_lookup_name, is_pk_name, name_signal, owns_key, strip_table_prefix, target_preference
from .functions.private import private_name
from .operators.dictionary import FORMAT_NAMES, build_dictionary, dictionary_frame, markdown
from .operators.erd import erd_frames, erd_model
from .operators.keys import detect_keys
from .operators.links import links_frame
from .operators.order_stats import example_values, numeric_ranges, time_ranges
from .operators.privacy import review_queue
from .operators.profile import column_stats, comparison_frame, length_medians, profile_frame, scan
from .operators.profile import null_patterns as null_patterns_of
from .operators.review import declared_link, scan_estimate
from .operators.shared import shared_columns, shared_scan
from .plans.discovery import Discovery, discover
from .sinks.diagrams import LINK_COLOURS, dbml, elk_json, mermaid, network_frames
from .sinks.documents import data_dict_yaml, dbt_yaml, links_csv, table_details
from .tables import TableSet, signatures

# The test tables and the kinds of their columns (n numeric, t time, s text, - not compared).
TABLES = {
    "region": "r_regionkey n, r_name s",
    "nation": "n_nationkey n, n_name s, n_regionkey n",
    "customer": "c_custkey n, c_name s, c_nationkey n, c_acctbal n, c_mktsegment s",
    "supplier": "s_suppkey n, s_name s, s_nationkey n, s_acctbal n",
    "part": "p_partkey n, p_name s, p_brand s, p_type s, p_size n, p_retailprice n",
    "orders": "o_orderkey n, o_custkey n, o_orderstatus s, o_totalprice n, o_orderdate t, o_orderpriority s",
    "lineitem": "l_orderkey n, l_partkey n, l_suppkey n, l_linenumber n, l_quantity n, l_extendedprice n, l_discount n, l_tax n, l_returnflag s, l_linestatus s, l_shipdate t",
    "events": "event_id n, ts t, user_id n, event_type s, value n, props s",
    "documents": "doc_id n, text s, lang s, source s, n_chars n",
    "embeddings": "vec_id n, embedding -, label n",
    "pages": "page_id n, url s, html s",
    "benchmark": "item_id n, text s",
    "labels": "doc_id n, quality n, toxic n",
    "conversations": "conv_id n, turn n, role s, text s",
}
COLUMNS = [(t, *c.split()) for t, cols in TABLES.items() for c in cols.split(", ")]


def load(spark: SparkSession, sf_dir: str) -> TableSet:
    return TableSet.from_parquet(spark, sf_dir, list(TABLES))


def _known(spark: SparkSession, sf_dir: str) -> Discovery:
    return discover(load(spark, sf_dir), track=False)


# ---------------------------------------------------------------- queries


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile_frame(load(spark, sf_dir))
    return out.select("table", "column", "n_rows", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("is_unique", F.lit(False)).alias("is_unique"), F.round("count_norm", 4).alias("count_norm"))


def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir)
    stats = [column_stats(t, df) for t, df in tables.items()]
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    out = out.join(length_medians(tables), ["table", "column"])
    return out.select("table", "column", F.col("len_min").cast("long"), "len_median", F.col("len_max").cast("long"))


def format_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = [column_stats(t, df) for t, df in load(spark, sf_dir).items()]
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out.where("kind IS NOT NULL").select("table", "column", "fingerprint")


def privacy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact details, invented from customers and suppliers, beside all text columns of the tables."""
    people = load(spark, sf_dir)["customer"].select(
        F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit("@example.com")).alias("contact"),
        F.when(F.col("c_custkey") % 10 != 0, F.format_string("%03d-555-%04d", F.col("c_custkey") % 1000, F.col("c_custkey") % 10000)).otherwise(F.lit(" n/a ")).alias("line"),
        F.format_string("%03d-%02d-%04d", F.col("c_custkey") % 1000, F.col("c_nationkey"), F.col("c_custkey") % 10000).alias("tax"),
        F.col("c_mktsegment").alias("segment"),
    )
    return column_stats("people", people).select("column", "private")


def numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_ranges(load(spark, sf_dir))


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_ranges(load(spark, sf_dir))


def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_values(load(spark, sf_dir)).select("table", "column", "k", "txt", "num")


def value_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison_frame(load(spark, sf_dir))


def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named like the table's key, unique, or both."""
    profiles = profile_frame(load(spark, sf_dir))
    named = spark.createDataFrame([(t, c) for t, c, _ in COLUMNS if is_pk_name(clean_name(c), strip_table_prefix(t))], "table string, column string").withColumn("named", F.lit(True))
    out = profiles.join(F.broadcast(named), ["table", "column"], "left")
    out = out.select("table", "column", F.coalesce("named", F.lit(False)).alias("named"), F.coalesce("is_unique", F.lit(False)).alias("is_unique"))
    return out.where("named OR is_unique")


def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir)
    keys = detect_keys(tables, scan(tables))
    return spark.createDataFrame([(t, i, c) for t, groups in keys.composite.items() for g in groups for i, c in enumerate(g)], "table string, place int, column string")


def shared_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the star schema with the prefixes of its column names taken off, so that names meet."""
    star = {t: df.toDF(*[c.split("_", 1)[1] for c in df.columns]) for t, df in load(spark, sf_dir).items() if t in ("customer", "supplier", "nation", "orders", "lineitem", "part")}
    rows = shared_columns(shared_scan(star), 0.3)
    return spark.createDataFrame(
        [(k.from_table, k.to_table, k.column, k.n_shared, k.n_distinct_from, k.n_distinct_to, round(k.overlap, 6), k.contained) for k in rows],
        "from_table string, to_table string, column string, n_shared bigint, n_distinct_from bigint, n_distinct_to bigint, overlap double, contained boolean",
    )


def null_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir)["orders"]
    one = orders.select("o_orderkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")).alias("x"))
    other = orders.select("o_orderkey", F.when((F.col("o_custkey") % 7 > 0) & (F.col("o_orderkey") % 5 > 0), F.col("o_totalprice")).alias("y"))
    both = {"one": one, "other": other}
    return null_patterns_of(both, scan(both, content=False), "o_orderkey").where("from_table = 'one'").select(F.round("r", 6).alias("r"))


def fk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all confidences with rivals resolved."""
    known = discover(load(spark, sf_dir), Options(min_confidence="low"), composites=False, track=False)
    out = links_frame(spark, known.detected)
    return out.select("from_table", "from_col", "to_table", "to_col", "detected_by", "confidence", F.round("score", 3).alias("score"), F.round("base_score", 3).alias("base_score"), "demoted")


def fk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each link, a row a signal."""
    out = links_frame(spark, _known(spark, sf_dir).detected)
    out = out.select("from_table", "from_col", "to_table", "to_col", F.explode("signals").alias("signal", "strength"))
    return out.withColumn("strength", F.round("strength", 6))


def self_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of nations below regions' numbers, told from its column names and values."""
    nation = load(spark, sf_dir)["nation"]
    tree = nation.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("parent_category_id"))
    links = discover({"categories": tree, "regions": load(spark, sf_dir)["region"]}, composites=False).detected
    own = [k for k in links if k.from_table == k.to_table]
    return links_frame(spark, own).select("from_table", "from_col", "to_table", "to_col", "detected_by", "confidence", "score")


# What a schema would declare of the test tables.
DECLARED = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def declared_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinality of declared links, and how much of each child's values its parent holds."""
    tables = load(spark, sf_dir)
    known = scan(tables)
    model = erd_model(known, [declared_link(*k) for k in DECLARED], detect_keys(tables, known, composites=False))
    rows = []
    for k in model.links:
        a, b = (k.link.from_table, k.link.from_col), (k.link.to_table, k.to_col)
        rows.append((*a, *b, k.child_max, k.parent_min, k.identifying, k.provenance, round(known.overlap(a, b), 6)))
    return spark.createDataFrame(rows, "from_table string, from_col string, to_table string, to_col string, child_max string, parent_min string, identifying boolean, provenance string, overlap double")


def scan_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir)
    rows = {r["table"]: r.n_rows for r in signatures({t: df.select(df.columns[0]) for t, df in tables.items()}).collect()}
    e = scan_estimate({t: (rows[t], len(df.columns)) for t, df in tables.items()})
    return spark.createDataFrame([tuple(e.values())], "n_tables bigint, total_cols bigint, total_rows bigint, max_rows bigint, est_pairs double, est_time_sec double, tier string")


def table_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(load(spark, sf_dir))


def _frame_of(name: str):
    return lambda spark, sf_dir: erd_frames(spark, _known(spark, sf_dir).model())[name]


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = discover(load(spark, sf_dir), composites=False, track=False)
    return spark.createDataFrame(
        [tuple(r) for r in table_details(known.scan, known.links(), known.keys)],
        "table string, table_rows bigint, table_cols bigint, column string, type string, non_null bigint, unique_vals bigint, is_pk boolean, is_fk boolean",
    )


def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir)
    return dictionary_frame(spark, build_dictionary(known.tables, known.scan, known.links(), known.keys)[0])


def privacy_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(review_queue(scan(load(spark, sf_dir)), {}), "table string, column string, reason string, n_values bigint")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text export of the found model, a row each."""
    known = _known(spark, sf_dir)
    model, links = known.model(), known.links()
    entries, documented = build_dictionary(known.tables, known.scan, links, known.keys)
    rows = [
        ("mermaid", mermaid(model)), ("dbml", dbml(model)), ("elk", elk_json(model, ref_labels=True, side=True)), ("dbt", dbt_yaml(known.scan, links, known.keys, model)),
        ("links", links_csv(links)), ("markdown", markdown(entries)), ("data_dict", data_dict_yaml(entries, documented)),
    ]
    return spark.createDataFrame(rows, "kind string, content string")


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir)
    return network_frames(spark, known.scan, known.links(), known.keys)[1]


QUERIES = {
    "column_profile": column_profile,
    "text_lengths": text_lengths,
    "format_fingerprints": format_fingerprints,
    "privacy_values": privacy_values,
    "numeric_range": numeric_range,
    "time_range": time_range,
    "top_examples": top_examples,
    "value_comparison": value_comparison,
    "key_candidates": key_candidates,
    "composite_keys": composite_keys,
    "shared_columns": shared_column_names,
    "null_patterns": null_patterns,
    "fk_links": fk_links,
    "fk_evidence": fk_evidence,
    "self_references": self_references,
    "declared_model": declared_model,
    "scan_complexity": scan_complexity,
    "table_signatures": table_signatures,
    "table_details": details,
    "erd_tables": _frame_of("erd_tables"),
    "erd_columns": _frame_of("erd_columns"),
    "erd_links": _frame_of("erd_links"),
    "data_dictionary": data_dictionary,
    "privacy_queue": privacy_queue,
    "exports": exports,
    "network_edges": network_edges,
}

# ---------------------------------------------------------------- the same in SQL


def _each(make, kinds: str = "nts") -> str:
    return "\nUNION ALL ".join(make(t, c, k) for t, c, k in COLUMNS if k in kinds)


def _text(c: str, k: str) -> str:
    """How a value reads."""
    return c if k == "s" else f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _counts() -> str:
    """Value counts of all compared columns."""
    value = {"n": "CAST(CAST({} AS DOUBLE) AS VARCHAR)", "t": "CAST({} AS VARCHAR)", "s": "{}"}
    return _each(lambda t, c, k: f"SELECT '{t}' AS t, '{c}' AS c, '{k}' AS k, {value[k].format(c)} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL")


def _compared() -> str:
    """CTEs vc, own and two: value counts, norms, and what ordered pairs of columns of different tables share."""
    return f"""vc AS ({_counts()}),
own AS (SELECT t, c, count(*) AS nd, sum(n::DOUBLE * n) AS sq FROM vc GROUP BY t, c),
two AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, count(*) AS n_shared, sum(a.n::DOUBLE * b.n) AS dot
 FROM vc a JOIN vc b ON a.k = b.k AND a.v = b.v AND a.t <> b.t GROUP BY ALL)"""


def _fingerprint(t: str, c: str, k: str) -> str:
    names = ("zip_us", "phone", "int_code") if k == "n" else [n for n, _ in FORMATS]
    tests = " ".join(f"WHEN avg(CASE WHEN regexp_matches(v, {_q(p)}, 'i') THEN 1.0 ELSE 0 END) >= 0.8 THEN '{n}'" for n, p in FORMATS if n in names)
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CASE {tests} END AS fingerprint FROM (SELECT {_text(c, k)} AS v FROM {t}) WHERE v IS NOT NULL"


def _private_sql() -> str:
    columns = {
        "contact": "lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com'",
        "line": "CASE WHEN c_custkey % 10 <> 0 THEN format('{:03d}-555-{:04d}', c_custkey % 1000, c_custkey % 10000) ELSE ' n/a ' END",
        "tax": "format('{:03d}-{:02d}-{:04d}', c_custkey % 1000, c_nationkey, c_custkey % 10000)",
        "segment": "c_mktsegment",
    }
    parts = []
    for name, e in columns.items():
        share = lambda p: f"avg(CASE WHEN regexp_matches(trim(v), {_q(p)}) THEN 1.0 ELSE 0 END)"
        tests = " ".join(f"WHEN {share(p)} >= 0.8 THEN CAST(CAST(round(100 * {share(p)}) AS INT) AS VARCHAR) || '% of values look like {w}'" for w, p in PRIVATE_VALUES)
        parts.append(f"SELECT '{name}' AS \"column\", CASE {tests} END AS private FROM (SELECT {e} AS v FROM customer) WHERE trim(v) <> ''")
    return "\nUNION ALL ".join(parts)


def _examples_sql(t: str, c: str, k: str) -> str:
    value = {"n": f"CAST({c} AS DOUBLE)", "t": f"CAST(epoch_us({c}) AS DOUBLE)", "s": c}[k]
    shown = "substring(v, 1, 30) AS txt, CAST(NULL AS DOUBLE) AS num" if k == "s" else "CAST(NULL AS VARCHAR) AS txt, v AS num"
    blank = f" AND trim({c}) <> ''" if k == "s" else ""
    return f"""(WITH d AS (SELECT DISTINCT {value} AS v FROM {t} WHERE {c} IS NOT NULL{blank}), r AS (SELECT v, row_number() OVER (ORDER BY v) AS p, count(*) OVER () AS n FROM d),
w AS (SELECT DISTINCT i + 1 AS k, CAST(round_even(1 + i * (n - 1) / greatest(least(n, 5) - 1, 1)::DOUBLE, 0) AS BIGINT) AS p FROM (SELECT max(n) AS n FROM r), (SELECT unnest(range(5)) AS i) WHERE i < least(n, 5))
SELECT '{t}' AS "table", '{c}' AS "column", CAST(w.k AS INTEGER) AS k, {shown} FROM r JOIN w ON r.p = w.p)"""


def _clock(c: str, how: str) -> str:
    """An aggregate of a time column, as text."""
    at = f"make_timestamp(CAST(floor({how}(epoch_us({c}))) AS BIGINT))"
    return f"CASE any_value(typeof({c})) WHEN 'DATE' THEN strftime({at}, '%Y-%m-%d') ELSE strftime({at}, '%Y-%m-%d %H:%M:%S') END"


def _shared_sql() -> str:
    star = {"customer": "c", "supplier": "s", "nation": "n", "orders": "o", "lineitem": "l", "part": "p"}
    order = [t for t in TABLES if t in star]
    names = {t: {c.split("_", 1)[1]: (c, k) for u, c, k in COLUMNS if u == t} for t in order}
    parts = []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            for short in names[a].keys() & names[b].keys():
                (x, kx), (y, ky) = names[a][short], names[b][short]
                if kx != ky:
                    continue
                parts.append(
                    f"SELECT '{a}' AS from_table, '{b}' AS to_table, '{short}' AS \"column\", (SELECT count(*) FROM (SELECT CAST({x} AS VARCHAR) FROM {a} INTERSECT SELECT CAST({y} AS VARCHAR) FROM {b})) AS n_shared, "
                    f"(SELECT count(DISTINCT {x}) FROM {a}) AS n_distinct_from, (SELECT count(DISTINCT {y}) FROM {b}) AS n_distinct_to, (SELECT count(*) FROM {a}) AS n1, (SELECT count(*) FROM {b}) AS n2"
                )
    return f"""WITH x AS ({' UNION ALL '.join(parts)}), y AS (SELECT *, least(n_distinct_from, n_distinct_to) AS m FROM x)
SELECT from_table, to_table, "column", n_shared, n_distinct_from, n_distinct_to, round(n_shared / m::DOUBLE, 6) AS overlap, n_shared = m AS contained
FROM y WHERE n_distinct_from < n1 AND n_distinct_to < n2 AND m >= 3 AND n_shared / m::DOUBLE >= 0.3"""


def _links_sql(select: str, least: float = 0.0, more: str = "") -> str:
    """All of candidate generation, signals, scores, veto and arbitration, with name signals as constants: `select` from
    lk, the links whose first scores are `least` or more, and from further CTEs.

    Self-references, lookup names and empty tables don't occur here; unique key-named columns that their table doesn't own
    (one-to-one sources) are found by name. No NULL patterns.
    """
    tables = list(TABLES)
    cols = ", ".join(
        f"({tables.index(t)}, '{t}', {[c for u, c, _ in COLUMNS if u == t].index(c)}, '{c}', '{k}', {str(is_key_name(clean_name(c))).lower()}, "
        f"{str(is_key_name(clean_name(c)) and not owns_key(clean_name(c), strip_table_prefix(t))).lower()})"
        for t, c, k in COLUMNS
        if k != "-"
    )
    names = []
    for t, c, k in COLUMNS:
        for u, d, j in COLUMNS:
            if t != u and k == j != "-":
                s = name_signal(c, u, d)
                own = owns_key(clean_name(c), strip_table_prefix(u))
                if s or own or target_preference(clean_name(d), clean_name(c)):
                    signal = f"'{s.signal}', {s.strength!r}::DOUBLE" if s else "NULL, NULL"
                    names.append(f"('{t}', '{c}', '{u}', '{d}', {signal}, {target_preference(clean_name(d), clean_name(c))}, {str(own).lower()})")
    stats = _each(
        lambda t, c, k: f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count(*) - count({c}) AS nn, " + (f"median(length({c}))" if k == "s" else "NULL") + f" AS len FROM {t}"
    )
    prints = _each(_fingerprint, "ns") + "".join(f"\nUNION ALL SELECT '{t}', '{c}', 'iso_ts'" for t, c, k in COLUMNS if k == "t")
    weight = " ".join(f"WHEN '{s}' THEN {1 - w:.2f}::DOUBLE" for s, w in WEIGHTS.items())
    label = " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in LABELS.items())
    left = lambda c: f"(CASE {c} {weight} ELSE 1.0::DOUBLE END)"
    return f"""WITH {_compared()},
cols(ti, t, ci, c, k, key_named, one) AS (VALUES {cols}),
nm(t1, c1, t2, c2, sig, strength, pref, own) AS (VALUES {', '.join(names)}),
st AS ({stats}),
fp AS ({prints}),
p AS (SELECT cols.*, st.n, st.nn, coalesce(own.nd, 0) AS nd, st.len, fp.fingerprint AS f, coalesce(own.nd, 0) = st.n AND st.nn = 0 AS u
 FROM cols JOIN st ON st.t = cols.t AND st.c = cols.c LEFT JOIN own ON own.t = cols.t AND own.c = cols.c LEFT JOIN fp ON fp."table" = cols.t AND fp."column" = cols.c),
q AS (SELECT *, u AND k <> 't' AND coalesce(len, 0) <= 60 AS target FROM p),
r AS (SELECT *, NOT target AND nd > 0 AND NOT (nd <= 2 AND n > 10 AND NOT key_named) AND coalesce(len, 0) <= 80 AS refers, target AND one AS single,
 bool_or(target) OVER (PARTITION BY t) AS has_key FROM q),
rk AS (SELECT t, row_number() OVER (ORDER BY max(n) DESC, t) AS place FROM p GROUP BY t),
cand AS (SELECT a.t AS t1, a.c AS c1, a.single, a.k, b.t AS t2, b.c AS c2, b.ti AS ti2, b.ci AS ci2, a.nd AS nd1, b.nd AS nd2, a.f AS f1, b.f AS f2, ra.place AS p1, rb.place AS p2, nm.sig, nm.strength, coalesce(nm.pref, 0) AS pref,
 coalesce(w.n_shared, 0) AS n_shared, coalesce(w.n_shared, 0) / a.nd::DOUBLE AS ov, coalesce(w.dot / sqrt(oa.sq * ob.sq), 0) AS cosine
 FROM r a JOIN r b ON a.t <> b.t AND a.k = b.k AND (a.refers OR a.single) AND (CASE WHEN a.single THEN b.target AND b.c = a.c WHEN b.has_key THEN b.target ELSE b.refers END)
 JOIN rk ra ON ra.t = a.t JOIN rk rb ON rb.t = b.t
 JOIN own oa ON oa.t = a.t AND oa.c = a.c JOIN own ob ON ob.t = b.t AND ob.c = b.c
 LEFT JOIN nm ON nm.t1 = a.t AND nm.c1 = a.c AND nm.t2 = b.t AND nm.c2 = b.c
 LEFT JOIN two w ON w.t1 = a.t AND w.c1 = a.c AND w.t2 = b.t AND w.c2 = b.c
 WHERE NOT a.single OR rb.place < ra.place OR coalesce(nm.own, false)),
sig AS (SELECT *, CASE WHEN ov >= 0.98 THEN 'overlap_high' WHEN ov >= 0.8 THEN 'overlap_medium' END AS s_ov, CASE WHEN nd1 = nd2 AND n_shared = nd1 THEN 'cardinality_match' END AS s_card,
 CASE WHEN f1 = f2 THEN 'format_match' END AS s_fmt, CASE WHEN cosine >= 0.9 THEN 'dist_high' WHEN cosine >= 0.75 THEN 'dist_med' END AS s_dist FROM cand),
sc AS (SELECT *, round(1 - {left('sig')} * {left('s_ov')} * {left('s_card')} * {left('s_fmt')} * {left('s_dist')} + 1e-12, 3) AS raw,
 coalesce(sig IN ('naming_exact', 'naming_role', 'naming_self'), false) AS strong FROM sig WHERE coalesce(sig, s_ov, s_card, s_fmt, s_dist) IS NOT NULL),
tr AS (SELECT *, CASE WHEN raw >= 0.55 AND ov < 0.5 AND NOT strong THEN 0.54 ELSE raw END AS score FROM sc),
best AS (SELECT * FROM (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY t1, c1, t2 ORDER BY score DESC, pref DESC, ci2) = 1) WHERE score >= {least}),
par AS (SELECT * FROM best QUALIFY NOT single OR row_number() OVER (PARTITION BY t1, c1 ORDER BY score DESC, p2) = 1),
lab AS (SELECT *, CASE (SELECT x FROM (VALUES (sig, 1), (s_ov, 2), (s_card, 3), (s_fmt, 4), (s_dist, 5)) v(x, o) WHERE x IS NOT NULL ORDER BY CASE x {weight} END, o LIMIT 1) {label} END AS detected_by,
 coalesce(s_card IS NOT NULL OR s_ov = 'overlap_high', false) AS fits, coalesce(sig IN ('name_identical', 'name_sim'), false) AS closes FROM par),
grp AS (SELECT *, count(*) OVER g AS size, bool_or(strong) OVER g AS any_strong, count(*) FILTER (WHERE fits) OVER g AS n_fits, count(*) FILTER (WHERE fits AND closes) OVER g AS n_close,
 string_agg(CASE WHEN strong THEN t2 END, ', ') OVER g AS strong_names, min(CASE WHEN fits AND closes THEN t2 END) OVER g AS close_name,
 list_aggregate(list_sort(list(CASE WHEN fits THEN t2 END) FILTER (WHERE fits) OVER g)[1:6], 'string_agg', ', ') AS fit_names
 FROM lab WINDOW g AS (PARTITION BY t1, c1)),
dem AS (SELECT *, CASE WHEN size < 2 THEN NULL WHEN any_strong THEN CASE WHEN NOT strong THEN 'name points to ' || strong_names END
 WHEN n_fits >= 2 AND fits AND n_close = 1 AND NOT closes THEN 'name is closest to ' || close_name
 WHEN n_fits >= 2 AND fits AND n_close <> 1 THEN 'ambiguous: values fit ' || n_fits || ' tables (' || fit_names || ')' END AS demoted FROM grp),
fin AS (SELECT *, max(CASE WHEN demoted IS NULL THEN score END) OVER (PARTITION BY t1, c1) AS top FROM dem),
lk AS (SELECT t1 AS from_table, c1 AS from_col, t2 AS to_table, c2 AS to_col, detected_by,
CASE WHEN demoted IS NOT NULL THEN 'low' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence,
round(CASE WHEN demoted IS NOT NULL THEN least(score, 0.54) * 0.9 + 1e-12 ELSE score END, 3) AS score, score AS base_score, demoted,
sig, strength, s_ov, ov, s_card, s_fmt, s_dist, cosine
FROM fin WHERE demoted IS NOT NULL OR score >= top - 0.05){more}
{select}"""


def _composite_sql(select: str) -> str:
    """`select` from comp (t, cols): the first set of two, else three, columns of each table that tells all rows apart."""
    stats = _each(lambda t, c, k: f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count(*) - count({c}) AS nn, count(DISTINCT {c}) AS nd, " + (f"median(length({c}))" if k == "s" else "NULL") + f" AS len FROM {t}")
    sets, counts = [], []
    for t in TABLES:
        cols = sorted((c for u, c, k in COLUMNS if u == t and k != "-"), key=lambda c: not ID_LIKE.search(clean_name(c)))  # stable: ids first
        some = [*combinations(cols, 2), *combinations(cols, 3)]
        sets += [f"('{t}', {o}, '{x[0]}', '{x[1]}', {_q(x[2]) if len(x) > 2 else 'NULL'})" for o, x in enumerate(some, 1)]
        counts.append(f"SELECT '{t}' AS t, count(*) AS n, [{', '.join(f'count(DISTINCT hash({", ".join(x)}))' for x in some)}]::BIGINT[] AS k FROM {t}")
    return f"""WITH fs AS ({stats}), named(t, c) AS (VALUES {NAMED_KEYS}),
fit AS (SELECT t, c, nd::DOUBLE AS nd, nn = 0 AND nd > 0 AND nd < n AND coalesce(len, 0) <= 80 AND n >= 2
 AND t NOT IN (SELECT s.t FROM fs s JOIN named ON named.t = s.t AND named.c = s.c WHERE s.nn = 0 AND s.nd = s.n) AS ok FROM fs),
sets(t, o, a, b, c) AS (VALUES {', '.join(sets)}),
sizes AS ({" UNION ALL ".join(counts)}),
comp AS (SELECT s.t, arg_min(list_filter([s.a, s.b, s.c], lambda x: x IS NOT NULL), s.o) AS cols FROM sets s JOIN sizes z ON z.t = s.t JOIN fit f ON f.t = s.t AND f.c = s.a JOIN fit g ON g.t = s.t AND g.c = s.b
 LEFT JOIN fit h ON h.t = s.t AND h.c = s.c WHERE f.ok AND g.ok AND coalesce(h.ok, true) AND f.nd * g.nd * coalesce(h.nd, 1) >= z.n AND z.k[s.o] = z.n GROUP BY s.t)
{select}"""


def _erd_sql(select: str, where: str = "", further: str = "") -> str:
    """`select` from the model of the links of the default confidence, or of some of them: em (links), cx (columns), areas
    (tables with roles), and further CTEs."""
    truth = lambda x: str(bool(x)).lower()
    facts = []
    for t in TABLES:
        for i, (c, k) in enumerate((c, k) for u, c, k in COLUMNS if u == t):
            n = clean_name(c)
            facts.append(f"('{t}', '{c}', {i}, '{k}', {truth(is_pk_name(n, strip_table_prefix(t)))}, {truth(n in GENERIC_KEYS)}, {truth(owns_key(n, t))}, {truth(is_key_name(n))})")
    tables = ", ".join(f"('{t}', {len(x.split(', '))}, {truth(is_lookup_name(t))})" for t, x in TABLES.items())
    kind = {
        "n": "CASE WHEN coalesce(bool_and(CAST({0} AS DOUBLE) = floor(CAST({0} AS DOUBLE))), true) THEN 'int' ELSE 'float' END",
        "t": "CASE any_value(typeof({0})) WHEN 'DATE' THEN 'date' ELSE 'datetime' END", "s": "'string'", "-": "'string'",
    }
    stats = _each(lambda t, c, k: f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count(*) - count({c}) AS nn, {'0' if k == '-' else f'count(DISTINCT {c})'} AS nd, {kind[k].format(c)} AS kind FROM {t}", "nts-")
    more = f""",
lm AS (SELECT * FROM lk {where}),
{_composite_sql("").removeprefix("WITH ").rstrip()},
nf(t, c, i, k, pkn, generic, owns, keyn) AS (VALUES {', '.join(facts)}), tf(t, width, lookup) AS (VALUES {tables}),
es AS ({stats}),
cf AS (SELECT nf.*, es.n, es.nn, es.nd, es.kind, nf.k <> '-' AND es.n > 0 AND es.nn = 0 AND es.nd = es.n AS u, CASE WHEN generic THEN 3 WHEN owns THEN 2 WHEN keyn THEN 1 ELSE 0 END AS worth FROM nf JOIN es ON es.t = nf.t AND es.c = nf.c),
nfk AS (SELECT from_table AS t, count(DISTINCT from_col) AS n FROM lm GROUP BY 1),
one AS (SELECT * FROM cf WHERE u AND (kind IN ('int', 'string') OR generic OR keyn) QUALIFY row_number() OVER (PARTITION BY t ORDER BY worth DESC, pkn DESC, i) = 1),
pk AS (SELECT tf.t, CASE WHEN one.c IS NULL OR (one.worth = 0 AND coalesce(nfk.n, 0) >= 2) THEN coalesce(comp.cols, []) ELSE [one.c] END AS cols
 FROM tf LEFT JOIN one ON one.t = tf.t LEFT JOIN nfk ON nfk.t = tf.t LEFT JOIN comp ON comp.t = tf.t),
em AS (SELECT lm.*, CASE WHEN a.u THEN 'one' ELSE 'many' END AS child_max, CASE WHEN a.nn > 0 THEN 'zero' ELSE 'one' END AS parent_min, list_contains(pk.cols, lm.from_col) AS identifying
 FROM lm JOIN cf a ON a.t = lm.from_table AND a.c = lm.from_col JOIN pk ON pk.t = lm.from_table),
rf AS (SELECT DISTINCT from_table AS t, from_col AS c FROM em),
tg AS (SELECT DISTINCT to_table AS t, to_col AS c FROM em),
cx AS (SELECT cf.*, list_contains(pk.cols, cf.c) AS is_pk, rf.c IS NOT NULL AS refers, tg.c IS NOT NULL AS targeted
 FROM cf JOIN pk ON pk.t = cf.t LEFT JOIN rf ON rf.t = cf.t AND rf.c = cf.c LEFT JOIN tg ON tg.t = cf.t AND tg.c = cf.c),
tx AS (SELECT t, any_value(n) AS n_rows, count(*) FILTER (WHERE refers) AS n_refer, count(*) FILTER (WHERE is_pk) AS n_pk, count(*) FILTER (WHERE is_pk AND NOT refers) AS n_own, count(*) FILTER (WHERE NOT is_pk AND NOT refers) AS n_plain FROM cx GROUP BY t),
ends AS (SELECT from_table AS t FROM em UNION SELECT to_table FROM em),
kids AS (SELECT to_table AS t, count(DISTINCT from_table) AS n FROM em WHERE from_table <> to_table GROUP BY 1),
ups AS (SELECT from_table AS t, count(*) AS n FROM em WHERE from_table <> to_table GROUP BY 1),
roles AS (SELECT tx.*, tf.lookup, tf.width, CASE WHEN n_refer >= 2 AND ((n_pk > 0 AND n_own = 0) OR n_plain = 0) THEN 'junction' WHEN lookup THEN 'lookup' WHEN ends.t IS NOT NULL THEN 'entity' ELSE 'orphan' END AS role,
 coalesce(kids.n, 0) AS children, coalesce(ups.n, 0) AS parents FROM tx JOIN tf ON tf.t = tx.t LEFT JOIN ends ON ends.t = tx.t LEFT JOIN kids ON kids.t = tx.t LEFT JOIN ups ON ups.t = tx.t),
beside AS (SELECT t, n_rows FROM roles WHERE role NOT IN ('lookup', 'orphan')),
edge AS (SELECT from_table AS a, to_table AS b FROM em UNION SELECT to_table, from_table FROM em),
reach(a, b) AS (SELECT t, t FROM beside UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b JOIN beside ON beside.t = edge.b),
largest AS (SELECT reach.a AS t, beside.t AS area FROM reach JOIN beside ON beside.t = reach.b QUALIFY row_number() OVER (PARTITION BY reach.a ORDER BY beside.n_rows DESC, beside.t) = 1),
areas AS (SELECT roles.*, CASE role WHEN 'lookup' THEN 'Lookups' WHEN 'orphan' THEN 'Unconnected' ELSE largest.area END AS area FROM roles LEFT JOIN largest ON largest.t = roles.t){further}"""
    return _links_sql(select, 0.55, more).replace("WITH vc AS", "WITH RECURSIVE vc AS", 1)


def _reason_sql(t: str, c: str, k: str) -> str:
    """Why a column looks personal; by its name as a constant, else by its values."""
    if by_name := private_name(c):
        reason = _q(by_name)
    elif k == "s":
        share = lambda p: f"avg(CASE WHEN regexp_matches(trim({c}), {_q(p)}) THEN 1.0 ELSE 0 END) FILTER (WHERE trim({c}) <> '')"
        reason = "CASE " + " ".join(f"WHEN {share(p)} >= 0.8 THEN CAST(CAST(round(100 * {share(p)}) AS INT) AS VARCHAR) || '% of values look like {w}'" for w, p in PRIVATE_VALUES) + " END"
    else:
        reason = "CAST(NULL AS VARCHAR)"
    return f"SELECT '{t}' AS t, '{c}' AS c, {reason} AS reason, count({c}) AS n_values FROM {t}"


def _dictionary_sql() -> str:
    number = lambda x: f"rtrim(rtrim(printf('%.10f', CAST(format('{{:.6g}}', CAST({x} AS DOUBLE)) AS DOUBLE)), '0'), '.')"

    def spans(t: str, c: str, k: str) -> str:
        texts = [number(f"{how}({c})") if k == "n" else _clock(c, how) if k == "t" else "''" for how in ("min", "median", "max")]
        sizes = [f"CAST(min(length({c})) AS INTEGER)", f"median(length({c}))", f"CAST(max(length({c})) AS INTEGER)"] if k == "s" else ["CAST(NULL AS INTEGER)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS INTEGER)"]
        named = [*zip(("lo", "mid", "hi"), texts, strict=True), *zip(("len_min", "len_median", "len_max"), sizes, strict=True)]
        return f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, {', '.join(f'coalesce({x}, \'\') AS {n}' if n in ('lo', 'mid', 'hi') else f'{x} AS {n}' for n, x in named)} FROM {t}"

    formats = " ".join(f"WHEN '{f}' THEN '{name}'" for f, name in FORMAT_NAMES.items())
    further = f""",
sp AS ({_each(spans, "nts-")}),
rs AS ({_each(_reason_sql, "nts-")}),
ex AS (SELECT "table" AS t, "column" AS c, string_agg(CASE WHEN num IS NULL THEN txt WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE CAST(num AS VARCHAR) END, ', ' ORDER BY k) AS shown
 FROM ({_each(_examples_sql, "ns")}) GROUP BY 1, 2),
re AS (SELECT from_table AS t, from_col AS c, string_agg(to_table || '.' || to_col, '; ' ORDER BY to_table) AS refer, string_agg('detected', '; ') AS source FROM em GROUP BY 1, 2),
dc AS (SELECT cx.*, CASE WHEN refers THEN row_number() OVER (PARTITION BY cx.t, refers ORDER BY i) END AS fk FROM cx)"""
    return _erd_sql(
        f"""SELECT dc.t AS "table", '' AS table_description, dc.c AS "column", CAST(dc.i + 1 AS INTEGER) AS position, dc.kind AS type,
CASE WHEN dc.k = 't' THEN dc.kind WHEN dc.k = 'n' THEN CASE WHEN dc.nd = 0 THEN 'number' WHEN dc.kind = 'int' THEN 'whole number' ELSE 'decimal' END ELSE CASE fp.fingerprint {formats} ELSE 'text' END END AS format,
dc.nn > 0 AS nullable, round(100.0::DOUBLE * dc.nn / dc.n, 1) AS pct_missing, CASE WHEN dc.k <> '-' THEN dc.nd END AS n_unique, sp.len_min, sp.len_median, sp.len_max,
CASE WHEN rs.reason IS NOT NULL AND sp.lo <> '' THEN 'hidden' ELSE sp.lo END AS min, CASE WHEN rs.reason IS NOT NULL AND sp.lo <> '' THEN 'hidden' ELSE sp.mid END AS median, CASE WHEN rs.reason IS NOT NULL AND sp.lo <> '' THEN 'hidden' ELSE sp.hi END AS max,
concat_ws(', ', CASE WHEN dc.is_pk THEN 'PK' END, 'FK' || dc.fk, CASE WHEN dc.u AND NOT dc.is_pk AND (dc.targeted OR dc.keyn) THEN 'UK' END) AS keys, coalesce(re.refer, '') AS "references", coalesce(re.source, '') AS reference_source,
rs.reason IS NOT NULL AS private, CASE WHEN rs.reason IS NOT NULL THEN 'auto_unreviewed' ELSE 'none' END AS privacy_status, coalesce(rs.reason, '') AS privacy_reason,
CASE WHEN rs.reason IS NULL THEN coalesce(ex.shown, '') ELSE '' END AS examples, CASE WHEN rs.reason IS NULL THEN '' ELSE 'private' END AS examples_note, '' AS label, '' AS description, '' AS units, '' AS "values", '' AS details
FROM dc JOIN sp ON sp.t = dc.t AND sp.c = dc.c JOIN rs ON rs.t = dc.t AND rs.c = dc.c LEFT JOIN ex ON ex.t = dc.t AND ex.c = dc.c LEFT JOIN re ON re.t = dc.t AND re.c = dc.c LEFT JOIN fp ON fp."table" = dc.t AND fp."column" = dc.c""",
        "WHERE confidence <> 'low'",
        further,
    )


NAMED_KEYS = ", ".join(f"('{t}', '{c}')" for t, c, _ in COLUMNS if is_pk_name(clean_name(c), strip_table_prefix(t)))
N_COLUMNS = len(COLUMNS)
#: How types read here and there.
SPARK_TYPES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "DATE": "date", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>"}.items())

ORACLE = {
    "fk_links": _links_sql("SELECT from_table, from_col, to_table, to_col, detected_by, confidence, score, base_score, demoted FROM lk"),
    "fk_evidence": _links_sql(
        "\nUNION ALL ".join(
            f"SELECT from_table, from_col, to_table, to_col, {signal} AS signal, round({strength}, 6) AS strength FROM lk WHERE {signal} IS NOT NULL"
            for signal, strength in (("sig", "strength"), ("s_ov", "ov"), ("s_card", "1.0::DOUBLE"), ("s_fmt", "0.6::DOUBLE"), ("s_dist", "cosine"))
        ),
        0.55,
    ),
    "network_edges": _links_sql(
        'SELECT from_table AS "from", to_table AS "to", from_col || \' \u2192 \' || to_col AS label, CASE detected_by '
        + " ".join(f"WHEN '{d}' THEN '{colour}'" for d, colour in LINK_COLOURS.items())
        + " ELSE '#94a3b8' END AS colour, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS width, confidence = 'low' AS dashes, concat_ws('|', from_table, from_col, to_table, to_col) AS key FROM lk",
        0.55,
    ),
    "erd_links": _erd_sql("SELECT from_table, from_col, to_table, to_col, child_max, 'zero' AS child_min, parent_min, identifying, false AS self_ref, 'inferred' AS provenance, confidence, score FROM em"),
    "erd_columns": _erd_sql(
        """SELECT t AS "table", c AS "column", CAST(row_number() OVER (PARTITION BY t ORDER BY is_pk DESC, i) - 1 AS INTEGER) AS place, kind AS type, nn > 0 AS nullable, u AS is_unique, is_pk AS pk,
CASE WHEN refers THEN CAST(row_number() OVER (PARTITION BY t, refers ORDER BY i) AS INTEGER) END AS fk_index, u AND NOT is_pk AND (targeted OR keyn) AS uk FROM cx"""
    ),
    "erd_tables": _erd_sql(
        """SELECT t AS "table", n_rows, role, children > 0 AND parents = 0 AND (lookup OR (n_rows <= 500 AND width <= 4) OR (children >= 3 AND width <= 6)) AS is_reference, area AS subject_area FROM areas"""
    ),
    "data_dictionary": _dictionary_sql(),
    "privacy_queue": f"SELECT t AS \"table\", c AS \"column\", reason, n_values FROM ({_each(_reason_sql, 'nts-')}) WHERE reason IS NOT NULL",
    "composite_keys": _composite_sql('SELECT t AS "table", CAST(unnest(range(len(cols))) AS INTEGER) AS place, unnest(cols) AS "column" FROM comp'),
    "time_range": _each(
        lambda t, c, k: f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {', '.join(f'{_clock(c, e)} AS {n}' for e, n in (('min', 'min'), ('median', 'median'), ('max', 'max')))} FROM {t} HAVING count({c}) > 0",
        "t",
    ),
    "column_profile": _each(
        lambda t, c, k: f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, CAST(0 AS BIGINT) AS n_distinct, false AS is_unique, 0.0::DOUBLE AS count_norm FROM {t}"
        if k == "-"
        else f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) - count({c}) FROM {t}) AS n_null, count(*) AS n_distinct, count(*) = (SELECT count(*) FROM {t}) AS is_unique, round(sqrt(sum(n::DOUBLE * n)), 4) AS count_norm FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})",
        "nts-",
    ),
    "text_lengths": _each(lambda t, c, k: f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", min(length({c})) AS len_min, median(length({c})) AS len_median, max(length({c})) AS len_max FROM {t}", "s"),
    "format_fingerprints": _each(lambda t, c, k: _fingerprint(t, c, k) if k != "t" else f"SELECT '{t}', '{c}', CASE any_value(typeof({c})) WHEN 'DATE' THEN 'iso_date' ELSE 'iso_ts' END FROM {t}"),
    "privacy_values": _private_sql(),
    "numeric_range": _each(lambda t, c, k: f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(median({c}) AS DOUBLE) AS median, CAST(max({c}) AS DOUBLE) AS max FROM {t}", "n"),
    "top_examples": _each(_examples_sql),
    "value_comparison": f"""WITH {_compared()}
SELECT t1 AS from_table, c1 AS from_col, t2 AS to_table, c2 AS to_col, n_shared, round(n_shared / a.nd::DOUBLE, 6) AS overlap, n_shared = a.nd AND a.nd = b.nd AS same_set, round(dot / sqrt(a.sq * b.sq), 6) AS cosine
FROM two JOIN own a ON a.t = t1 AND a.c = c1 JOIN own b ON b.t = t2 AND b.c = c2""",
    "key_candidates": f"""WITH p AS ({_each(lambda t, c, k: f"SELECT '{t}' AS t, '{c}' AS c, count(*) > 0 AND count(DISTINCT {c}) = count(*) AS u FROM {t}")}),
named(t, c) AS (VALUES {NAMED_KEYS})
SELECT p.t AS "table", p.c AS "column", named.t IS NOT NULL AS named, u AS is_unique FROM p LEFT JOIN named ON p.t = named.t AND p.c = named.c WHERE u OR named.t IS NOT NULL""",
    "shared_columns": _shared_sql(),
    "null_patterns": """SELECT round(corr(CASE WHEN o_custkey % 7 > 0 THEN 0.0 ELSE 1.0 END, CASE WHEN o_custkey % 7 > 0 AND o_orderkey % 5 > 0 THEN 0.0 ELSE 1.0 END), 6) AS r FROM orders""",
    "self_references": """SELECT 'categories' AS from_table, 'parent_category_id' AS from_col, 'categories' AS to_table, 'category_id' AS to_col, 'naming' AS detected_by, 'high' AS confidence, 0.9::DOUBLE AS score
FROM nation HAVING avg(CASE WHEN n_regionkey IN (SELECT n_nationkey FROM nation) THEN 1.0 ELSE 0 END) >= 0.8""",
    "declared_model": "\nUNION ALL ".join(
        f"""SELECT '{a}' AS from_table, '{b}' AS from_col, '{c}' AS to_table, '{d}' AS to_col,
CASE WHEN count(DISTINCT {b}) = count(*) THEN 'one' ELSE 'many' END AS child_max, CASE WHEN count({b}) < count(*) THEN 'zero' ELSE 'one' END AS parent_min,
{'count(DISTINCT ' + b + ') = count(*)' if b == 'doc_id' else 'false'} AS identifying, 'declared' AS provenance,
round((SELECT count(*) FROM (SELECT {b} FROM {a} INTERSECT SELECT {d} FROM {c})) / count(DISTINCT {b})::DOUBLE, 6) AS overlap FROM {a}"""
        for a, b, c, d in DECLARED
    ),
    "scan_complexity": f"""WITH n AS ({' UNION ALL '.join(f'SELECT count(*) AS r FROM {t}' for t in TABLES)}),
s AS (SELECT count(*) AS n_tables, {N_COLUMNS} AS total_cols, sum(r)::BIGINT AS total_rows, max(r) AS max_rows FROM n),
e AS (SELECT *, 0.4::DOUBLE * total_cols * (n_tables - 1) * greatest(0.15::DOUBLE * total_cols / n_tables, 1) AS p FROM s),
f AS (SELECT *, p * CASE WHEN max_rows > 5000 THEN 20 WHEN max_rows > 500 THEN 5 ELSE 1 END / 1000.0::DOUBLE AS sec FROM e)
SELECT n_tables, CAST(total_cols AS BIGINT) AS total_cols, total_rows, max_rows, round(p) AS est_pairs, round(sec, 1) AS est_time_sec,
CASE WHEN p < 2000 OR sec < 5 THEN 'fast' WHEN p < 15000 OR sec < 30 THEN 'moderate' ELSE 'slow' END AS tier FROM f""",
    "table_details": _links_sql(
        "SELECT d.*, f.c IS NOT NULL AS is_fk FROM dt d LEFT JOIN (SELECT DISTINCT from_table AS t, from_col AS c FROM lk) f ON f.t = d.\"table\" AND f.c = d.\"column\"",
        0.55,
        ",\ndt AS (" + _each(
            lambda t, c, k: f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS table_rows, CAST({len(TABLES[t].split(', '))} AS BIGINT) AS table_cols, '{c}' AS \"column\", (SELECT CASE any_value(typeof({c})) {SPARK_TYPES} END FROM {t}) AS type, (SELECT count({c}) FROM {t}) AS non_null, "
            + ("CAST(0 AS BIGINT)" if k == "-" else f"(SELECT count(DISTINCT {c}) FROM {t})")
            + " AS unique_vals, "
            + ("true" if (t, c) in {(a, b) for a, b, _ in COLUMNS if is_pk_name(clean_name(b), strip_table_prefix(a))} else "false" if k == "-" else f"(SELECT count(*) > 0 AND count(DISTINCT {c}) = count(*) FROM {t})")
            + " AS is_pk",
            "nts-",
        ) + ")",
    ),
}
