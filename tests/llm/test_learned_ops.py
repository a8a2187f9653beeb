"""Language ID, near-duplicates, nearest neighbours, quality rules and the pipeline: held-out accuracy, brute force and odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablekin.llm._common import WordHashes, written
from tablekin.llm.ann import ListIndex, brute_force, nearest_neighbours
from tablekin.llm.components import connected_components
from tablekin.llm.language_id import ByteGRU, Windows, identify_languages, predict_language, train_language_id
from tablekin.llm.near_dup import OrderMinHash, banded_distance, near_duplicates, similar, without_near_duplicates
from tablekin.llm.quality_forest import IsolationForest, brute_stats, quality_rules, text_stats, train_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component long, _text string, n int"
SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2) for r in rows], DOCS)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_is_exact_within_the_band():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
            if rng.random() < 0.5:
                del b[rng.randrange(len(b))]
        most = rng.randint(0, 14)
        assert banded_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_sketches_tell_order():
    omh, cache = OrderMinHash(64, 2, 1), WordHashes()
    words = [b"w%d" % i for i in range(40)]
    straight, turned = omh.sketch(cache.of(words)), omh.sketch(cache.of(words[::-1]))
    assert (straight == omh.sketch(cache.of(words))).all() and (straight == turned).sum() == 0
    assert len(omh.sketch(cache.of([]))) == 0


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda n: rng.choices(vocabulary, k=n)
    rows, classes, ident = [], [], 0
    passage = text(60)
    for _ in range(25):
        base = text(rng.choice([30, 80, 300]))
        group = []
        for copy in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(0 if copy == 0 else len(base) // 30):
                words[rng.randrange(len(words))] = "zzz"
            group.append(ident)
            rows.append((ident, " ".join(words), "en", "s"))
            ident += 1
        classes.append(group)
    for _ in range(30):  # one passage that many share is no near-duplicate
        rows.append((ident, " ".join(text(100) + passage + text(80)), "en", "s"))
        classes.append([ident])
        ident += 1
    for _ in range(40):
        rows.append((ident, rows[0][1], "en", "s"))
        classes[0].append(ident)
        ident += 1
    return rows, classes


def test_near_duplicates_against_all_pairs(spark):
    rows, classes = corpus()
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, " \n", "en", "s"), (None, "a b", "en", "s"), (903, "a b", "en", "s"), (904, "solo", "en", "s"), rows[1], rows[1]]
    got = near_duplicates(docs_of(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: r.class_id for r in got}
    for group in classes:
        assert {found[i] for i in group} == {min(group)}
    assert [found[i] for i in (900, 901, 902, 904)] == [900, 901, 902, 904]
    assert found[None] is None and found[903] is None
    texts = {i: t.split() for i, t, *_ in rows}
    member = {i: k for k, g in enumerate(classes) for i in g}
    some = random.Random(2).sample(sorted(texts), 40)
    for a in some:
        for b in some:
            if member[a] != member[b]:
                assert not similar(texts[a], texts[b], 0.8)
    kept = without_near_duplicates(docs_of(spark, rows + odd))
    assert kept.columns == docs_of(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i for i in found if found[i] == i} | {None})
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 302), (302, 300), (302, 302), (301, 300)]
    random.Random(0).shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 260)} | {300: 300, 301: 300, 302: 300}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = ByteGRU(["a", "b", "c"], hidden=5)
    net.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    cut = Windows([b"hello there you", b"x", b"worlds", b"ab" * 9], 6, 2)
    ids, mask, body = cut.batch(np.arange(len(cut)))
    batch, labels = (ids, mask.astype(float), body.astype(float)), np.array([0, 1, 2, 1])[cut.text]
    _, grad = net.loss(batch, labels)
    for k, p in net.p.items():
        at = (3, ord("o")) if k == "x" else tuple(rng.integers(0, n) for n in p.shape)
        old, ends = p[at], []
        for step in (1e-4, -1e-4):
            p[at] = old + step
            ends.append(net.loss(batch, labels)[0])
        p[at] = old
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(grad[k][at], abs=1e-6)


def test_windows_label_each_byte_once():
    rng = random.Random(2)
    texts = [bytes(rng.choices(range(256), k=n)) for n in (1, 5, 6, 7, 40, 0, 13)]
    cut = Windows(texts, 6, 2)
    ids, mask, body = cut.batch(np.arange(len(cut)))
    assert [b"".join(bytes(ids[body[:, w] > 0, w].astype(np.uint8)) for w in np.flatnonzero(cut.text == i)) for i in range(len(texts))] == texts
    assert (body <= mask).all()
    for w in range(len(cut)):  # what a window reads is a piece of its text, with two bytes around the body where there are
        assert bytes(ids[mask[:, w] > 0, w].astype(np.uint8)) in texts[cut.text[w]]
        assert mask[:, w].sum() == min(len(texts[cut.text[w]]), body[:, w].sum() + 2 * (cut.low[w] > 0) + 2 * (cut.high[w] < len(texts[cut.text[w]]))) or mask[:, w].sum() >= body[:, w].sum()


def test_a_texts_scores_do_not_hang_on_others():
    net = ByteGRU(["a", "b"])
    texts = [b"abc", b"a longer one " * 60, b"x"]
    assert net.pooled(texts) == pytest.approx(np.concatenate([net.pooled([t]) for t in texts]), abs=1e-4)


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify_languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(truth.keys())
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd_rows(spark):
    rows = [(i, f"{'the and of' if i % 2 else 'der und die'} {i}", "en" if i % 2 else "de", "s") for i in range(60)]
    odd = [(100, None, "en", "s"), (101, "", "en", "s"), (102, "123 !? 456", "en", "s"), (None, "the of and", None, "s"), (103, "x" * 5000, None, "s"), rows[0], rows[0]]
    got = identify_languages(docs_of(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[None].lang_pred == "en" and by[103].lang_pred in ("de", "en")
    assert {r.lang_pred for r in identify_languages(docs_of(spark, [(1, "the", None, "s")])).collect()} == {"und"}
    assert identify_languages(docs_of(spark, [])).count() == 0
    same_id = train_language_id(docs_of(spark, rows + [(rows[2][0], f"{i} der und die", "de", "s") for i in range(500)]), rows_a_label=20)
    assert same_id.labels == ["de", "en"]
    twice = predict_language(predict_language(docs_of(spark, rows), same_id), same_id, pred="again", score="again_score")
    assert twice.where("lang_pred = again").count() == len(rows)


def recall_of(spark, rows, **options):
    """Recall of each query, by brute force, after a check of ranks and scores."""
    table = rows.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy())
    want, exact = defaultdict(set), {}
    for q, _, i, d in brute_force(ids, x, 100, 10):
        want[q].add(i)
        exact[q, i] = d
    got = defaultdict(list)
    for r in nearest_neighbours(rows, **options).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[2] for f in found] == sorted(f[2] for f in found)
        assert all(d == pytest.approx(exact.get((q, i), d), abs=1e-12) for _, i, d in found)
    return [len({f[1] for f in got[q]} & want[q]) / 10 for q in want]


@pytest.mark.parametrize("options", [{}, {"list_rows": 40, "bucket_rows": 64, "bucket_queries": 3}])  # as registered; and long lists, cut
def test_nearest_neighbours_recall(spark, options):
    found = recall_of(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), **options)
    assert np.mean(found) >= 0.9 and min(found) >= 0.5


def test_nearest_neighbours_recall_on_many(spark, tmp_path):
    rng = np.random.default_rng(7)
    middles = rng.standard_normal((300, 32))
    x = middles[rng.integers(0, 300, 50_000)] + 0.6 * rng.standard_normal((50_000, 32))
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": pa.array(list(x))}), tmp_path / "v.parquet")
    found = recall_of(spark, spark.read.parquet(f"file://{tmp_path}/v.parquet"))
    assert np.mean(found) >= 0.9


def test_lists_are_balanced():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((4000, 8)), 0.1 * rng.standard_normal((4000, 8)) + 3])  # half of them in one place
    index = ListIndex(x, 64)
    count = np.bincount(index._nearest(x)[0], minlength=64)
    assert count.max() <= 4 * len(x) / 64 and np.median(count) >= 0.3 * len(x) / 64


def test_nearest_neighbours_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, q long, v int, part string"
    nan = float("nan")
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(0, 250)] + [(1000 + i, [5.0, 5.0, 5.0]) for i in range(60)]
    bad = [(400, None), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (700, [nan, 1.0, 1.0]), (800, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (100, [2.0, 1.0, 1.0])]
    make = lambda rows: spark.createDataFrame([(i, v, 0, 1, 2, "p") for i, v in rows], schema)
    rows = nearest_neighbours(make(good + bad)).collect()
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], float)
    want = sorted((q, r, i, round(d, 9)) for q, r, i, d in brute_force(ids, x, 100, 10))
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in rows) == want
    few = nearest_neighbours(make(good[98:103])).collect()
    assert [(r["rank"], r.query_id) for r in sorted(few, key=lambda r: r["rank"])] == [(k, 100) for k in range(1, 5)]
    assert nearest_neighbours(make([])).count() == 0 and nearest_neighbours(make(bad[:4])).count() == 0


def test_graph_walk_finds_near_centroids():
    x = np.random.default_rng(3).standard_normal((4000, 8))
    index = ListIndex(x, 100)
    hits = 0
    for q in x[:50]:
        d = ((index.centroids - q) ** 2).sum(1)
        hits += len(set(np.argsort(d)[:10].tolist()) & {c for _, c in index.search(q, 3.0)[:10]})
    assert hits >= 450


def test_statistics_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["a", "b", "c d", "\n", "\n\n", "\t", " ", "é#", "$|x", "<b>", "A!", "the end\n", " x", "\r\n"]
    for _ in range(400):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert text_stats(text, WordHashes())[:5] == brute_stats(text), repr(text)
    assert text_stats(None, WordHashes())[:5] == brute_stats(None)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 3))
    forest = IsolationForest(x)
    assert forest.score(np.array([[8.0, 8, 8]]))[0] > np.quantile(forest.score(x), 0.99)


def test_quality_rules_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = 1000
    model = train_quality(docs, labels, rows=rows)
    got = {r.doc_id: r for r in quality_rules(docs, model).collect()}
    seen = {r.doc_id for r in labels.where("quality IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    truth = [r for r in labels.collect() if r.doc_id not in seen and r.quality is not None]
    assert len(truth) > 500
    assert np.mean([got[r.doc_id].anomaly <= model.threshold for r in truth if r.quality == 1]) > 0.97
    assert np.mean([got[r.doc_id].anomaly > model.threshold for r in truth if r.quality == 0]) > 0.9
    odd = docs_of(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (None, "a b c " * 100, "en", "s"), (3, "w" * 100_000, "en", "s"), (3, "w" * 100_000, "en", "s")])
    rows = quality_rules(odd, model).collect()
    assert len(rows) == 5 and all(r.base_failed and not r.kept for r in rows)
    assert quality_rules(docs_of(spark, []), None).count() == 0
    assert train_quality(docs, labels.limit(0)) is None
    repeated = spark.createDataFrame([(1, "a fine text of words " * 30)] * 400 + [(2, "# $ % " * 60)], "doc_id long, text string")
    assert train_quality(repeated, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")).threshold > 0


def test_pipeline_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(5000, "123 456", "en", "src0", 7), (5001, None, None, None, None)], docs.schema)
    now, at = docs.unionByName(junk), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(f"file://{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"file://{tmp_path}/{name}")
        at[name] = before, now
        if name != "packing":
            assert now.columns == docs.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    first, kept = map(ids, at["language_id"])
    assert {5000, 5001} <= first.keys() - kept.keys() and len(first - kept) <= 5
    before, after = at["near_duplicates"]
    want = {r.doc_id for r in near_duplicates(before).where("doc_id = class_id").collect()}
    assert ids(after) == Counter(want)
    from tests.llm.test_exact_ops import brute_dedup

    before, after = at["substring_dedup"]
    texts = before.select("doc_id", "text", "source").collect()
    brute = {k[0]: k for k in brute_dedup([tuple(r) for r in texts])}
    rows = {r.doc_id: r for r in after.collect()}
    assert rows.keys() == {i for i, n, gone, _ in brute.values() if gone == 0 or gone < n}
    assert all(len(r.text.split()) == brute[i][1] - brute[i][2] and r.n_chars == len(r.text) for i, r in rows.items())
    before, after = at["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 2
    before, after = at["packing"]
    assert ids(after.where("start = 0")) == ids(before)


ODD = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, _lang_score double, _row int, component long"


def test_pipeline_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing names, through all stages."""
    rng = random.Random(6)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(400)] for k, letters in (("en", "etaoinshr"), ("de", "äöüßchzwk"))}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    rows = [(i, text(k := ("en", "de")[i % 2], 60), k, f"s{i % 3}") for i in range(60)]
    base = rows[0][1].split()
    odd = [(100, None, None, None), (101, "", "en", "s0"), (102, "12 34", "en", None), (None, text("en", 50), None, None), (None, text("de", 50), None, None), rows[2], rows[2], rows[2]]
    odd += [(103, text("en", 30_000), "en", "s1"), (104, " ".join([*base[:30], "changed", *base[31:]]), "en", "s0"), (105, "x" * 200_000 + " the", None, "s2")]
    make = lambda rows: spark.createDataFrame([(*r, len(r[1] or ""), None, 0.5, 1, 2) for r in rows], ODD)
    now = make(rows + odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, written(stage(spark, now, SF), name)
        assert now.columns == before.columns
        got = [r.asDict() for r in now.collect()]
        if name == "language_id":
            assert {r["doc_id"] for r in got}.isdisjoint({100, 101, 102}) and all(r["lang"] for r in got) and sum(r["doc_id"] == 2 for r in got) == 4
        if name == "near_duplicates":
            assert sum(r["doc_id"] == 2 for r in got) == 1 and sum(r["doc_id"] is None for r in got) == 2 and {0, 103, 105} <= {r["doc_id"] for r in got} and 104 not in {r["doc_id"] for r in got}
        if name == "substring_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        assert all(r["_lang_score"] == 0.5 and r["_row"] == 1 and r["component"] == 2 for r in got)
    packed = corpus_pipeline.packing_stage(spark, now, SF).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r["doc_id"] for r in got)
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    unlabelled = make([(1, "some words", None, None), (1, "some words", None, None)])
    assert corpus_pipeline.language_stage(spark, unlabelled, SF).count() == 0


def test_queries_name_their_lists_in_bounded_batches(spark, monkeypatch):
    from tablekin.llm import ann

    seen, real = [], ann.arrow_map

    def watched(df, make, schema):
        if "q long" in str(schema):
            for batch in df.toArrow().combine_chunks().to_batches():
                seen.extend((len(x["list"]), sorted(x)) for x in make()(batch))
        return real(df, make, schema)

    monkeypatch.setattr(ann, "arrow_map", watched)
    monkeypatch.setattr(ann, "CELLS", 100, raising=False)
    x = np.random.default_rng(3).normal(size=(2000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert nearest_neighbours(rows, every=5, list_rows=40).count() == 4000
    assert max(n for n, _ in seen) <= 100 and all(names == ["list", "q"] for _, names in seen)
