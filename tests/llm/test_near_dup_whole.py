"""Near-duplicates that share buckets with many others."""

import random

import numpy as np
import pytest

from tablekin.llm import near_dup
from tablekin.llm._common import WordHashes
from tablekin.llm.near_dup import OrderMinHash, near_duplicates, similar, sketchers, without_near_duplicates

DOCS = "doc_id long, text string"


def classes_of(spark, rows, **options):
    return {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, DOCS), **options).collect()}


def edited(rng, words, at):
    out = list(words)
    for i in at:
        out[i] = f"n{rng.getrandbits(40)}"
    return out


def test_variants_unlike_each_other_are_joined_by_their_original(spark):
    rng = random.Random(3)
    base = [f"w{rng.getrandbits(40)}" for _ in range(300)]
    texts = [edited(rng, base, rng.sample(range(300), 36)) for _ in range(150)]
    texts.insert(70, base)
    assert not any(similar(texts[i], texts[j], 0.8) for i in range(20) for j in range(i))
    found = classes_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)], sketches=96)  # that all are candidates
    assert set(found.values()) == {0}


def test_each_pair_of_a_crowded_bucket_is_compared(spark):
    rng, cache = random.Random(5), WordHashes()
    omh = OrderMinHash(1, 1, 3)
    key = lambda t: omh.sketch(cache.of([w.encode() for w in t]))[0]
    new = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passage, pairs = new(40), []
    while (least := key(passage)) != key([*passage, *new(1000)]):
        passage = new(40)
    while len(pairs) < 25:
        a = [*passage, *new(160)]
        b = edited(rng, a, [150])
        if key(a) == key(b) == least:
            pairs.append((a, b))
    rows = [(10 * i + j, " ".join(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    found = classes_of(spark, rows, sketches=1, length=1, shingle=3, rounds=1)
    assert found == {i: i - i % 10 for i, _ in rows}


def test_unrelated_texts_of_one_id_are_classes_of_their_own(spark):
    rng = random.Random(7)
    texts = [[f"w{rng.getrandbits(40)}" for _ in range(50)] for _ in range(6)]
    rows = [(None, t) for t in texts[:3]] + [(5, t) for t in texts[3:]] + [(9, texts[0]), (8, edited(rng, texts[3], [25]))]
    rows = [(i, " ".join(t)) for i, t in rows] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = [tuple(r) for r in without_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[0] not in (8, 9)], key=str)
    assert len({r.class_hash for r in near_duplicates(docs, rounds=1).collect()} - {None}) == 6


def test_pairs_at_the_least_similarity_are_candidates(spark):
    rng, rows = random.Random(11), []
    for n, edits, times in ((300, 60, 150), (10, 1, 30), (10, 2, 60), (4, 0, 5), (30, 6, 60), (90, 18, 60), (101, 20, 60)):
        for _ in range(times):
            a = [f"w{rng.getrandbits(40)}" for _ in range(n)]
            b = edited(rng, a, [5] if edits == 1 else rng.sample(range(n), edits)) if edits else [*a[:2], "more", *a[2:]]
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    found = classes_of(spark, rows)
    assert sum(found[i] == i - i % 2 for i in range(1, len(rows), 2)) >= 0.99 * len(rows) / 2


@pytest.mark.parametrize("n", [5, 9, 10, 15, 30, 99, 100, 123, 150, 300])
def test_sketches_of_similar_texts_meet(n):
    """Replacements, insertions and deletions at random places, at each similarity down to the least."""
    rng, kinds = np.random.default_rng(n), sketchers(0.8, 48, 2, 3)
    sketch = lambda h: set(np.concatenate([h[:0], *[o.sketch(h) for a, b, o in kinds if a <= len(h) <= b]]).tolist())
    new = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    for least in (0.8, 0.85, 0.9, 0.95):
        edits, met, times = int((1 - least) * n + 1e-9), 0, 40
        for turn in range(times):
            a, at = new(n), np.sort(rng.choice(n, edits, replace=False))
            b = np.delete(a, at) if turn % 3 == 0 else a.copy()
            if turn % 3 == 1:
                b[at] = new(edits)
            if turn % 3 == 2:
                b = np.insert(a, at, new(edits))
            met += bool(sketch(a) & sketch(b))
        assert met >= 0.9 * times


def test_former_centres_are_compared_with_all_of_their_buckets(spark):
    """The middle one of three texts shares buckets with both others; where these are the centres, it names but one of them."""
    rng, rows = random.Random(13), []
    for _ in range(8):
        a, b, c, d = ([f"w{rng.getrandbits(40)}" for _ in range(60)] for _ in range(4))
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(([*a, *b], [*c, *b], [*c, *d]))]
    assert classes_of(spark, rows, similarity=0.5, sketches=96, length=1, rounds=1) == {i: i - i % 3 for i, _ in rows}


def test_a_family_that_is_just_not_similar_makes_no_rows_of_pairs(spark, monkeypatch):
    """Variants of one text, most two of which are just not similar, in several blocks: the same classes as by brute force."""
    rng, sizes = random.Random(17), []
    kept = near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name: sizes.append((kept(df, name), name)) or sizes[-1][0])
    monkeypatch.setattr(near_dup, "forget", lambda *tables: None)
    monkeypatch.setattr(near_dup, "BLOCK", 150)
    monkeypatch.setattr(near_dup, "FAMILY_BLOCK", 20)
    base = [f"w{rng.getrandbits(40)}" for _ in range(120)]
    texts = []
    for _ in range(400):  # some words change places, so that word counts tell nothing
        at, text = rng.sample(range(120), rng.choice((15, 16, 17))), list(base)
        for i, j in zip(at, [*at[1:], at[0]], strict=True):
            text[i] = base[j]
        texts.append(text)
    omh = sketchers(0.8, 24, 1, 3)[1:]
    cache = WordHashes()
    marks = [frozenset(np.concatenate([o.sketch(cache.of([w.encode() for w in t])) for a, b, o in omh if a <= len(t) <= b]).tolist()) for t in texts]
    least = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if least[i] != least[j] and marks[i] & marks[j] and similar(texts[i], texts[j], 0.8):
                low, high = sorted((least[i], least[j]))
                least = [low if k == high else k for k in least]
    assert 50 < len(set(least)) < 390
    found = classes_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)], sketches=24, length=1, rounds=1)
    assert [found[i] for i in range(len(texts))] == least
    assert max(table.count() for table, _ in sizes) <= 70 * len(texts)  # a few times the sketches; there are 79,800 pairs


def test_texts_without_a_candidate_are_not_shuffled(spark):
    """Of two large tables, as the joins with texts take them, what is shuffled isn't the texts of all documents."""
    rng = random.Random(19)
    texts = [[f"w{rng.getrandbits(40)}" for _ in range(2000)] for _ in range(150)]
    texts += [edited(rng, texts[7], [1000]), texts[9], texts[9]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    sc, kept = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    args = None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(seq.apply, range(seq.size()))} if (seq := sc._jsc.sc().statusStore().stageList(*args)) else {}
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    moved = sum(n for k, n in stages().items() if k not in before)
    assert found == {i: {150: 7, 151: 9, 152: 9}.get(i, i) for i, _ in rows}
    assert 0 < moved < sum(len(t) for _, t in rows) / 2


@pytest.mark.parametrize("most", [19, 0])
def test_sifting_loses_no_row_that_is_needed(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "SIFT_WORDS", most)
    rows, need = spark.range(20_000).selectExpr("id AS a", "id % 7 AS b"), spark.range(0, 20_000, 40).selectExpr("id AS a", "id % 7 AS b")
    left = near_dup._sifted(rows, need, "a", "b")
    assert left.join(need, ["a", "b"]).count() == 500
    assert left.count() <= (3000 if most else 20_000)
    assert near_dup._sifted(rows, need.limit(0), "a").count() == 0
