"""Sharding, mixing, packing, token counts, WARC and substring dedup against brute force and on odd rows."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tablekin.llm._common import n_words
from tablekin.llm.mixing import mix_sources, mixed, quality_weight
from tablekin.llm.packing import WordIds, Windows, best_fit_decreasing, pack, parts_words
from tablekin.llm.sharding import shard_by_bytes
from tablekin.llm.substring_dedup import phrases, substring_dedup, text_key
from tablekin.llm.token_counts import byte_level, count_spliced, token_counts
from tablekin.llm.warc import page_archives, parse_archive, resolve_revisits, write_archives

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "x", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ß x", " ", "汉字", "<|endoftext|>", "it's", "A1b2"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 90, 700]))), f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, f"{' '.join(rng.choices(vocabulary, k=20))}\n {passage}\t{' '.join(rng.choices(vocabulary, k=25))}", "s0") for i in range(12)]
    rows += [(200 + i, rows[2][1], "s0") for i in range(9)]
    rows += [rows[3], rows[3], rows[5]]  # repeated rows
    rows += [(None, "a b c", None), (None, passage, None), (300, None, "s1"), (301, "", "s2"), (302, " \n\t ", None), (303, "loop de " * 90, "é"), (304, "x" * 40_000, "Z")]
    return rows


def brute_dedup(rows, n=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (ident, _, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((ident, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup_is_exact(spark, odd):
    got = substring_dedup(docs_of(spark, odd))
    assert Counter(tuple(r) for r in got.drop("kept_text").collect()) == brute_dedup(odd)
    for r in got.collect():
        if r.n_removed:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substring_dedup(docs_of(spark, [])).count() == 0


def test_factors_are_a_greedy_parse(spark, odd):
    """Each factor stands at its source, not at its own place, and can't go on there by a whole piece; factors cover what
    brute force finds; and where a text has one source only, they are those of a plain parse by longest match."""
    rows = [r for r in odd if r[0] not in (None, 3, 5)]
    docs = docs_of(spark, rows).select("doc_id", "text")
    keys = {r.k: r.text for r in docs.select("text", text_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    own = {r.doc_id: r.k for r in docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    texts = {i: split(t) for i, t, _ in rows}
    starts = Counter(tuple(w[a : a + 35]) for w in texts.values() for a in range(len(w) - 34))
    n = 0
    for r in substring_dedup(docs, factors=True).collect():
        words, cover, end = texts[r.doc_id], set(), 0
        for f in r.factors:
            source = split(keys[f.source])
            assert f.length >= 35 and (f.source, f.source_start) != (own[r.doc_id], f.start)
            assert words[f.start : f.start + f.length] == source[f.source_start : f.source_start + f.length]
            assert f.start >= end - 34  # a window across the boundary of two factors may belong to the later one
            cover |= set(range(f.start, f.start + f.length))
            end = f.start + f.length
            n += 1
        assert cover == {a + k for a in range(len(words) - 34) if starts[tuple(words[a : a + 35])] > 1 for k in range(35)}
    assert n > 20


def longest_match_parse(words, others, window):
    """Factors (start, length) by brute force: the longest match at the first place not passed, if it is long enough."""
    out, i = [], 0
    while i <= len(words) - window:
        best = 0
        for o in others:
            for a in range(len(o) - window + 1):
                k = 0
                while i + k < len(words) and a + k < len(o) and words[i + k] == o[a + k]:
                    k += 1
                best = max(best, k)
        if best >= window:
            out.append((i, best))
            i += best - window + 1
        else:
            i += 1
    return out


def test_factors_of_one_source_by_longest_match(spark):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.getrandbits(30)}" for _ in range(n)]
    source = word(400)
    text = word(20) + source[50:130] + word(5) + source[300:340] + source[10:44] + word(9) + source[200:400]
    got = {r.doc_id: r for r in substring_dedup(docs_of(spark, [(1, " ".join(source), "s"), (2, " ".join(text), "s")]), factors=True).collect()}
    assert [(f.start, f.length) for f in got[2].factors] == longest_match_parse(text, [source], 35) == [(20, 80), (105, 40), (188, 200)]


def test_phrases_hold_each_window_once():
    h = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first, count, _, _ = phrases(h, 35)
    assert np.array_equal(np.concatenate([np.arange(a, a + n) for a, n in zip(first, count, strict=True)]), np.arange(400 - 34))
    assert count.max() < 64


def test_shards_are_contiguous_near_equal_and_gapless(spark, odd):
    rows = shard_by_bytes(docs_of(spark, odd), 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd)
    slots, sums = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(7))
    total, most = sum(sums.values()), max(r.size for r in rows)
    assert all(abs(sums[k] - total / 7) <= most for k in range(7))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    ties = shard_by_bytes(docs_of(spark, [(None, "same", "s")] * 90 + [(4, "same", "s")] * 90), 9).collect()  # equal rows are cut like others
    assert Counter(r.shard for r in ties) == dict.fromkeys(range(9), 20) and {r.doc_id for r in ties if r.shard < 4} == {None}
    assert shard_by_bytes(docs_of(spark, [])).count() == 0


def fill(sizes, weights, total, most):
    target, left, open_ = {s: 0.0 for s in sizes}, total, set(sizes)
    while open_ and left > 1e-9:
        w, extra = sum(weights[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            target[s] += left * weights[s] / w
            if target[s] >= most * sizes[s]:
                extra += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = extra
    return target


def test_mixing_reaches_its_targets(spark, odd):
    rows = mix_sources(docs_of(spark, odd)).collect()
    sizes = Counter()
    for _, t, s in odd:
        sizes[s] += len((t or "").split(" ")) if False else len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    by_id = {i: s for i, _, s in odd}
    taken, most = Counter(), Counter()
    for r in rows:
        assert r.taken <= 2 * r.size and r.target == pytest.approx(want[by_id[r.doc_id]]) and r.source_size == sizes[by_id[r.doc_id]]
        taken[by_id[r.doc_id]] += r.taken
        most[by_id[r.doc_id]] = max(most[by_id[r.doc_id]], r.size)
    for s in names:
        assert abs(taken[s] - want[s]) <= most[s] / 2
    again = mix_sources(docs_of(spark, odd[::-1])).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    out = mixed(docs_of(spark, odd))
    assert out.columns == docs_of(spark, []).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in rows for _ in range(r.copies))
    assert mix_sources(docs_of(spark, [])).count() == 0


def test_segment_tree_finds_the_tightest_window():
    rng = random.Random(5)
    tree, held = Windows(64), Counter()
    for i in range(2000):
        if rng.random() < 0.6:
            room = rng.randint(1, 64)
            tree.put(room, i)
            held[room] += 1
        else:
            size = rng.randint(1, 64)
            best = min((r for r in held if r >= size and held[r]), default=None)
            got = tree.take(size)
            assert (got and got[0]) == best
            if got:
                held[best] -= 1


def test_best_fit_decreasing_fills_windows():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 4097, 3000)
    window, offset = best_fit_decreasing(lengths, 4096)
    spans = defaultdict(list)
    for w, o, n in zip(window, offset, lengths, strict=True):
        spans[w].append((o, n))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(spans) * 4096 < 1.02 * lengths.sum() + 4096


def test_packing_covers_each_id_once(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]
    want = Counter()
    for i, x, _ in odd:
        v = ids(x)
        for a in range(0, len(v), 64):
            piece = v[a : a + 64]
            want[(i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(v))] += 1
    rows = pack(docs_of(spark, odd), P.path("word_bpe_49k.json"), capacity=64).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length, r.sequence_tokens, r.padded_length))
    for s in spans.values():
        at = 0
        for o, n, _, _ in sorted(s):
            assert o == at
            at += n
        assert at <= 64 and {x[2] for x in s} == {at} and {x[3] for x in s} == {at if at & (at - 1) == 0 else 64}
    assert pack(docs_of(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_word_ids_forget_and_stay_right():
    cache = WordIds(P.path("word_bpe_49k.json"))
    cache.limit = 3
    words = [b"Hello,", b"HELLO.", b"A.", b"b.,", b".", b"<|ENDOFTEXT|>", b"don't", b"don't,", "É.".encode(), "ß,".encode(), b"a1b2", b"x<|endoftext|>y", "É́".encode()] * 3
    text = b" \n".join(words).decode()
    assert list(np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u4")) == cache.encode(text, add_special_tokens=False).ids


def test_repeated_rows_fill_no_bin(spark, monkeypatch):
    import tablekin.llm.packing as packing

    monkeypatch.setattr(packing, "PIECES_A_BIN", 100)
    rows = pack(docs_of(spark, [(7, "the same text again", "s")] * 1000), P.path("word_bpe_49k.json"), capacity=64).collect()
    bins = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 1000 and len(bins) == 10 and max(bins.values()) <= 110


def test_other_tokenizers_are_not_taken_word_by_word(spark, odd):
    import json

    from tokenizers import Tokenizer

    read = lambda name: json.loads(open(P.path(name)).read())
    assert parts_words(read("word_bpe_49k.json")) and not parts_words(read("byte_bpe_50k.json"))
    assert byte_level(read("byte_bpe_50k.json")) and not byte_level(read("word_bpe_49k.json"))
    changed = read("word_bpe_49k.json")
    changed["normalizer"]["normalizers"].pop()
    assert not parts_words(changed)
    other, word = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
    count = lambda path: {i: len(Tokenizer.from_file(path).encode(x or "", add_special_tokens=False).ids) for i, x, _ in odd}
    assert {r.doc_id: r.doc_tokens - 1 for r in pack(docs_of(spark, odd[:50]), other).collect()} == {i: n for i, n in count(other).items() if i in {r[0] for r in odd[:50]}}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs_of(spark, odd[:50]), word, chunk=100).collect()} == {i: n for i, n in count(word).items() if i in {r[0] for r in odd[:50]}}


def test_mixing_takes_equal_rows_one_by_one(spark):
    rows = [(None, "a b c d", "s")] * 300 + [(None, f"w{i} x y z", "s") for i in range(300)] + [(5, "a b", "t")] * 900
    got = mix_sources(docs_of(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(got) == 1500 and all(abs(taken[s] - target[s]) <= 2 for s in target)
    assert mixed(docs_of(spark, rows)).count() == sum(r.copies for r in got)
    weights = spark.createDataFrame([("plain words of a usual length here",), ("a a a a a a a a",), ("# $ % & | < > #",), ("one line\none line\none line",), ("",), (None,)], "t string")
    w = [r[0] for r in weights.select(quality_weight(F.col("t"), n_words(F.col("t")))).collect()]
    assert w[0] == 1.0 and all(x < 0.7 for x in w[1:]) and w[4] == w[5] == 0.05


def test_token_counts_are_the_librarys(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = token_counts(docs_of(spark, odd), P.path("byte_bpe_50k.json"), limit=50, chunk=600, overlap=8).collect()
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 50) for i, x, _ in odd)
    assert Counter(map(tuple, rows)) == want


def test_splicing_widens_and_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = lambda s: t.encode(s, add_special_tokens=False)
    rng = random.Random(9)
    parts = ["word", "  ", "   ", "\n", "\n \n", "\t", "it's", "é", "汉字", " ", "<|endoftext|>", "123", "!!", " a", " the", "y" * 70, " 　 "]
    for _ in range(60):
        text = "".join(rng.choices(parts, k=rng.randint(1, 250)))
        assert count_spliced(encode, text, rng.choice([20, 64, 150]), rng.choice([2, 8, 16])) == len(encode(text).ids), repr(text)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 700 + "</p>"
    trap = "x" * 990 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", trap), (9, "u", trap), (10, "u", "z" * 1000), (10, "u", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    top = {big: 5, trap: 9}
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        original = top.get(h) if len(b) >= 1000 and top.get(h) not in (None, i) else None
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if original else "response", original)] += 1
    got = page_archives(pages)
    assert Counter(tuple(r)[:5] for r in got.collect()) == want
    assert page_archives(pages.limit(0)).count() == 0
    out = resolve_revisits(spark.createDataFrame([Row(id=i, uri=u, payload=h or "", digest=hashlib.sha1((h or "").encode()).hexdigest(), size=len((h or "").encode())) for i, u, h in rows]))
    write_archives(out.coalesce(1), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.gz")
    data = file.read_bytes()
    records = list(parse_archive(io.BytesIO(gzip.decompress(data))))
    at = [0]
    while at[-1] < len(data):  # each record can be read from its own place on
        member = zlib.decompressobj(31)
        assert member.decompress(data[at[-1] :]).startswith(b"WARC/1.0\r\n")
        at.append(len(data) - len(member.unused_data))
    assert len(at) == len(rows) + 1
    assert len(records) == len(rows) and {h["WARC-Type"] for h, _ in records} == {"response", "revisit"}
    assert Counter(b.partition(b"\r\n\r\n")[2].decode() for h, b in records if h["WARC-Type"] == "response") == Counter(h or "" for i, _, h in rows if top.get(h) in (None, i))
