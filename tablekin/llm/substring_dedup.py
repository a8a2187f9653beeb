"""Substring deduplication by Relative Lempel-Ziv parsing.

The corpus is its own reference, and each text is factored against all of it but itself. A text is cut into phrases that
depend on content alone: each window of `window` words belongs to the smallest-hashed `gram`-word sequence in it, its
anchor, and the windows of one anchor make one phrase. The phrases of all texts, indexed by anchor, are the reference
blocks. The parse runs in three steps:

1. Index. A phrase is looked up in the block of its anchor, which holds every place in the corpus that could match. The
   block names two places of each phrase that is there again, the least and the greatest, as sources.
2. Boundaries. Where a block holds the anchor but not the whole phrase, any match ends within the phrase. Each window
   across that boundary is looked up by itself, in an index of the same kind.
3. Greedy factors. From left to right, a factor starts at the first place that is matched and not yet passed, with that of
   the two sources which goes on for longer, and takes in all that follows there as in the text; the next factor starts
   behind it. Neighbouring pieces overlap by `window` - 1 words, so no factor is shorter than a window, and factors
   together cover exactly the words of the windows that are elsewhere as well. These are the duplicate spans.

Equal windows have equal anchors, so no match is missed; hashes are of 64 bits, compared only within equal anchors.
A block is never gathered: phrases meet by aggregates that combine before the shuffle, and by joins that AQE can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ._common import BASE, BASE_INVERSE, WordHashes, arrow_map, forget, grams, slices, words_of, written

GRAM = 10


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of h[j] * BASE**j, and BASE**-j, modulo 2**64."""
    n = len(h)
    up, down = np.full(n, BASE, np.uint64), np.full(n + 1, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(h * np.cumprod(up, dtype=np.uint64), out=s[1:], dtype=np.uint64)
    return s, np.cumprod(down, dtype=np.uint64)


def phrases(h: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor's hash, phrase's hash) of each phrase of a text of word hashes h."""
    g = grams(h, gram)
    span, n = window - gram + 1, len(h) - window + 1
    at, width = np.arange(len(g)), 1
    while width < span:  # leftmost smallest in g[i : i + span]
        step = min(width, span - width)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        width += step
    first = np.flatnonzero(np.diff(at[:n], prepend=-1))
    count = np.diff(first, append=n)
    s, down = _prefix(h)
    body = (s[first + count + window - 1] - s[first]) * down[first]
    shape = ((at[first] - first) * 64 + count).astype(np.uint64)
    return first, count, g[at[first]], body ^ (shape * np.uint64(0xD6E8FEB86659FD93))


def text_key(ident: Column, text: Column) -> Column:
    """What names a text as a source."""
    return F.xxhash64(ident, text)


def _key(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    return df.select(
        F.struct(*[F.col(c) for c in carry]).alias("_rest"), F.col(text_col).alias("_text"),
        text_key(F.col(id_col), F.col(text_col)).alias("_key"),
        F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).bitwiseAND((1 << 24) - 1).cast("int").alias("_check"),
    )


def _phrase_rows(window: int):
    def make():
        cache = WordHashes()

        def one(batch):
            for part in slices(batch, "_text"):
                keys, checks = part.column("_key").to_numpy(), part.column("_check").to_numpy()
                out: list[list[np.ndarray]] = [[], [], [], []]
                for text, key, check in zip(part.column("_text").to_pylist(), keys, checks, strict=True):
                    words = words_of(text)
                    if len(words) < window:
                        continue
                    first, count, anchor, body = phrases(cache.of(words), window)
                    out[0].append(np.full(len(first), key))
                    out[1].append((first << 32) | (int(check) << 8) | count)
                    out[2].append(anchor.view(np.int64))
                    out[3].append(body.view(np.int64))
                if out[0]:
                    yield dict(zip(("k", "place", "anchor", "phrase"), map(np.concatenate, out), strict=True))

        return one

    return make


def _boundary_rows(window: int):
    """The hash of each window of the asked-for phrases."""

    def make():
        cache = WordHashes()

        def one(batch):
            for part in slices(batch, "_text"):
                out: list[list[np.ndarray]] = [[], [], []]
                for text, key, check, asked in zip(*(part.column(c).to_pylist() for c in ("_text", "_key", "_check", "asked")), strict=True):
                    p = np.array(asked, np.int64)
                    p = p[(p >> 8) & 0xFFFFFF == check]
                    words = words_of(text)
                    first, count = p >> 32, p & 255
                    if not len(p) or (first + count + window - 1).max() > len(words):
                        continue
                    s, down = _prefix(cache.of(words))
                    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    out[0].append(np.full(len(at), key))
                    out[1].append((at << 32) | (check << 8) | 1)
                    out[2].append(((s[at + window] - s[at]) * down[at]).view(np.int64))
                if out[0]:
                    yield dict(zip(("k", "place", "body"), map(np.concatenate, out), strict=True))

        return one

    return make


def greedy_factors(first: list[int], count: list[int], sources: list[tuple[tuple[int, int], ...]], window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, source text, start there) of each factor, in words.

    Pieces are runs of `count` matched windows from window `first` on, in order; sources are (text, start there).
    """
    out, i, n = [], 0, len(first)
    while i < n:
        best, end = sources[i][0], i + 1
        for text, at in sources[i]:
            shift, j = at - first[i], i + 1
            while j < n and first[j] == first[j - 1] + count[j - 1] and (text, first[j] + shift) in sources[j]:
                j += 1
            if j > end:
                best, end = (text, at), j
        out.append((first[i], first[end - 1] + count[end - 1] - first[i] + window - 1, *best))
        i = end
    return out


def _pieces_of(marks: pa.StructArray, key: int, check: int, size: int, window: int) -> tuple[list, list, list]:
    """first, count and sources of the pieces of a text of `size` words, in order; a place is no source of itself, unless
    all its occurrences are in rows that repeat."""
    place, *ends = (marks.field(c).to_numpy() for c in ("place", "lk", "lp", "gk", "gp"))
    keep = np.flatnonzero(((place >> 8) & 0xFFFFFF == check) & ((place >> 32) + (place & 255) + window - 1 <= size))
    first, count = place[keep] >> 32, place[keep] & 255
    order = np.lexsort((-count, first))
    ends_before = np.maximum.accumulate(np.concatenate([[0], (first + count)[order]]))[:-1]
    keep = keep[order[first[order] >= ends_before]]  # once each, and no windows of a phrase that is matched as a whole
    place, (lk, lp, gk, gp) = place[keep], (x[keep] for x in ends)
    other = [(lk != key) | (lp != place), ((gk != key) | (gp != place)) & ((gk != lk) | (gp != lp))]
    sources = [((a, b),) * x + ((c, d),) * y or ((a, b),) for a, b, c, d, x, y in zip(*(v.tolist() for v in (lk, lp >> 32, gk, gp >> 32, *other)), strict=True)]
    return (place >> 32).tolist(), (place & 255).tolist(), sources


def _cut_rows(window: int, factors: bool):
    def make():
        def one(batch):
            for part in slices(batch, "_text"):
                out = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept_text", "factors")}
                marks, has = part.column("marks"), part.column("marks").is_valid().to_pylist()
                for i, (text, key, check) in enumerate(zip(*(part.column(c).to_pylist() for c in ("_text", "_key", "_check")), strict=True)):
                    words, gone, found = words_of(text), 0, []
                    if has[i]:
                        found = greedy_factors(*_pieces_of(marks.slice(i, 1).flatten(), key, check, len(words), window), window)
                        cover = np.zeros(len(words), bool)
                        for start, length, _, _ in found:
                            cover[start : start + length] = True
                        gone = int(cover.sum())
                        if gone:
                            words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                    kept = b" ".join(words)
                    for c, v in zip(out, (len(words) + gone, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if gone else text, found), strict=True):
                        out[c].append(v)
                if factors:
                    out["factors"] = [[dict(zip(("start", "length", "source", "source_start"), f, strict=True)) for f in found] for found in out["factors"]]
                else:
                    del out["factors"]
                yield out | {"_rest": part.column("_rest")}

        return one

    return make


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, carry: Sequence[str] = (), factors: bool = False) -> DataFrame:
    """Remove each word that lies in a `window`-word sequence starting anywhere else in the corpus as well.

    Returns a row per row of docs: `id_col`, n_words, n_removed, kept_sha256 and kept_text: the kept words joined by a
    space, or the text as it was if nothing goes; then the columns `carry`, and, if asked for, `factors` of the parse:
    start and length in words, source (text_key() of the text matched) and source_start. A null or empty text has no words
    and stays. Repeated rows count as documents of their own, so all of a repeated long text goes. Null ids are ids like
    others. An empty table gives an empty one. Other columns are not read. Texts shorter than a window are kept.
    """
    if not GRAM < window < 256:
        raise ValueError(f"a window has {GRAM + 1} to 255 words")
    columns = [id_col, *[c for c in carry if c != id_col]]
    base = _key(docs, id_col, text_col, columns)
    found = written(arrow_map(base.select("_text", "_key", "_check"), _phrase_rows(window), "k long, place long, anchor long, phrase long"), "phrases")
    blocks = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi")).where("n > 1")
    blocks = written(blocks.select("anchor", (F.col("lo") == F.col("hi")).alias("whole")), "blocks")  # else a frequent anchor's rows can't be split
    met = written(found.join(blocks, "anchor"), "met")
    forget(found, blocks)
    ends = [F.count("*").alias("n"), F.min(F.struct("k", "place")).alias("l"), F.max(F.struct("k", "place")).alias("g")]
    sources = [F.col("l.k").alias("lk"), F.col("l.place").alias("lp"), F.col("g.k").alias("gk"), F.col("g.place").alias("gp")]
    each = written(met.groupBy("anchor", "phrase").agg(F.first("whole").alias("whole"), *ends), "each")
    again = met.join(each.where("n > 1").select("anchor", "phrase", *sources), ["anchor", "phrase"]).select("k", "place", "lk", "lp", "gk", "gp")
    asked = each.where("not whole").select("l.*").groupBy("k").agg(F.collect_list("place").alias("asked"))
    texts = base.select("_rest", "_text", "_key", "_check")
    edges = arrow_map(texts.join(asked, texts["_key"] == asked["k"]).select("_text", "_key", "_check", "asked"), _boundary_rows(window), "k long, place long, body long")
    edges = written(edges.dropDuplicates(["k", "place", "body"]), "edges")
    twice = written(edges.groupBy("body").agg(*ends).where("n > 1").select("body", *sources), "twice")
    pieces = written(again.unionByName(edges.join(twice, "body").drop("body")), "pieces")
    forget(met, each, edges, twice)
    marks = pieces.groupBy("k").agg(F.collect_set(F.struct("place", "lk", "lp", "gk", "gp")).alias("marks"))  # rows that repeat give equal ones
    more = "n_words long, n_removed long, kept_sha256 string, kept_text string" + ", factors array<struct<start:bigint,length:bigint,source:bigint,source_start:bigint>>" * factors
    kind = StructType([base.schema["_rest"], *_parse_datatype_string(more).fields])
    cut = arrow_map(texts.join(marks, texts["_key"] == marks["k"], "left").select("_rest", "_text", "_key", "_check", "marks"), _cut_rows(window, factors), kind)
    return cut.select(F.col("_rest")[id_col].alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text", *[F.col("_rest")[c].alias(c) for c in columns[1:]], *["factors"] * factors)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = 35) -> DataFrame:
    """docs with all columns, the text (and its length in `chars_col`) cut as substring_dedup() says; rows of which nothing is left go."""
    cut = substring_dedup(docs, id_col, text_col, window, [c for c in docs.columns if c not in (id_col, text_col, chars_col)])
    cut = cut.where("n_removed = 0 OR n_removed < n_words").withColumns({text_col: F.col("kept_text"), chars_col: F.length("kept_text").cast("long")})
    return cut.select(*docs.columns)
