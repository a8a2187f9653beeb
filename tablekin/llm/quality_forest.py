"""Quality rules, and an isolation forest over their statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, arrow_map, slices

SYMBOLS = b"#*$%&|<>"
#: The statistics of a text, in this order.
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_stutter"]
_LOW_BYTES = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
_UPPER, _MARKS = bytes(range(65, 91)), b"!?|_=~^"


def text_stats(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """STATS of a whole text; all 0 for null. n_upper and n_marks count ASCII letters
    and marks, n_stutter words equal to the one before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * len(STATS)
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), len(joined)
    repeated = stutter = 0
    if n >= 4:
        h = hashes.of(words)
        stutter = int((h[1:] == h[:-1]).sum())
        g = h[:-2] + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(g)
        same = g[order[1:]] == g[order[:-1]]
        if same.any():
            cover = np.zeros(n, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(3):
                cover[at + k] = True
            repeated = int(cover.sum())
    count = lambda some: size - len(joined.translate(None, some))
    return n, size - count(_LOW_BYTES), count(SYMBOLS), len(lines) - len(set(lines)), repeated, count(_UPPER), count(_MARKS), len(lines), stutter


def features(stats: np.ndarray) -> np.ndarray:
    """Rule statistics as shares, comparable between short and long texts."""
    n, chars, symbols, dup, repeat, upper, marks, lines, stutter = np.maximum(stats, 0).astype(float).T
    some = np.maximum(n, 1)
    return np.stack([np.log1p(chars / some), np.log1p(8 * symbols / some), dup / np.maximum(lines, 1), repeat / some, upper / np.maximum(chars, 1), np.log1p(8 * marks / some), stutter / some], 1)


class IsolationForest:
    """Random trees that split a random feature at a random value; anomalies lie at the end of short paths.

    A split's range reaches out of a node's rows by the share `reach` of the way to bounds (low, high), if given, so that
    a forest of good rows has short paths outside of them, also along features in which these don't differ.
    """

    def __init__(self, rows: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 0, bounds: tuple[np.ndarray, np.ndarray] | None = None, reach: float = 0.3):
        rng = np.random.default_rng(seed)
        self.bounds, self.reach = bounds or (rows.min(0), rows.max(0)), reach if bounds else 0.0
        self.size = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        nodes = 2 ** (self.depth + 1)
        self.feature = np.zeros((trees, nodes), np.int64)
        self.value = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))  # of a leaf: its depth and the mean path of what it still holds
        for t in range(trees):
            self._grow(rng, rows[rng.choice(len(rows), self.size, replace=False)], t, 1, 0)

    @staticmethod
    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, rng, x: np.ndarray, t: int, node: int, depth: int) -> None:
        low, high = (x.min(0), x.max(0)) if len(x) > 1 else (np.zeros(1), np.zeros(1))
        if len(x) > 1:
            low, high = low - self.reach * np.maximum(0, low - self.bounds[0]), high + self.reach * np.maximum(0, self.bounds[1] - high)
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or not len(open_):
            for d in range(self.depth - depth + 1):  # whole subtree: a row that falls through ends with this path
                self.path[t, node << d : (node + 1) << d] = depth + self.mean_path(len(x))
            return
        f = int(rng.choice(open_))
        v = rng.uniform(low[f], high[f])
        self.feature[t, node], self.value[t, node] = f, v
        self._grow(rng, x[x[:, f] < v], t, 2 * node, depth + 1)
        self._grow(rng, x[x[:, f] >= v], t, 2 * node + 1, depth + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): towards 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, path in zip(self.feature, self.value, self.path, strict=True):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] >= value[node])
            total += path[node]
        return 2.0 ** (-total / len(self.path) / max(self.mean_path(self.size), 1e-9))


class QualityModel:
    """An isolation forest of good rows, and the threshold above which a row is rejected. The threshold is calibrated on
    rows that the forest was not grown from (`held`), if these hold good and bad ones, else on all."""

    def __init__(self, stats: np.ndarray, good: np.ndarray, held: np.ndarray, lost: float, seed: int = 0):
        x = features(stats)
        if not (good[held].any() and (~good)[held].any() and good[~held].any()):
            held, grown = np.ones(len(x), bool), np.ones(len(x), bool)
        else:
            grown = ~held
        fit = x[grown & good] if good.any() else x
        self.forest = IsolationForest(fit, seed=seed, bounds=(x[grown].min(0), x[grown].max(0)))
        score, good = self.forest.score(x[held]), good[held]
        best, at = -1.0, np.inf
        if good.any() and not good.all():
            for limit in np.unique(score):  # most bad rows above it, with no more than the share `lost` of good ones
                if (score[good] > limit).mean() <= lost and (gain := (score[~good] > limit).mean() - (score[good] > limit).mean()) > best:
                    best, at = gain, limit
        self.threshold = float(at)


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = 3000, lost: float = 0.01, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 0) -> QualityModel | None:
    """Fit and calibrate on the labelled documents with the `rows` smallest hashes of ids: the forest on two thirds of
    them, the threshold on the others. Null labels and null ids are not used; an id with several labels is bad if one of
    them is, and of documents that repeat an id one is read. None without labelled documents."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    if not chosen:
        return None
    few = spark.createDataFrame([(r.id, r.good, i % 3 == 0) for i, r in enumerate(chosen)], f"id {labels.schema[id_col].dataType.simpleString()}, good int, held boolean")
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "id")  # `rows` rows
    joined = joined.groupBy("id", "good", "held").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def make():
        hashes = WordHashes()
        return lambda batch: ({"good": part.column("good"), "held": part.column("held"), "id": part.column("id").cast(pa.string()), "stats": [list(text_stats(t, hashes)) for t in part.column("_text").to_pylist()]} for part in slices(batch, "_text"))

    sample = sorted(arrow_map(joined, make, "good int, held boolean, id string, stats array<bigint>").collect(), key=lambda r: r.id)
    sample = [r for r in sample if r.stats[0]]
    if not sample:
        return None
    return QualityModel(np.array([r.stats for r in sample]), np.array([bool(r.good) for r in sample]), np.array([r.held for r in sample]), lost, seed)


def quality_rules(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", least: int = 50, repeat_percent: int = 50) -> DataFrame:
    """`id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and anomaly of each row.

    base_failed: under `least` words, or over `repeat_percent` percent of them in repeated 3-word windows. kept: not
    base_failed, and the model finds no anomaly above its threshold; without a model only the base rules hold. Null or
    empty texts have no words and fail. Whole texts; no shuffle; repeated rows are kept; an empty table gives an empty one.
    """

    def make():
        hashes = WordHashes()

        def one(batch):
            for part in slices(batch, "_text"):
                stats = np.array([text_stats(t, hashes) for t in part.column("_text").to_pylist()], np.int64).reshape(-1, len(STATS))
                score = model.forest.score(features(stats)) if model else np.zeros(len(stats))
                bad = (stats[:, 0] < least) | (100 * stats[:, 4] > repeat_percent * stats[:, 0])
                yield {"_id": part.column("_id"), **{c: stats[:, i] for i, c in enumerate(STATS[:5])}, "base_failed": bad, "kept": ~bad & (score <= (model.threshold if model else np.inf)), "anomaly": score}

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), make, f"_id {kind}, {', '.join(f'{c} long' for c in STATS[:5])}, base_failed boolean, kept boolean, anomaly double")
    return out.withColumnRenamed("_id", id_col)


def brute_stats(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, plainly; for tests."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)
