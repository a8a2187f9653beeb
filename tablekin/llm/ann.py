"""Approximate nearest neighbours from balanced posting lists."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_map, forget, ship, written


#: Distances, or lists found for queries, that a task holds at once.
CELLS = 500_000


class ListIndex:
    """Centroids of the posting lists and a neighbourhood graph that finds the ones near a vector.

    Lists are balanced by handicaps: a vector belongs to the list of the least squared distance plus handicap, and while
    the lists are fitted those with more vectors than the others get larger ones.
    """

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 0, rounds: int = 8, turns: int = 24, degree: int = 16):
        rng = np.random.default_rng(seed)
        self.centroids = np.array(sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)], np.float64)
        n = len(self.centroids)
        self.handicap = np.zeros(n)
        for _ in range(rounds):
            near, _ = self._nearest(sample)
            count = np.bincount(near, minlength=n)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, sample)
            self.centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centroids)
            empty = np.flatnonzero(count < 0.1 * len(sample) / n).tolist()
            for big in np.argsort(-count)[: len(empty)]:  # a list of few vectors takes over a part of a full one
                if count[big] > 2 * len(sample) / n:
                    own = sample[near == big]
                    self.centroids[empty.pop()] = own[rng.integers(len(own))]
        best = np.inf
        for turn in range(turns if n > 1 else 0):  # the handicaps, for centroids that stay; the most even ones are taken
            near, gap = self._nearest(sample)
            count = np.bincount(near, minlength=n)
            if (spread := float((count.astype(float) ** 2).sum())) < best:
                best, kept = spread, self.handicap.copy()
            self.handicap = self.handicap + 4 / (4 + turn) * float(np.median(gap)) * np.log((count + 1) / (len(sample) / n + 1))
        if n > 1:
            self.handicap = kept - kept.min()
        self.graph = np.empty((n, 0), np.int64)
        if n > 1:
            parts = [np.argpartition(_squares(self.centroids[a : a + 512], self.centroids), min(degree, n - 1), 1)[:, : degree + 1] for a in range(0, n, 512)]
            far = rng.integers(0, n, (n, 4))  # long edges keep the graph connected
            self.graph = np.concatenate([np.concatenate(parts), far], 1)
        self.entries = rng.choice(n, min(8, n), replace=False)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and by how much the next one is farther."""
        near, gap = [], []
        for a in range(0, len(x), 4096):
            d = _squares(x[a : a + 4096], self.centroids) + self.handicap
            near.append(d.argmin(1))
            two = np.partition(d, 1, 1) if d.shape[1] > 1 else np.zeros((len(d), 2))
            gap.append(two[:, 1] - two[:, 0])
        return np.concatenate(near), np.concatenate(gap)

    def assign(self, x: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each vector's own list and, for vectors at a boundary, further ones within ratio x its distance."""
        d = np.sqrt(_squares(x, self.centroids) + self.handicap)
        k = min(most, d.shape[1])
        near = np.argpartition(d, k - 1, 1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(k), d.shape)
        dist = np.take_along_axis(d, near, 1)
        row, col = np.nonzero(dist <= ratio * dist.min(1, keepdims=True))
        return row, near[row, col]

    def search(self, q: np.ndarray, ratio: float, beam: int = 48) -> list[tuple[float, int]]:
        """Lists that a best-first walk over the graph meets within ratio x the distance of the nearest one: (distance,
        list), nearest first. The walk goes on while what it meets may lead to such lists, and to the `beam` nearest."""
        seen = set(self.entries.tolist())
        start = list(seen)
        heap = list(zip(self._to(q, start), start, strict=True))
        found, best = list(heap), [-d for d, _ in heap]
        heapq.heapify(heap)
        heapq.heapify(best)
        least = min(d for d, _ in found)
        while heap:
            d, c = heapq.heappop(heap)
            if len(best) >= beam and d > -best[0] and d > 1.1 * ratio * least:
                break
            new = [x for x in set(self.graph[c].tolist()) if x not in seen]
            seen.update(new)
            for x, e in zip(new, self._to(q, new), strict=True):
                least = min(least, e)
                heapq.heappush(heap, (e, x))
                found.append((e, x))
                heapq.heappush(best, -e)
                if len(best) > beam:
                    heapq.heappop(best)
        return sorted(f for f in found if f[0] <= ratio * least + 1e-12)

    def _to(self, q: np.ndarray, some: list[int]) -> list[float]:
        return np.sqrt(((self.centroids[some] - q) ** 2).sum(1)).tolist()

    def calibrate(self, queries: np.ndarray, near: list[np.ndarray], share: float, copies: int, copy_ratio: float) -> float:
        """The distance ratio within which lists hold `share` of the given nearest vectors of these queries."""
        need = []
        for q, x in zip(queries, near, strict=True):
            if len(x):
                row, lists = self.assign(x, copies, copy_ratio)
                to = np.sqrt(_squares(q[None], self.centroids)[0])
                best = np.full(len(x), np.inf)
                np.minimum.at(best, row, to[lists])
                need.append(best / max(to.min(), 1e-12))
        return float(np.quantile(np.concatenate(need), share, method="higher")) if need else 1.0


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _top(k: int):
    """The k nearest of a bucket of lists for each query that searches some of them; distances in double precision from
    the vectors themselves."""

    def run(keys, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            x = np.stack(left["v"].to_numpy()).astype(np.float64)
            ids, first = left["ids"].to_numpy(), np.array([i[0] for i in left["ids"]])
            names, own = np.unique(left["list"].to_numpy(), return_inverse=True)
            for a in range(0, len(right), 128):
                part = right.iloc[a : a + 128]
                qs = np.stack(part["v"].to_numpy()).astype(np.float64)
                searched = np.stack([np.isin(names, some) for some in part["lists"]])
                rough = np.where(searched[:, own], _squares(qs, x), np.inf)
                m = min(len(x), 4 * k)  # a row may be in two lists of the bucket
                near = np.argpartition(rough, m - 1, 1)[:, :m] if m < len(x) else np.broadcast_to(np.arange(m), rough.shape)
                for i, (q, key) in enumerate(zip(qs, part["q"], strict=True)):
                    some = near[i][np.isfinite(rough[i][near[i]])]
                    some = some[np.unique(first[some], return_index=True)[1]]
                    d = np.sqrt(((x[some] - q) ** 2).sum(1))
                    for j in np.lexsort((first[some], d))[:k]:
                        out.append((key, float(d[j]), int(first[some[j]]), ids[some[j]]))
        return pd.DataFrame(out, columns=["q", "d", "first", "ids"])

    return run


def buckets_of(index: ListIndex, counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(list, parts, first bucket), a row a list: a list of over `most` rows has so many buckets of its own; near ones share
    buckets of about `most` rows."""
    middle = index.centroids - index.centroids.mean(0)
    axis = np.linalg.svd(middle, full_matrices=False)[2][0]
    out, bucket, held = [], 0, 0
    for c in sorted(counts, key=lambda c: (float(middle[c] @ axis), c)):
        parts = -(-counts[c] // most)
        if held and held + counts[c] > most:
            bucket, held = bucket + 1, 0
        out.append((c, parts, bucket))
        bucket, held = (bucket + parts, 0) if parts > 1 else (bucket, held + counts[c])
    return out


def exact_nearest(unique: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest other vectors of each of a few queries among all rows of unique (v): a pass over them, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty((0, queries.shape[1])))] * len(queries)
        for batch in batches:
            for a in range(0, len(batch), 4096):
                x = _matrix(batch.column("v").slice(a, 4096))
                for i, d in enumerate(_squares(queries, x)):
                    some = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                    dist, rows = np.concatenate([best[i][0], d[some]]), np.concatenate([best[i][1], x[some]])
                    order = np.argsort(dist, kind="stable")[: k + 1]
                    best[i] = dist[order], rows[order]
        q = np.repeat(np.arange(len(queries)), [len(d) for d, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(np.concatenate([d for d, _ in best])), pa.array([r.tolist() for _, rows in best for r in rows], pa.list_(pa.float64()))], names=["q", "d", "v"])

    ship(unique.sparkSession)
    found = unique.select("v").mapInArrow(run, "q int, d double, v array<double>")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))).where(F.col("n") <= k + 1)
    out: list[list] = [[] for _ in queries]
    for r in top.collect():  # a few rows a query
        if not np.array_equal(r.v, queries[r.q]):
            out[r.q].append((r.d, r.v))
    return [np.array([v for _, v in sorted(some)[:k]]).reshape(-1, queries.shape[1]) for some in out]


def nearest_neighbours(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = 20_000, sample_numbers: int = 8_000_000, list_rows: int = 128, copies: int = 2, copy_ratio: float = 1.05, recall: float = 0.96, measured: int = 64, bucket_rows: int = 8192, bucket_queries: int = 2048,
) -> DataFrame:
    """For each row whose id is divisible by `every`, its k nearest other rows by Euclidean distance, ties to smaller ids.

    Lists are fitted on `sample` rows at most, or as many as hold `sample_numbers` numbers; there is one for `list_rows`
    rows, or a quarter as many as the sample has rows if these are fewer, so that beyond lists grow longer instead of more.
    Every row is indexed. A row at a boundary goes to as many as `copies` lists within `copy_ratio` of its own. A query
    walks the graph of centroids and searches all lists within a ratio of the nearest one's distance. That ratio is
    measured: `measured` of the queries are compared with all rows, and it is the one at which lists hold the share
    `recall` of what was found. Equal vectors are indexed once, with their k + 1 smallest ids: no more of them can be
    among a query's k. Lists that lie near each other are searched together, in buckets of about `bucket_rows` rows, into
    which long lists are cut, by up to `bucket_queries` queries at a time. Queries that find fewer than k rows search all
    lists.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of any
    but the most frequent length. Of rows repeating an id with equal vectors one counts. Returns query_id, rank, vec_id
    and score. Empty tables give an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    usable = v.isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.coalesce(usable, F.lit(False)))
    empty = "query_id long, rank int, vec_id long, score double"
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == size[0]["n"])
    rank = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k + 1)
    unique = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "unique")
    queries = rows.where(F.col("id") % every == 0).distinct()
    asked = written(queries.groupBy("v").agg(F.min("id").alias("q")), "asked")

    total = unique.count()
    part = unique.select("v", F.element_at("ids", 1).alias("i")).orderBy(F.xxhash64("i"), "i").limit(max(1, min(sample, sample_numbers // size[0]["n"]))).select("v").collect()
    part = np.array([r.v for r in part], np.float64)
    index = ListIndex(part, max(1, min(len(part) // 4, total // list_rows)))
    some = np.array([r.v for r in asked.orderBy(F.xxhash64("q"), "q").limit(measured).collect()], np.float64).reshape(-1, size[0]["n"])
    if not len(some):
        return spark.createDataFrame([], empty)
    ratio = index.calibrate(some, exact_nearest(unique, some, k), recall, copies, copy_ratio)

    def assign():
        def one(batch):
            rows = max(1, min(2000, CELLS // len(index.centroids)))
            for a in range(0, len(batch), rows):
                cut = batch.slice(a, rows)
                row, lists = index.assign(_matrix(cut.column("v")), copies, copy_ratio)
                yield {"list": lists, "v": cut.column("v").take(row_array(row)), "ids": cut.column("ids").take(row_array(row))}

        return one

    def select():
        def one(batch):
            rows = max(1, CELLS // len(index.centroids))  # a query may search all lists
            for a in range(0, len(batch), rows):
                cut = batch.slice(a, rows)
                found = [[c for _, c in index.search(q, ratio)] for q in _matrix(cut.column("v"))]
                row = np.repeat(np.arange(len(cut)), [len(f) for f in found])
                yield {"list": [c for f in found for c in f], "q": cut.column("q").take(row_array(row))}

        return one

    kind = unique.schema["v"].dataType.simpleString()
    postings = written(arrow_map(unique, assign, f"list int, v {kind}, ids array<bigint>"), "postings")
    forget(unique)
    counts = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # a row a list
    held = F.broadcast(spark.createDataFrame(buckets_of(index, counts, bucket_rows), "list int, parts int, bucket int"))  # a row a list
    cut = postings.join(held, "list").select((F.col("bucket") + F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).alias("bucket"), "list", "v", "ids")

    def searched(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (q, near): the k + 1 nearest distinct vectors in the lists of wanted (list, q); and what it is read from."""
        each = wanted.join(held, "list").select("q", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("bucket").alias("b"))
        each = each.groupBy((F.col("b") + F.col("i")).alias("bucket"), "q").agg(F.collect_set("list").alias("lists"))
        each = written(each.join(asked, "q"), "each")
        turns = written(each.groupBy("bucket").agg(F.ceil(F.count("*") / bucket_queries).cast("int").alias("turns")), "turns")
        again = spark.read.schema(turns.schema).parquet(turns._place)
        left = cut.join(turns, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "list", "v", "ids")
        right = each.join(again, "bucket").select("bucket", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int").alias("turn"), "q", "v", "lists")
        found = left.groupBy("bucket", "turn").cogroup(right.groupBy("bucket", "turn")).applyInPandas(_top(k + 1), "q long, d double, first long, ids array<bigint>")
        return found.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "first", "ids"))), 1, k + 1).alias("near")), each

    wanted = arrow_map(asked.select("v", "q"), select, "list int, q long")
    near, each = searched(wanted)
    found = written(near, "found")
    forget(each)
    enough = F.aggregate("near", F.lit(0), lambda n, x: n + F.size(x["ids"])) > k
    short = asked.join(found.where(enough).select("q"), "q", "left_anti")
    every_list = short.crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in counts], "list int"))).select("list", "q")  # the lists, few, for queries, fewer
    found = found.where(enough).unionByName(searched(every_list)[0])
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["d"].alias("d"), i.alias("i")))))
    ranked = queries.join(asked, "v").join(found, "q").select(F.col("id").alias("query_id"), flat.alias("near"))
    best = F.slice(F.array_sort(F.filter("near", lambda x: x["i"] != F.col("query_id"))), 1, k)
    out = ranked.select("query_id", F.posexplode(best).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), F.col("x.d").alias("score"))


def row_array(rows: np.ndarray) -> pa.Array:
    return pa.array(rows, pa.int64())


def brute_force(ids: np.ndarray, x: np.ndarray, every: int, k: int) -> Iterator[tuple[int, int, int, float]]:
    """Exact answers for small tests."""
    x = x.astype(np.float64)
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        for r, j in enumerate(order):
            yield int(ids[q]), r + 1, int(ids[j]), float(d[j])
