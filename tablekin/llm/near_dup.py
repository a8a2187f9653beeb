"""Near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, arrow_map, forget, grams, mix, slices, words_of, written
from .components import connected_components

LONG_MIN = -(1 << 63)
#: Nodes of a bucket that meet at once.
BLOCK = 2000
#: Nodes, and words, of a block of a family.
FAMILY_BLOCK, FAMILY_WORDS = 1000, 1_000_000
#: Words of 64 bits, as a power of two, that are broadcast at most to tell rows that a join doesn't need.
SIFT_WORDS = 19


def occurrences(g: np.ndarray) -> np.ndarray:
    """How often each value has occurred before."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return out


class OrderMinHash:
    """Sketches of a text: of its k-mers of words, each labelled with its occurrence, the `length` smallest under a hash
    function of its own for each sketch, in the order in which they stand in the text."""

    def __init__(self, sketches: int = 48, length: int = 2, shingle: int = 3, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.length, self.shingle = length, shingle
        self.flip = rng.integers(0, 1 << 63, sketches, dtype=np.uint64)
        self.factor = rng.integers(0, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = mix(np.arange(1, sketches + 1, dtype=np.uint64))

    def sketch(self, h: np.ndarray) -> np.ndarray:
        """From word hashes; none if there are fewer words than a k-mer has."""
        g = grams(h, self.shingle)
        if not len(g):
            return g
        base = mix(g + occurrences(g).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows, m = max(1, 2_000_000 // len(g)), min(self.length, len(g))
        out = np.empty(len(self.flip), np.uint64)
        for a in range(0, len(out), rows):
            v = (base ^ self.flip[a : a + rows, None]) * self.factor[a : a + rows, None]
            at = np.empty((len(v), m), np.int64)
            each = np.arange(len(v))
            for j in range(m):
                at[:, j] = v.argmin(1)
                v[each, at[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            at.sort(axis=1)
            s = self.salt[a : a + rows].copy()
            for j in range(m):
                s = mix(s * np.uint64(0xD6E8FEB86659FD93) + g[at[:, j]])
            out[a : a + rows] = s
        return out


def sketchers(similarity: float, sketches: int, length: int, shingle: int) -> list[tuple[int, float, OrderMinHash]]:
    """(fewest words, most words, OrderMinHash): texts of fewer words have sketches of fewer and shorter k-mers, since
    there one edit changes a large share of them. Ranges overlap so that similar texts have one in common."""
    kinds = [(2, 1, min(2, shingle)), (10, 1, min(3, shingle)), (100, length, shingle)]
    ends = [int((kinds[i + 1][0] - 1) / similarity + 1e-9) if i + 1 < len(kinds) else float("inf") for i in range(len(kinds))]
    return [(first, end, OrderMinHash(sketches, m, k, 3 - i)) for i, ((first, m, k), end) in enumerate(zip(kinds, ends, strict=True))]


def banded_distance(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences if it is `most` or less, else most + 1.

    Common ends are left out; then the band of diagonals from -most to most is computed a column at a time, its cells
    held as differences in the bits of integers (Hyyro's banded form of the bit-parallel algorithm).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    begin, n = 0, len(b)
    while begin < n and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < n - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : n - end]
    if not b:
        return len(a) if len(a) <= most else most + 1
    k, limit = min(most, len(a)), most + 1
    width = 2 * k + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    vp, vn, distance, start, level = (mask << (width - k - 1)) & mask, 0, k, k + 1 - width, top >> 1
    for i, x in enumerate(b):
        p = places.get(x, 0)
        if p:
            p = (p >> start if start >= 0 else p << -start) & mask
        d = (((p & vp) + vp) ^ vp | p | vn) & mask
        hp, hn = (vn | ~(d | vp)) & mask, d & vp
        if i < len(a) - k:
            distance += not d & top
        else:
            distance += bool(hp & level) - bool(hn & level)
            level >>= 1
        down = d >> 1
        vp, vn = (hn | ~(down | hp)) & mask, down & hp
        start += 1
    return min(distance, limit)


def similar(a: list, b: list, least: float) -> bool:
    """Edit similarity 1 - distance / longer length of at least `least`."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return banded_distance(a, b, most) <= most


def _verify(least: float):
    def make():
        def one(batch):
            x, y, tx, ty = (batch.column(c).to_pylist() for c in ("x", "y", "tx", "ty"))
            last, words = None, []
            keep = []
            for i, (a, b) in enumerate(zip(tx, ty, strict=True)):
                if b != last:
                    last, words = b, words_of(b)
                if similar(words_of(a), words, least):
                    keep.append(i)
            yield {"x": [x[i] for i in keep], "y": [y[i] for i in keep]}

        return one

    return make


def _node(text: Column) -> Column:
    """The hash of a text; null for texts without a word."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id (null: the smallest long), _text and _node."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MIN)).alias("_id"), F.col(text_col).alias("_text"), _node(F.col(text_col)).alias("_node"))


def _sifted(rows: DataFrame, need: DataFrame, *on: str) -> DataFrame:
    """The rows whose columns `on` are in need, a written table, and a few others, so that a join with need shuffles few
    that it drops. It tells them by bits of hashes, 8 to 16 a row of need, in words that are broadcast. Beyond SIFT_WORDS
    of these, which 4 million rows fill, more others are left, but no row of need is ever lost."""
    words = 1 << min((need.count() // 8).bit_length(), SIFT_WORDS)
    h = F.xxhash64(*on)
    word, bit = h.bitwiseAND(F.lit(words - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bits = need.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.join(F.broadcast(bits), (word == F.col("_word")) & (bit.bitwiseAND(F.col("_bits")) != 0), "left_semi")


def _signatures():
    """Word counts in 256 cells, each 255 at most. The sum of the differences of two is never above the texts' own."""

    def make():
        cache = WordHashes()

        def one(batch):
            for part in slices(batch, "_text"):
                n, g = [], []
                for text in part.column("_text").to_pylist():
                    h = cache.of(words_of(text))
                    n.append(len(h))
                    g.append(np.minimum(np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                yield {"x": part.column("_node"), "n": n, "g": g}

        return one

    return make


def _not_ruled_out(least: float, n: np.ndarray, g: np.ndarray, b: np.ndarray, *labels: np.ndarray):
    """For nodes in order of their lengths n, a node's place, those of later ones that their lengths and signatures g don't
    rule out, and the differences of these: of different blocks b, if there are two, and different in each of labels, which
    may be changed meanwhile.

    An insertion or a deletion changes one word count by one and a replacement two, so a distance d needs a difference
    of signatures of at most 2 d less the difference of lengths.
    """
    most = ((1 - least) * n + 1e-9).astype(np.int64)
    ends = np.searchsorted(n - most, n, "right")
    across = b.min() != b.max()
    for j, end in enumerate(ends):
        at = np.arange(j + 1, end)
        for label in (*labels, b) if across else labels:
            at = at[label[at] != label[j]]
        if len(at):
            e = np.abs(g[at] - g[j]).sum(1, dtype=np.int64)
            keep = e <= 2 * most[at] - (n[at] - n[j])
            if keep.any():
                yield j, at[keep], e[keep]


def _kin(least: float):
    """Of each list of nodes those that may be similar to one of another component (c) and block, with the bucket s and
    the first node y of all that a chain of such pairs joins: a row a node, however many pairs there are."""

    def make():
        def one(batch):
            for i, s in enumerate(batch.column("s").to_pylist()):
                m = batch.column("m").slice(i, 1).flatten()
                x, c, n, b = (m.field(k).to_numpy() for k in ("x", "c", "n", "b"))
                order = np.argsort(n, kind="stable")
                x, c, n, b = x[order], c[order], n[order], b[order]
                g = np.frombuffer(b"".join(m.field("g").to_pylist()), np.uint8).reshape(len(x), -1)[order].astype(np.int16)
                root, any_ = np.arange(len(x)), np.zeros(len(x), bool)
                for j, at, _ in _not_ruled_out(least, n, g, b, c, root):
                    any_[j] = any_[at] = True
                    met = np.unique(np.append(root[at], root[j]))
                    root[np.isin(root, met)] = met[0]
                if any_.any():
                    first = np.full(len(x), np.iinfo(np.int64).max)
                    np.minimum.at(first, root, x)
                    yield {"x": x[any_], "y": first[root[any_]], "c": c[any_], "s": np.full(any_.sum(), s)}

        return one

    return make


def _words():
    """Word hashes in their order, 8 bytes each."""

    def make():
        cache = WordHashes()

        def one(batch):
            for part in slices(batch, "_text"):
                w = [cache.of(words_of(text)) for text in part.column("_text").to_pylist()]
                yield {"x": part.column("_node"), "n": [len(h) for h in w], "w": [h.tobytes() for h in w]}

        return one

    return make


def _linked(least: float):
    """Of each list of nodes, links between components (a, b): of two blocks, or of the one that there is. The pairs of a
    common bucket that word counts don't rule out are compared, those that differ least first, unless links found before
    join their components, so there are fewer links than nodes."""

    def make():
        def one(batch):
            for i in range(len(batch)):
                m = batch.column("m").slice(i, 1).flatten()
                w = [np.frombuffer(h, np.uint64) for h in m.field("w").to_pylist()]
                order = np.argsort([len(h) for h in w], kind="stable")
                w = [w[k] for k in order]
                c, b = (m.field(k).to_numpy()[order] for k in ("c", "b"))
                buckets = m.field("s").to_pylist()
                buckets = [frozenset(buckets[k]) for k in order]
                g = np.stack([np.minimum(np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256), 255) for h in w]).astype(np.int16)
                n = np.array([len(h) for h in w])
                found = [(np.full(len(at), j, np.int32), at.astype(np.int32), e.astype(np.int32)) for j, at, e in _not_ruled_out(least, n, g, b, c)]
                if not found:
                    continue
                j, k, e = (np.concatenate(part) for part in zip(*found, strict=True))
                root = {v: v for v in c.tolist()}
                links = []
                for at in np.argsort(e, kind="stable"):
                    p, q = int(c[j[at]]), int(c[k[at]])
                    u, v = _root(root, p), _root(root, q)
                    if u != v and not buckets[j[at]].isdisjoint(buckets[k[at]]) and similar(w[j[at]].tolist(), w[k[at]].tolist(), least):
                        root[max(u, v)] = min(u, v)
                        links.append((min(p, q), max(p, q)))
                if links:
                    yield {"a": [p for p, _ in links], "b": [q for _, q in links]}

        return one

    return make


def _root(root: dict, v: int) -> int:
    while root[v] != v:
        root[v] = v = root[root[v]]
    return v


def _remaining(rest: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components: any two that a similar pair of nodes of one bucket of rest (s, x, c) joins are
    joined by these, directly or by others.

    Pairs are never rows, since in a family of texts that are just not similar there are as many as its square. Buckets of
    the same nodes count once. Nodes that may be similar to one of another component, which word counts tell, and that
    chains of such pairs join, are a family. In it every pair of a common bucket is looked at once, by word hashes. Large
    buckets and families are cut in blocks, and each two blocks meet by themselves, so none is one task's.
    """
    first = rest = written(rest, "rest")
    sets = rest.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("x")).alias("h"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("i"))
    sets = written(sets.where("lo <> hi").groupBy("k", "h", "i").agg(F.min("s").alias("s")).select("s", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "sets")
    rest = written(rest.join(sets, "s"), "rest")
    need = written(rest.select(F.col("x").alias("_node")).distinct(), "need")
    signs = written(arrow_map(_sifted(texts, need, "_node").join(need, "_node", "left_semi"), _signatures(), "x long, n long, g binary"), "signatures")
    kin = written(arrow_map(_meeting(rest.join(signs, "x"), "s", "x", "c", "n", "b", "g"), _kin(similarity), "x long, y long, c long, s long"), "kin")
    forget(first, sets, rest, need, signs)
    nodes = written(kin.groupBy("x").agg(F.min("y").alias("y"), F.min("c").alias("c"), F.collect_set("s").alias("s")), "nodes")
    families = connected_components(kin.where("x <> y").select("x", "y").distinct(), nodes.select(F.col("x").alias("node"), F.col("y").alias("label")))
    need = nodes.select(F.col("x").alias("_node"))
    words = arrow_map(_sifted(texts, need, "_node").join(need, "_node", "left_semi"), _words(), "x long, n long, w binary")
    members = written(nodes.drop("y").join(families.toDF("x", "f"), "x").join(words, "x"), "members")
    # At least as many blocks as make work for some tasks.
    blocks = F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n") / FAMILY_WORDS, F.least(F.lit(8), F.count("*") / 250))).cast("int").alias("blocks")
    units = _meeting(members.join(members.groupBy("f").agg(blocks), "f"), "f", "x", "c", "b", "s", "w")
    out = written(arrow_map(units, _linked(similarity), "a long, b long").distinct(), "linked")
    forget(kin, nodes, members)
    return out


def _meeting(rows: DataFrame, group: str, *cols: str) -> DataFrame:
    """group and m, the lists of cols, b being the block, of each two of the blocks of a group of rows (blocks: how many)."""
    spark = rows.sparkSession
    rows = rows.withColumn("b", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"u": F.least("b", "j"), "v": F.greatest("b", "j")})
    # Their work is far more than their bytes, by which adaptive execution would put them in a task or two.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    units = rows.repartition(tasks, group, "u", "v").groupBy(group, "u", "v").agg(F.collect_list(F.struct(*cols)).alias("m"))
    return units.where("size(m) > 1").select(group, "m")


def near_links(keyed: DataFrame, reps: DataFrame, similarity: float, sketches: int, length: int, shingle: int, rounds: int) -> DataFrame:
    """The components (node, component) of verified links between nodes of keyed, for all nodes with a link; reps (_node,
    _id) has the one row of a node that is read for its text.

    Nodes of an equal sketch are a bucket. Two steps:

    1. Each bucket has a centre a round, the node with the most links of those that weren't its centre yet, else the first
       in an order that all buckets share. Of the centres of its buckets a node is compared with the one that most of them
       name, so that a round tests at most a pair a node, however large a bucket is. This joins families cheaply; nodes
       known to be of one component aren't compared, and buckets of such are done. `rounds` only sets how much is left.
    2. Every pair of a bucket that could still join two components is compared, but for those that word counts rule out,
       and for those of two components that other pairs of the same two blocks have joined. Pairs aren't rows there.
    """

    def make():
        cache, kinds = WordHashes(), sketchers(similarity, sketches, length, shingle)

        def one(batch):
            for part in slices(batch, "_text"):
                out: list[list[np.ndarray]] = [[], []]
                for text, node in zip(part.column("_text").to_pylist(), part.column("_node").to_pylist(), strict=True):
                    h = cache.of(words_of(text))
                    s = np.concatenate([h[:0], *[omh.sketch(h) for first, end, omh in kinds if first <= len(h) <= end]])
                    out[0].append(np.full(len(s), node, np.int64))
                    out[1].append(s.view(np.int64))
                if out[0]:
                    yield {"x": np.concatenate(out[0]), "s": np.concatenate(out[1])}

        return one

    found = written(arrow_map(keyed.where("_node IS NOT NULL").select("_node", "_text"), make, "x long, s long"), "sketches")
    shared = written(found.groupBy("s").agg(F.min("x").alias("y"), F.max("x").alias("z")).where("y <> z").select("s"), "shared")
    rest = first = written(found.join(shared, "s").select("s", "x").distinct(), "buckets")
    forget(found, shared)
    spark = keyed.sparkSession
    need = written(rest.select(F.col("x").alias("_node")).distinct().join(reps, "_node"), "need")
    texts = _sifted(keyed, need, "_node", "_id").join(need, ["_node", "_id"])
    texts = written(texts.groupBy("_node", "_id").agg(F.first("_text").alias("_text")).select("_node", "_text"), "texts")
    forget(need)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(_sifted(texts.toDF("x", "tx"), pairs, "x"), "x")
        both = both.join(_sifted(texts.toDF("y", "ty"), pairs, "y"), "y")
        return written(arrow_map(both, _verify(similarity), "x long, y long"), "good")

    links = spark.createDataFrame([], "x long, y long")
    tried = links
    rest = rest.select("s", "x", F.col("x").alias("c"), F.lit(0).cast("long").alias("d"), F.lit(False).alias("used"))
    made = []
    for turn in range(rounds):
        centre = F.max(F.when(~F.col("used"), F.struct("d", F.xxhash64("x"), F.col("x").alias("y"), F.col("c").alias("yc")))).alias("k")
        centres = rest.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), centre).where("lo <> hi AND k IS NOT NULL")
        centres = written(centres.select("s", "k.y", "k.yc"), "centres")
        before, rest = rest, written(rest.join(centres, "s").select("s", "x", "c", "y", "yc", (F.col("used") | (F.col("x") == F.col("y"))).alias("used")), "buckets")
        forget(centres, *[before] * (turn > 0))
        named = rest.where("c <> yc").groupBy("x", "y").agg(F.count("*").alias("n")).groupBy("x").agg(F.max(F.struct("n", "y")).alias("k"))
        pairs = named.select(F.least("x", "k.y").alias("x"), F.greatest("x", "k.y").alias("y")).distinct()
        pairs = written(pairs.join(tried, ["x", "y"], "left_anti"), "pairs")
        good = verified(pairs)
        made += [pairs, good]
        links, tried = links.unionByName(good), tried.unionByName(pairs)
        # A node's label is the first of itself and the nodes it is linked with, in the order in which centres are taken:
        # nodes of one label are of one component, and the members of a family have their centre's.
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        label = F.max(F.greatest(F.struct(F.xxhash64("x"), F.col("x").alias("y")), F.struct(F.xxhash64("y"), "y")))["y"]
        state = written(both.groupBy("x").agg(label.alias("component"), F.count("*").alias("d")), "state")
        made += [state]
        before, rest = rest, written(rest.select("s", "x", "used").join(state, "x", "left").select("s", "x", F.coalesce("component", "x").alias("c"), F.coalesce("d", F.lit(0)).alias("d"), "used"), "buckets")
        forget(before)
    labels = state.select(F.col("x").alias("node"), F.col("component").alias("label")) if rounds else None
    parts = written(connected_components(links, labels).withColumnRenamed("node", "x"), "parts")
    # All of a bucket, former centres too: a node was compared with the centre that most of its buckets name, not with each.
    left = rest.select("s", "x").join(parts, "x", "left").select("s", "x", F.coalesce("component", "x").alias("c"))
    # Components take the place of their nodes: only links between them are left.
    linked = _remaining(left, texts, similarity)
    between = linked.toDF("x", "y")
    whole = connected_components(between).toDF("c", "whole")
    single = between.select(F.explode(F.array("x", "y")).alias("x")).distinct().join(parts, "x", "left_anti").select("x", F.col("x").alias("component"))
    out = parts.unionByName(single).withColumnRenamed("component", "c").join(whole, "c", "left")
    out = written(out.select(F.col("x").alias("node"), F.coalesce("whole", "c").alias("component")), "components")
    forget(first, rest, texts, linked, parts, *made)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, sketches: int, length: int, shingle: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """_id and _node for each row of docs; _node, _id (its smallest) and _part (its component) for each node."""
    keyed = _keyed(docs, id_col, text_col)
    nodes = written(keyed.select("_id", "_node"), "nodes")
    reps = written(nodes.where("_node IS NOT NULL").groupBy("_node").agg(F.min("_id").alias("_id")), "reps")
    parts = near_links(keyed, reps, similarity, sketches, length, shingle, rounds)
    labels = written(reps.join(parts, reps["_node"] == parts["node"], "left").select("_node", "_id", F.coalesce("component", "_node").alias("_part")), "labels")
    forget(parts, reps)
    return nodes, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, sketches: int = 48, length: int = 2, shingle: int = 3, rounds: int = 3) -> DataFrame:
    """`id_col`, class_id and class_hash for each row of docs: the smallest id of those that near-duplicate links join it
    with, and the class itself, which tells classes apart where ids are null or repeat (null for texts without a word).

    Equal texts are one node, so copies make no pairs. Candidates are texts with an equal order MinHash sketch (`length`
    k-mers of `shingle` words, under 100 words one of three words, under 10 one of two); links are candidates with an edit similarity, in words, of `similarity` or more. Classes
    are connected components. Texts are told apart by 64-bit hashes. Texts that are null or have no word are a class by
    themselves (their own id); texts of one word have copies only. Null ids count as the smallest.
    Rows that repeat are in one class. An empty table gives an empty one. Other columns are not read.
    """
    nodes, labels = _classes(docs, id_col, text_col, similarity, sketches, length, shingle, rounds)
    smallest = written(labels.groupBy("_part").agg(F.min("_id").alias("_class")), "smallest")
    classes = written(labels.join(smallest, "_part").select("_node", "_class", "_part"), "classes")
    forget(labels, smallest)
    out = nodes.join(classes, "_node", "left").select("_id", F.coalesce("_class", "_id").alias("_class"), "_part")
    back = lambda c: F.when(F.col(c) != LONG_MIN, F.col(c)).cast(docs.schema[id_col].dataType)
    return out.select(back("_id").alias(id_col), back("_class").alias("class_id"), F.col("_part").alias("class_hash"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, sketches: int = 48, length: int = 2, shingle: int = 3, rounds: int = 3) -> DataFrame:
    """docs, with all columns, but of each class of near_duplicates() one row only: that of the smallest id. Texts that
    are null or have no word all stay."""
    _, labels = _classes(docs, id_col, text_col, similarity, sketches, length, shingle, rounds)
    kept = labels.groupBy("_part").agg(F.min(F.struct("_id", "_node")).alias("k")).select("k._id", F.col("k._node").alias("_n"))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MIN)).alias("_id"), _node(F.col(text_col)).alias("_n"))
    one = rows.join(kept, ["_id", "_n"], "left_semi").dropDuplicates(["_id", "_n"])
    return one.select("_row.*").unionByName(rows.where("_n IS NULL").select("_row.*"))
