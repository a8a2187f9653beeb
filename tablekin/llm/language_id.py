"""Language identification with a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_add, arrow_map, slices

#: Bytes of a text that a window labels, and those on either side of them that the network reads besides.
BODY, CONTEXT = 192, 16
#: Windows in a batch. A step's matrix product then stays below the size from which OpenBLAS starts threads, which for such
#: small products cost many times their work.
BATCH = 1024
UND = "und"


class Windows:
    """Texts (bytes) cut into windows: their bytes (time, window), and masks of what is no padding and of what is body.

    Bodies cover each text once, from its first byte to its last; context reaches over their ends as far as the text goes.
    """

    def __init__(self, texts: list[bytes], body: int = BODY, context: int = CONTEXT):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = -(-sizes // body)
        self.text = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(sizes)
        place = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = place * body
        self.low = np.maximum(first - context, 0)
        self.high = np.minimum(first + body + context, sizes[self.text])
        self.first, self.last = first - self.low, np.minimum(first + body, sizes[self.text]) - self.low
        self.base = (ends - sizes)[self.text] + self.low
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def __len__(self) -> int:
        return len(self.text)

    def batch(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = (self.high - self.low)[some]
        at = np.arange(size.max(initial=1))[:, None]
        mask = at < size
        ids = self.flat[np.minimum(self.base[some] + at, len(self.flat) - 1)].astype(np.int64)
        return ids, mask.astype(np.float32), ((at >= self.first[some]) & (at < self.last[some])).astype(np.float32)


class ByteGRU:
    """A gated recurrent layer in each direction over the bytes of a window; each position gets a distribution over labels
    from both states there. The mask holds a state still at padding, so a window's result does not depend on the others.

    Both directions run at once: arrays are (direction, unit, window), the second direction reading from the end.
    """

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 0):
        rng, n, h = np.random.default_rng(seed), len(labels), hidden
        self.labels, self.hidden = labels, hidden
        self.p = {
            "x": 0.1 * rng.standard_normal((3 * h, 512)),  # by byte; from 256 on for the second direction
            "h": rng.standard_normal((2, 3 * h, h)) / np.sqrt(h),
            "n": np.zeros((2, h, 1)),
            "o": 0.1 * rng.standard_normal((2, n, h)),
            "c": np.zeros((n, 1)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, ids: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (step, direction, hidden, window)."""
        h, p, (steps, wide) = self.hidden, self.p, ids.shape
        state, out = np.zeros((2, h, wide), mask.dtype), np.empty((steps, 2, h, wide), mask.dtype)
        x, u = np.empty((3 * h, 2 * wide), mask.dtype), np.empty((2, 3 * h, wide), mask.dtype)
        xs = x.reshape(3 * h, 2, wide).transpose(1, 0, 2)
        whole = np.flatnonzero(mask.all(1) & mask[::-1].all(1))
        whole = set(whole.tolist())
        at = np.empty(2 * wide, np.int64)
        for t in range(steps):
            at[:wide] = ids[t]
            np.add(ids[-1 - t], 256, out=at[wide:])
            np.take(p["x"], at, axis=1, out=x, mode="clip")
            np.matmul(p["h"], state, out=u)
            gate, new = u[:, : 2 * h], u[:, 2 * h :]
            gate += xs[:, : 2 * h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            new += p["n"]
            if tape is not None:
                inner = new.copy()
            new *= gate[:, h:]
            new += xs[:, 2 * h :]
            np.tanh(new, out=new)
            if tape is not None:
                tape.append((state, gate[:, :h].copy(), gate[:, h:].copy(), inner, new.copy()))
            new -= state
            new *= gate[:, :h]
            if t not in whole:
                new *= np.stack([mask[t], mask[-1 - t]])[:, None]
            state = np.add(state, new, out=out[t])
        return out

    def _log_probs(self, states: np.ndarray) -> np.ndarray:
        """(position, label, window)."""
        out = np.matmul(self.p["o"][0], states[:, 0])
        out += np.matmul(self.p["o"][1], states[::-1, 1])
        out += self.p["c"]
        out -= out.max(1, keepdims=True)
        out -= np.log(np.exp(out).sum(1, keepdims=True))
        return out

    def loss(self, batch: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the positions of bodies, and its gradient by backpropagation through time."""
        ids, mask, body = batch
        h, p, tape = self.hidden, self.p, []
        states = self._run(ids, mask, tape)
        logp, at, total = self._log_probs(states), np.arange(len(labels)), body.sum()
        value = -(logp[:, labels, at] * body).sum() / total
        d = np.exp(logp)
        d[:, labels, at] -= 1
        d *= (body / total)[:, None]
        grad = {"o": np.stack([np.einsum("tnb,thb->nh", d, s, optimize=True) for s in (states[:, 0], states[::-1, 1])]), "c": d.sum((0, 2))[:, None], "h": np.zeros_like(p["h"]), "n": np.zeros_like(p["n"])}
        ds = np.stack([np.matmul(p["o"][0].T, d), np.matmul(p["o"][1].T, d[::-1])], 1)
        dxs, dh = np.empty((len(ids), 2, 3 * h, len(labels)), mask.dtype), np.zeros_like(ds[0])
        for t in range(len(ids) - 1, -1, -1):
            old, k, r, inner, new = tape[t]
            dh = dh + ds[t]
            m = np.stack([mask[t], mask[-1 - t]])[:, None]
            dn = dh * m * k * (1 - new * new)
            dk = dh * m * (new - old) * 2 * k * (1 - k)
            dr = dn * inner * 2 * r * (1 - r)
            dun = dn * r
            dxs[t] = np.concatenate([dk, dr, dn], 1)
            du = np.concatenate([dk, dr, dun], 1)
            grad["n"] += dun.sum(2, keepdims=True)
            grad["h"] += du @ old.transpose(0, 2, 1)
            dh = dh * (1 - m * k) + p["h"].transpose(0, 2, 1) @ du
        grad["x"] = np.empty_like(p["x"])
        for way, seen in enumerate((ids, ids[::-1])):
            flat = np.ascontiguousarray(seen).ravel()
            for i in range(3 * h):
                grad["x"][i, 256 * way : 256 * (way + 1)] = np.bincount(flat, np.ascontiguousarray(dxs[:, way, i]).ravel(), 256)
        return float(value), grad

    def train(self, windows: Windows, labels: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 0) -> None:
        """Adam over at least `steps` batches, and over all windows once at least; labels are those of the texts."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        epochs = max(1, -(-steps * batch // len(windows)))
        step, steps = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                _, grad = self.loss(windows.batch(some), labels[windows.text[some]])
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each non-empty text the mean log probability of each label over all of its bytes."""
        cut = Windows(texts)
        total, order = np.zeros((len(texts), len(self.labels))), np.argsort(cut.high - cut.low, kind="stable")
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            ids, mask, body = cut.batch(some)
            logp = self._log_probs(self._run(ids, mask))
            np.add.at(total, cut.text[some], np.einsum("tnb,tb->bn", logp, body))
        return total / np.fromiter(map(len, texts), np.int64, len(texts))[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_a_label: int = 100, steps: int = 150, seed: int = 0) -> ByteGRU | None:
    """Train on the whole texts of at most `rows_a_label` rows of each label.

    Ids are dealt by hash into `rows_a_label` cells a label, of each of which the id of the smallest other hash is taken,
    so the choice is an aggregate that combines before the shuffle. Of rows that repeat an id one is read. Held-out rows,
    null ids, null labels and texts without a letter are not used. None if nothing is left. Only these ids and then these
    texts come to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text")).where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    cells = rows.groupBy("lang", F.pmod(F.xxhash64("id"), F.lit(rows_a_label))).agg(F.min(F.struct(F.xxhash64(F.lit(1), "id"), "id")).alias("k"))
    chosen = cells.select("lang", "k.id").collect()
    if not chosen:
        return None
    few = spark.createDataFrame(chosen, f"lang string, id {docs.schema[id_col].dataType.simpleString()}")
    read = rows.join(F.broadcast(few), ["lang", "id"])  # rows_a_label rows a label
    one = read.groupBy("lang", "id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    sample = sorted((r.lang.encode("utf-8", "surrogatepass"), raw(r._text)) for r in one.select("lang", "_text").collect() if has_letter(r._text))
    if not sample:
        return None
    labels = sorted({lang for lang, _ in sample})
    model = ByteGRU([x.decode("utf-8", "surrogatepass") for x in labels], seed=seed)
    model.train(Windows([t for _, t in sample], 48, 0), np.array([labels.index(lang) for lang, _ in sample]), steps, seed=seed)
    return model


def predict_language(docs: DataFrame, model: ByteGRU | None, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted label and its score, from the whole text alone.

    Every byte is labelled, from windows that overlap by their context; a document's probabilities are the normalized
    geometric means of its bytes'. `und` with score 0 for null texts, texts without a letter, and without a model. Rows
    are kept as they are, with all columns; no shuffle.
    """
    if {pred, score} & set(docs.columns):
        raise ValueError(f"docs has a column {pred} or {score} already; name others")

    def make():
        def one(batch):
            preds, values, at = [UND] * len(batch), np.zeros(len(batch)), 0
            for part in slices(batch, text_col, 1_000_000) if model else ():
                rows = [(at + i, raw(t)) for i, t in enumerate(part.column(text_col).to_pylist()) if has_letter(t)]
                if rows:
                    mean = model.pooled([t for _, t in rows])
                    prob = np.exp(mean - mean.max(1, keepdims=True))
                    prob /= prob.sum(1, keepdims=True)
                    for (i, _), best, top in zip(rows, prob.argmax(1), prob.max(1), strict=True):
                        preds[i], values[i] = model.labels[best], top
                at += len(part)
            return {pred: preds, score: values}

        return one

    return arrow_add(docs, make, f"{pred} string, {score} double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`id_col`, held_out, lang_pred and score for each row: train_language_id(), then predict_language().

    Rows whose crc32(id as text) mod 3 is 1 are held out of training; a null id counts as the empty text. Repeated rows
    are kept; an empty table gives an empty one. Other columns are not read.
    """
    model = train_language_id(docs, id_col, text_col, lang_col)
    out = predict_language(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score")
