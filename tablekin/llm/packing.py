"""Packing documents into sequences of fixed length by best fit decreasing."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, release, slices, words_of, written

PIECES_A_BIN = 50_000


class WordIds(dict):
    """Token ids of words (bytes) as little-endian bytes, for tokenizers that never join text across white space.

    The ids of a text are then those of its words, one after the other. Words unknown so far are encoded by the
    library; this tokenizer lowers letters and parts them from marks, so a capital or a last comma or full stop needs no
    encoding of its own. At a fixed size all words become the older generation and the one before is forgotten, so that memory is
    bounded and frequent words stay.
    """

    limit = 500_000

    def __init__(self, path: str):
        super().__init__()
        self.older: dict[bytes, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(word)) is not None:
            pass
        elif b"<|" not in word and (low := word.lower()) != word:
            out = self[low]
        elif len(word) > 1 and word[-1] in b".," and 97 <= word[-2] <= 122:
            out = self[word[:-1]] + self[word[-1:]]
        else:
            out = array("I", self.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One memory for all tasks of a Python worker."""
    return WordIds(path)


class Windows:
    """Open windows by remaining capacity, and a segment tree over capacities that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.open[room].append(window)
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of least room >= size."""
        count, at = self.count, size + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # climb until a right neighbour holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length, longest first; equal lengths in the given order."""
    window, offset, windows, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), Windows(capacity), 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = int(lengths[i])
        if found := windows.take(size):
            room, w = found
        else:
            room, w, n = capacity, n, n + 1
        window[i], offset[i] = w, capacity - room
        windows.put(room - size, w)
    return window, offset


def parts_words(spec: dict) -> bool:
    """Whether a tokenizer (the content of its file) takes every word by itself, whatever stands beside it, and lowers
    letters: white space is made one space at most and dropped, no normalizer or added token reaches over it, and the
    model is a plain one of merges. Such a text's ids are its words' ids, which is what WordIds relies on."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in norm.get("normalizers", [norm])]
    cuts = pre.get("pretokenizers", [pre])
    split = cuts[0] if cuts else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    return (
        kinds == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("pattern") == {"Regex": "\\s+"} and norm["normalizers"][1].get("content") == " "
        and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and split.get("invert") is True and split.get("behavior") == "Removed"
        and pattern == SPLIT and not cuts[1].get("use_regex") and not cuts[1].get("add_prefix_space")
        and spec.get("post_processor") is None and spec["model"].get("type") == "BPE" and spec["model"].get("dropout") is None
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or not t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    )


#: Fixed value: the word rule of the one kind of tokenizer that WordIds may serve.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _ids_of(path: str):
    """A function from texts to the library's ids as bytes: word by word where that is proven to be the same, else whole."""
    if parts_words(json.loads(Path(path).read_text())):
        one = word_ids(path).__getitem__
        return lambda text: b"".join(map(one, words_of(text)))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: array("I", tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


def _pieces(path: str, end_id: int, capacity: int):
    def make():
        ids_of, end = _ids_of(path), np.array([end_id], "<u4").tobytes()

        def one(batch):
            for part in slices(batch, "_text"):
                out = {c: [] for c in ("_id", "start", "length", "ids_crc32", "doc_tokens")}
                for ident, text in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist(), strict=True):
                    ids = ids_of(text) + end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = memoryview(ids)[4 * start : 4 * (start + capacity)]
                        for c, v in zip(out, (ident, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                            out[c].append(v)
                yield out

        return one

    return make


def _pack(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        window, offset = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        fill = np.bincount(window, weights=rows["length"].to_numpy()).astype(np.int64)
        rows["sequence_id"] = (np.int64(TaskContext.get().partitionId()) << 32) | window
        rows["offset"] = offset
        rows["sequence_tokens"] = fill[window]
        yield rows
        del parts, rows, window, offset, fill
        release()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of `capacity` tokens; a row for each piece of a document.

    A document is its ids, as the library gives them for `tokenizer` (a path; one that drops white space), and `end_id`.
    Overlong ones are first cut into full windows. What is left is dealt into bins of about 50,000 pieces, and each bin
    packs its own, longest first, into the open window with the least room that suffices. A bin leaves few windows
    badly filled, so padding falls with the bins' size, and no task holds more than a bin.
    Returns `id_col`, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (ids in the sequence)
    and padded_length (`capacity`, or sequence_tokens where that is a power of two). Null or empty texts have the end
    id alone. Repeated rows are packed each, and dealt to bins in turn like all others, so that none fills up with them.
    An empty table gives an empty one. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spec = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = written(arrow_map(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), _pieces(tokenizer, end_id, capacity), spec), "pieces")
    bins = max(1, -(-pieces.count() // PIECES_A_BIN))
    spread = pieces.repartition(bins).sortWithinPartitions("length", "ids_crc32", "_id", "start")  # in turn, each partition in its own order
    packed = spread.mapInPandas(_pack(capacity), spec + ", sequence_id long, offset long, sequence_tokens long")
    filled = F.col("sequence_tokens")
    power = filled.bitwiseAND(filled - 1) == 0
    return packed.withColumnRenamed("_id", id_col).withColumn("padded_length", F.when(power, filled).otherwise(F.lit(capacity)).cast("long"))
