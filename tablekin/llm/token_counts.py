"""Exact token counts; huge documents are encoded in overlapping chunks and spliced."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, slices

#: A place before a space and after a character that is not white space. Byte-level pre-tokenization starts a new word
#: at each such place, whatever stands further left or right, and no merge crosses it: a proven stable boundary.
STABLE = re.compile(r"(?<=\S)(?= )")


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer (the content of its file) has STABLE boundaries: the byte-level word rule, no normalizer, merges
    within words only, and no added token that takes white space with it."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"].get("type") == "BPE" and spec["model"].get("dropout") is None
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )


def _starts(encoding) -> np.ndarray:
    return np.array(encoding.offsets, np.int64).reshape(-1, 2)[:, 0]


def _splice(text: str, begin: int, left, lo: int, right) -> tuple[int, int] | None:
    """Where tokens of the chunk from begin go over to those of the chunk from lo: (tokens kept of the left, tokens skipped of the right).

    The tokens between two neighbouring stable boundaries inside the overlap must be the same in both.
    """
    end = begin + left["size"]
    places = [m.start() for m in STABLE.finditer(text, lo + 1, end)]
    for a, b in zip(places[-2::-1], places[:0:-1], strict=True):
        (la, lb), (ra, rb) = (np.searchsorted(x["starts"], (a - at, b - at)) for x, at in ((left, begin), (right, lo)))
        if left["ids"][la:lb] == right["ids"][ra:rb]:
            return int(lb), int(rb)
    return None


def count_spliced(encode, text: str, chunk: int = 32_768, overlap: int = 512) -> int:
    """The number of tokens of text; encode(str) gives the library's encoding of a chunk.

    Chunks of `chunk` characters overlap by `overlap`. If a pair can't be aligned, the overlap is widened, twofold each
    time; at last both chunks are encoded as one. Two chunks are in memory at a time.
    """

    def encoded(a: int, b: int) -> dict:
        e = encode(text[a:b])
        return {"ids": e.ids, "starts": np.maximum.accumulate(_starts(e)), "size": b - a}

    begin, end, total = 0, min(chunk, len(text)), 0
    left, skip = encoded(begin, end), 0
    while end < len(text):
        wide, joined = overlap, None
        while joined is None and wide < end - begin:
            lo, hi = end - wide, min(len(text), end - wide + max(chunk, 2 * wide))
            right = encoded(lo, hi)
            joined = _splice(text, begin, left, lo, right)
            wide *= 2
        if joined is None:  # no boundary at all so far: one longer chunk
            end = min(len(text), end + max(chunk, end - begin))
            left = encoded(begin, end)
            continue
        total += joined[0] - skip
        begin, end, left, skip = lo, hi, right, joined[1]
    return total + len(left["ids"]) - skip


def _counts(path: str, chunk: int, overlap: int):
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        most = chunk if byte_level(json.loads(Path(path).read_text())) else float("inf")

        def one(batch):
            for part in slices(batch, "_text", 1_000_000):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                short = list({t for t in texts if len(t) <= most})
                known = dict(zip(short, map(len, tokenizer.encode_batch_fast(short, add_special_tokens=False)), strict=True))
                for t in texts:
                    if t not in known:
                        known[t] = count_spliced(lambda s: tokenizer.encode(s, add_special_tokens=False), t, chunk, overlap)
                yield {"_id": part.column("_id"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [known[t] for t in texts]}

        return one

    return make


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """`id_col`, n_bytes, n_tokens and over_limit (n_tokens > `limit`) for each row of docs.

    Counts are those of the library for the file `tokenizer` without added special tokens; special strings in a text count
    as the library's default has it. Texts over `chunk` characters go through count_spliced() if the tokenizer's file says
    that it is byte_level(); texts for any other are encoded whole. Null counts as empty: 0 bytes, 0 tokens. No shuffle; rows are kept as they are, repeated or
    not. An empty table gives an empty one. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), _counts(tokenizer, chunk, overlap), f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
