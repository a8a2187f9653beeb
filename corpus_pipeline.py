"""Corpus pipeline: the stages in order, each written as Parquet and reread as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablekin.llm._common import forget, table, written
from tablekin.llm.language_id import UND, predict_language, train_language_id
from tablekin.llm.mixing import mixed
from tablekin.llm.near_dup import without_near_duplicates
from tablekin.llm.packing import pack
from tablekin.llm.queries import tokenizer_path
from tablekin.llm.substring_dedup import without_repeats

#: Documents of which even the likeliest language has less are rejected.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a recognisable language; where lang is null it is filled in.

    Null and empty texts and texts without a letter go; without a labelled row all go, since no language is known. Each
    row is judged by its whole text alone, so repeated rows and equal texts stay or go together; null ids are no matter.
    An empty table gives an empty one. All columns are kept, whatever their names.
    """
    pred, score = (_free(docs, name) for name in ("lang_pred", "lang_score"))
    told = predict_language(docs, train_language_id(docs), pred=pred, score=score)
    kept = told.where(f"`{pred}` <> '{UND}' AND `{score}` >= {LEAST_SCORE}")
    return kept.selectExpr(*[f"coalesce(lang, `{pred}`) AS lang" if c == "lang" else f"`{c}`" for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id, null ids being smallest; of rows that tie
    because they repeat id and text, any one.

    Texts that are null or have no word all stay. Texts of any length are compared whole. An empty table gives an empty
    one. All columns are kept, whatever their names.
    """
    return without_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that start anywhere else as well, and n_chars accordingly.

    Documents that were nothing else go, and so do all copies of a repeated long text; null and empty texts and those
    shorter than a passage stay as they are. Whole texts are read. An empty table gives an empty one. All columns are
    kept, whatever their names.
    """
    return without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that sources come near their targets.

    Null sources are a source of their own. Equal rows are taken one by one. Texts without a word weigh nothing and are
    in each whole epoch, and in the fraction as their keys have it. An empty table gives an empty one. All columns are
    kept, whatever their names.
    """
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are the end id alone; very long ones are cut into full windows; repeated rows are packed each;
    null ids stay null. An empty table gives an empty one. Other columns than doc_id and text are not read.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned and probabilistic stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`. A stage's table is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
