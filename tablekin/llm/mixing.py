"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, forget, n_words, written


def _between(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, and a straight line between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def quality_weight(text: Column, size: Column) -> Column:
    """The quality rules' statistics of a text as one weight from 0.05 to 1; 0.05 for texts without a word.

    The product of four shares: words of usual length (3 to 10 characters on average, fading out to 1 and 16), few symbols
    `#*$%&|<>` (fading out at one a word), lines that don't repeat earlier ones, and different words (of a text's words, or
    100 of them, whichever is less; fading out from a half).
    """
    text = F.coalesce(text, F.lit(""))
    some = F.greatest(size, F.lit(1)).cast("double")
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("double")
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    n_lines, n_different = F.size(lines).cast("double"), F.size(F.array_distinct(lines)).cast("double")
    words = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})")))).cast("double")
    mean = chars / some
    usual = _between(mean, 1.0, 3.0) * (1.0 - _between(mean, 10.0, 16.0))
    weight = usual * (1.0 - _between(symbols / some, 0.0, 1.0)) * (n_different / F.greatest(n_lines, F.lit(1.0))) * _between(words / F.least(some, F.lit(100.0)), 0.0, 0.5)
    return F.greatest(F.lit(0.05), weight)


def sample_key(ident: Column, text: Column, weight: Column) -> Column:
    """Exponential key: -ln(u) / weight, with u in (0, 1) drawn from the first 52 bits of an MD5 of the id and the text."""
    told = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def with_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _size, _key, _nth (a row's place, which tells rows apart that are equal) and _source (the source, told from null)."""
    sized = docs.withColumn("_size", n_words(F.col(text_col)))
    return sized.withColumns({
        "_key": sample_key(F.col(id_col), F.col(text_col), quality_weight(F.col(text_col), F.col("_size"))),
        "_nth": F.monotonically_increasing_id(),
        "_source": F.coalesce(F.concat(F.lit("a"), F.col(source_col)), F.lit("b")),  # null last by either
    })


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (_source, source_size) with each source's target: share of all words by weight, never over most x its size.

    The excess of capped sources goes to the others by weight until none is above: target = least(cap, level x weight),
    where the level is found among sources in the order of cap / weight. One row a source.
    """
    named = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy("_source")))
    ranked = ranked.withColumns({"_w": F.element_at(named, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")), "_cap": F.col("source_size") * float(most)})
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(up), F.lit(0.0))))
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(every)
    return ranked.select("_source", "source_size", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap"))).alias("target"))


def mix_plan(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """From rows (_id, _source, _size, _key, _nth): for each source its size, target, whole epochs and the last (_key, _id, _nth) of the fraction.

    Rows are range-partitioned by source and key, so that a large source lies in many partitions; each partition sums
    its sizes, and the totals of partitions before it are added.
    """
    dealt = sized.repartitionByRange("_source", "_key", "_id", "_nth").withColumn("_pid", F.spark_partition_id())
    dealt = written(dealt, "dealt")
    parts = dealt.groupBy("_source", "_pid").agg(F.sum("_size").alias("_words"))
    before = Window.partitionBy("_source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0)))  # partitions, not rows
    plan = targets(parts.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    size = F.col("source_size")
    plan = plan.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("epochs") * size)
    here = Window.partitionBy("_source", "_pid").orderBy("_key", "_id", "_nth").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("_run", F.sum("_size").over(here))
    run = run.join(parts.join(plan, "_source").select("_source", "_pid", "_base", "_rest"), ["_source", "_pid"])
    last = run.where((F.col("_rest") > 0) & (F.col("_base") + F.col("_run") - F.col("_size") / 2 <= F.col("_rest"))).groupBy("_source").agg(F.max(F.struct("_key", "_id", "_nth")).alias("_last"))
    out = written(plan.join(last, "_source", "left").select("_source", "source_size", "target", "epochs", "_last"), "plan")
    forget(dealt)
    return out


def _copies() -> Column:
    return (F.col("epochs") + F.coalesce(F.struct("_key", "_id", "_nth") <= F.col("_last"), F.lit(False)).cast("long")).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each row: `id_col`, size (words), source_size, target, copies and taken (copies x size).

    Sources in code point order, null last, weigh `weights`, repeating, and share `share` x all words; none has over
    `most` x its own. A source's whole epochs come first; the rest is taken in the order of exponential keys, up to
    the document whose middle passes the budget, so a source's sum differs from its target by half a document at most.
    Keys depend on ids and texts alone, so reruns agree; rows equal in both are taken one by one, in the order of the
    table. Null or empty texts have size 0 and add nothing. An empty table gives an empty one. Other columns are not read.
    """
    keyed = with_keys(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_src")), "_id", "_text", "_src")
    sized = written(keyed.select("_id", "_source", "_size", "_key", "_nth"), "keyed")
    plan = mix_plan(sized, weights, share, most)
    out = sized.join(plan, "_source").withColumn("copies", _copies())
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs with all their columns, each as often as mix_sources() says, which also states what odd rows give."""
    renamed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_src"))
    keyed = with_keys(renamed, "_id", "_text", "_src")
    plan = mix_plan(written(keyed.select("_id", "_source", "_size", "_key", "_nth"), "keyed"), weights, share, most)
    taken = keyed.join(plan, "_source").select("_row", _copies().alias("_n")).where("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
