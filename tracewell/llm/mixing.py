"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is water-filled under a cap of whole epochs. Complete epochs take every document; the rest of the
target is a weighted sample without replacement: documents in order of exponential keys -ln(u) / quality, up to the
budget. The order is never sorted as a whole: a histogram over key bins, summed by source, finds the one bin in which
the budget ends, and only that bin's documents are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import stored, texts

SCHEMA = "doc_id long, source string, size long, quality double, u double"
_BLANKS = bytes([32, *range(9, 14)])
_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """Size in words, a quality weight (share of letters among visible bytes, 0.05 at least) and a uniform number in (0, 1) hashed from id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch.column(2))
            size = [len(x.split()) for x in raw]
            shown = [len(x) - len(x.translate(None, _LETTERS)) for x in raw]
            seen = [len(x.translate(None, _BLANKS)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array([max(0.05, a / b) if b else 0.05 for a, b in zip(shown, seen)], pa.float64()), batch.column(3)], names=["doc_id", "source", "size", "quality", "u"])

    u = (F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), u.alias("u")).mapInArrow(run, SCHEMA)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. Water-filling in closed form: with ratio
    cap * size / weight ascending, the sources up to the k-th are capped and the rest share what is left by weight; k is
    the largest for which the k-th's ratio is at most the level that would remain. One row a source, so windows are small.
    """
    n = len(weights)
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n + 1)
    s = sizes.withColumn("w", w).withColumn("limit", cap * F.col("source_size"))
    rising = W.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    all_rows = W.partitionBy()
    s = s.withColumns({"all": share * F.sum("source_size").over(all_rows), "w_all": F.sum("w").over(all_rows), "capped": F.sum("limit").over(rising.rowsBetween(W.unboundedPreceding, -1)), "w_capped": F.sum("w").over(rising.rowsBetween(W.unboundedPreceding, -1))})
    level = (F.col("all") - F.coalesce("capped", F.lit(0.0))) / (F.col("w_all") - F.coalesce("w_capped", F.lit(0.0)))
    s = s.withColumn("open", F.col("w") * level < F.col("limit")).withColumn("level", level)
    s = s.withColumn("level", F.when(F.col("open"), F.col("level"))).withColumn("first", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("w"), F.col("level")))).over(all_rows)["level"])
    return s.select("source", F.col("source_size"), F.coalesce(F.least("limit", F.col("w") * F.col("first")), F.col("limit")).alias("target"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that the mix takes of each document, repeats counted.

    A document has `floor(target / source size)` complete epochs, then its place in the weighted sample. The document at
    which the budget ends is taken in part (its first words), so a source meets its target to rounding. Rows alike in id
    and text share a key: if the budget ends among them, each gives the same part. Null and empty texts have size 0 and
    give 0; null sources are one source, last; a table without words takes nothing; repeated rows count one by one;
    other columns are not read. Reruns agree: keys are hashes, order has no other input.
    """
    rows = stored(measured(docs, id_col, text_col, source_col, seed), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The smallest -ln(u) / q is the largest u ** (1 / q). Two digits of the place in that order find where the budget ends.
    place = F.floor((1.0 - F.pow("u", 1.0 / F.col("quality"))) * float(1 << 40)).cast("long")
    rows = rows.withColumn("place", place)
    ends = goal.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for level, shift in enumerate((30, 20)):
        ends = stored(_narrowed(rows, ends, shift), f"mix-ends-{level}")
    r = _with_source(rows, ends)
    digits = F.shiftright("place", 20)
    last = r.filter(digits == F.col("prefix"))
    # Only distinct documents are put in order, so that copies of one do not meet in a task; each then gets its part.
    alike = ["source", "place", "doc_id", "size"]
    each = last.groupBy(*alike).agg(F.sum("size").alias("tied"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    at = W.partitionBy("source").orderBy("place", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum("tied").over(at), F.lit(0)))
    each = stored(each.select(*(F.col(c).alias(f"_{c}") for c in alike), "tied", "left"), "mix-last")
    last = last.join(each, reduce(lambda a, c: a & c, (same(F.col(c), F.col(f"_{c}")) for c in alike)))
    part = F.when(F.col("left") <= 0, F.lit(0)).when(F.col("left") >= F.col("tied"), F.col("size")).otherwise(F.round(F.col("size") * F.col("left") / F.col("tied")))
    full = F.when(digits < F.col("prefix"), F.col("size")).otherwise(F.lit(0))
    kept = ["doc_id", "size", "source_size", "target"]
    take = lambda extra: (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken")
    return r.filter(digits != F.col("prefix")).select(*kept, take(full)).unionByName(last.select(*kept, take(part)))


def _with_source(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows beside what is known of their source; a stored row a source, so its measured size decides about a broadcast."""
    ends = ends.withColumnRenamed("source", "_source")
    return rows.join(ends, same(F.col("source"), F.col("_source"))).drop("_source")


def _narrowed(rows: DataFrame, ends: DataFrame, shift: int) -> DataFrame:
    """ends with 10 more bits of the place at which each source's budget ends, and the words before it."""
    r = _with_source(rows, ends).filter(F.shiftright("place", shift + 10) == F.col("prefix"))
    bins = r.groupBy("source", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("bin_size"), F.first("before").alias("base"), F.first("rest").alias("rest"))
    running = F.sum("bin_size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    bins = bins.withColumn("upto", F.col("base") + running)
    hit = bins.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("bin_size") <= F.col("rest")))
    hit = hit.groupBy(F.col("source").alias("_s")).agg(F.min("bin").alias("_bin"), F.min(F.col("upto") - F.col("bin_size")).alias("_before"))
    out = ends.join(hit, same(F.col("source"), F.col("_s")), "left")
    # The budget may end exactly with a source's words: then everything lies before the end.
    past = F.shiftleft(F.col("prefix") + 1, 10)
    return out.select("source", "source_size", "target", "epochs", "rest", F.coalesce("_bin", past).cast("long").alias("prefix"), F.coalesce("_before", F.col("before")).cast("long").alias("before"))
