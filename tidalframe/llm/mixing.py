r"""Mixing sources to target weights by a low-discrepancy schedule, in Spark SQL.

Each source's documents, shuffled by a hash of their ids, form one stream of words that starts
again at its end; equal blocks of ``block_words`` words are cut from it. A slot ``i`` of the
schedule has the van der Corput point of ``i`` (its bits reversed); the point falls into the
interval of one source on the line of cumulative targets, and the slot's rank among the slots
of its source names the block that it takes. So every prefix of the schedule holds the sources
near their shares. A source takes exactly its rounded target: its last block is cut, slots
beyond its need are left out, and the few that the schedule gave too little come at the end.

Targets: all words are shared by the weights; a target stops at ``limit`` times its source's
size and the excess is shared again by weight until none is above. A stream is read ``limit``
times at most, so no document is taken more often.

A null or blank text has size 0 and is never taken. The null source is a source of its own.
Repeated rows are documents of their own; of rows with equal ids the shorter comes first, so a
rerun gives the same rows. An empty table gives none; if all sizes are 0, so are all targets.
A very long text spans several blocks. Extra columns are not read.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranges

#: Bits of a point.
BITS = 48
#: Documents in a part of a stream, slots in a part of a source's schedule, points in a chunk of the line.
PART_ROWS, PART_SLOTS, CHUNK_POINTS = 1000, 1000, 65_536
#: Sources are broadcast up to this many, else shuffled.
BROADCAST_SOURCES = 100_000


def order_of(id_col: str, seed: int) -> Column:
    """60 bits of the MD5 digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 12) -> DataFrame:
    """(doc_id, __source, size, __h), stored: all that the schedule needs of a document."""
    size = F.regexp_count(common.text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return common.stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("__source"), size.alias("size"), order_of(id_col, seed).alias("__h")))


def sources_of(rows: DataFrame) -> DataFrame:
    """(__source, n_docs, source_size, ord): sources numbered from 0 by code point, null last."""
    found = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = F.col("__source").asc_nulls_last()
    return ranges.running(ranges.by_ranges(found, order), F.lit(1), [order], out="ord")


def with_targets(sources: DataFrame, weight: Column, limit: int = 3) -> DataFrame:
    """Adds ``target``. Each round is one aggregation; it ends when no further source reaches its limit."""
    w, cap = weight.cast("double"), (limit * F.col("source_size")).cast("double")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = cap < F.lit(level) * w
        full, open_ = sources.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(w))).first()
        now = (total - full) / open_ if open_ else level
        if now <= level:
            return sources.withColumn("target", F.least(cap, F.lit(level) * w))
        level = now


def joined(rows: DataFrame, sources: DataFrame, on: list[str] | Column) -> DataFrame:
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, on)


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """(slot, ord, block, words) over sources (ord, quota, start, all, __part), where start is the sum of quotas before."""
    spark, asked = sources.sparkSession, sources.agg(F.sum("quota")).first()[0] or 0
    n = max(1, -(-asked // block_words))
    bits = max(6, math.ceil(math.log2(max(1, n / CHUNK_POINTS))))
    width, line = 1 << (BITS - bits), 1 << BITS
    point = lambda words: F.floor(words / F.lit(float(max(asked, 1))) * F.lit(float(line))).cast("long")
    own = sources.filter("quota > 0").select("ord", "quota", point(F.col("start")).alias("__a"), point(F.col("start") + F.col("quota")).alias("__b"))
    edges = own.select(F.col("__a").alias("__u"), "ord")
    first, last = F.ceil(F.col("__a") / width).cast("long"), F.ceil(F.col("__b") / width).cast("long") - 1
    # The source at the start of each chunk, so that a chunk needs no other one.
    heads = own.filter(last >= first).select(F.explode(F.sequence(first, last)).alias("__c"), "ord").select((F.col("__c") * width).alias("__u"), "ord")
    u = F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("long")
    points = spark.range(n).select(u.alias("__u"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("ord"), F.col("id").alias("slot"))
    marks = edges.unionByName(heads).filter(F.col("__u") < line).select("__u", F.lit(0).alias("__kind"), F.col("ord").cast("long").alias("ord"), F.lit(None).cast("long").alias("slot"))
    rows = points.unionByName(marks).withColumn("__chunk", F.floor(F.col("__u") / width))
    at = Window.partitionBy("__chunk").orderBy("__u", "__kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    slots = common.stored(rows.withColumn("ord", F.last("ord", True).over(at)).filter("__kind = 1").select("slot", "ord"))
    share = joined(slots, sources.select("ord", "quota"), ["ord"]).withColumn(ranges.PART, F.floor(F.col("slot") * (F.col("quota") / F.lit(float(max(asked, 1)))) / PART_SLOTS))
    ranked = ranges.running(share, F.lit(1), [F.col("slot")], ["ord"], out="block")
    need = lambda: F.ceil(F.col("quota") / block_words).cast("long")
    ranked = ranked.filter(F.col("block") < need()).select("slot", "ord", F.col("block").cast("long").alias("block"), "quota")
    given = slots.groupBy("ord").agg(F.count(F.lit(1)).alias("__given"))
    short = sources.join(given, "ord", "left").na.fill(0, ["__given"]).withColumn("__short", F.greatest(need() - F.col("__given"), F.lit(0)))
    short = ranges.running(short, "__short", [F.col("ord")], out="__at").filter("__short > 0")
    closing = short.select("ord", "quota", "__at", "__given", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__short") - 1)).alias("__k"))
    closing = closing.select((F.lit(n) + F.col("__at") + F.col("__k")).alias("slot"), "ord", (F.col("__given") + F.col("__k")).alias("block"), "quota")
    words = F.least(F.lit(block_words).cast("long"), F.col("quota") - F.col("block") * block_words)
    return ranked.unionByName(closing).select("slot", "ord", "block", words.alias("words"))


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, limit: int = 3, block_words: int = 1000, seed: int = 12) -> DataFrame:
    """(doc_id, source, __row, size, source_size, target, slot, from_word, words): what each slot takes of each document.

    ``weight`` is a column over ``ord``, the number of the source, or ``__source``; by default 1,
    2, 3, repeating. ``from_word`` counts from 0 within the document. (source, __row) is unique
    to a document; documents of which nothing is taken have one row without a slot.
    """
    rows = sizes(docs, id_col, text_col, source_col, seed)
    sources = with_targets(sources_of(rows), F.col("ord") % 3 + 1 if weight is None else weight, limit)
    sources = sources.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    sources = common.stored(ranges.running(sources, "quota", [F.col("ord")], out="start"))
    slots = schedule(sources, block_words)
    known = sources.select(F.col("__source").alias("__s"), "ord", "n_docs", "source_size", "target", "quota")
    dealt = joined(rows, known, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    dealt = dealt.withColumn(ranges.PART, F.floor(F.col("__h") / F.lit(float(1 << 60)) * F.ceil(F.col("n_docs") / PART_ROWS)))
    order = [F.col("__h"), F.col("doc_id"), F.col("size")]
    streams = ranges.running(dealt, "size", order, ["ord"], out="__at")
    number = F.row_number().over(Window.partitionBy("ord", ranges.PART).orderBy(*order))
    streams = streams.withColumn("__row", F.col(ranges.PART) * F.lit(1 << 40) + number)
    start = lambda p: F.col("__at") + p * F.col("source_size")
    reads = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(limit - 1).cast("long")), lambda p: (F.col("size") > 0) & (start(p) < F.col("quota")))
    cut = F.flatten(
        F.transform(
            reads,
            lambda p: F.transform(
                F.sequence(F.floor(start(p) / block_words), F.floor((F.least(start(p) + F.col("size"), F.col("quota")) - 1) / block_words)),
                lambda b: F.struct(b.alias("b"), (F.greatest(start(p), b * block_words) - start(p)).alias("f"), (F.least(start(p) + F.col("size"), F.col("quota"), (b + 1) * block_words) - F.greatest(start(p), b * block_words)).alias("w")),
            ),
        )
    )
    kept = ["doc_id", F.col("__source").alias("source"), "__row", "size", "source_size", "target", "ord"]
    parts = streams.select(*kept, F.explode_outer(cut).alias("__x")).select(*[c if isinstance(c, str) else "source" for c in kept], F.col("__x.b").alias("__b"), F.col("__x.f").alias("from_word"), F.col("__x.w").alias("words"))
    # Documents without a block are no common key.
    parts = parts.withColumn("__b", F.coalesce("__b", -F.col("__row")))
    found = parts.join(slots.select("slot", F.col("ord").alias("__o"), F.col("block").alias("__k")), (F.col("ord") == F.col("__o")) & (F.col("__b") == F.col("__k")), "left")
    return found.drop("__o", "__k", "__b")


def taken(parts: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot): a row for each document."""
    rows = parts.groupBy("ord", "__row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0))).alias("taken"), F.min("slot").alias("first_slot"))
    return rows.drop("ord", "__row")
