r"""Document fingerprints: canonical exact digests in Spark SQL.

A text's canonical form is its Unicode NFKC form, case-folded, with white space folded to one
space and trimmed; Spark's own ICU library does the first two through ``java_method``. The
fingerprint is a 128-bit xxhash of that form. Texts that share a digest are compared byte for
byte; should different forms share one, the later forms get an ordinal appended. Likeness of
two fingerprints is 1 for equal forms and 0 otherwise.

Null counts as the empty text. Rows with equal ids follow each other by their texts; a null id
comes before all others. A single row is its own successor; an empty table gives none. Repeated
rows have equal fingerprints; whole texts are digested, however long; extra columns are not
read. Forms are compared over the table; that the edited text of ``compare_edited`` shares a
digest with another form of the table, a chance of 2 ** -128 for a pair, is not looked for.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ICU = "com.ibm.icu.text.Normalizer"
#: Digests that several rows share are broadcast up to this many (16 bytes each), else shuffled.
BROADCAST_DIGESTS = 1_000_000
FIRST = -(1 << 63)


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.call_function("java_method", F.lit(ICU), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    plain = F.lower(text)
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(fold(nfkc(text)))).otherwise(plain)
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def digest(form: Column) -> Column:
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(form), half(F.lit("second half"), form))


def conflicts(docs: DataFrame, text_col: str = "text") -> DataFrame | None:
    """(digest, form, ordinal) of different forms that share a digest; None without any.

    Only rows whose digest occurs more than once are compared, so only their texts move.
    """
    rows = docs.select(canonical(common.text_or_empty(text_col)).alias("__f"))
    shared = common.checkpoint(rows.select(digest(F.col("__f")).alias("__g")).groupBy("__g").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select("__g"))
    few = F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared
    forms = rows.withColumn("__d", digest(F.col("__f"))).join(few, F.col("__d") == F.col("__g"), "left_semi").distinct()
    several = forms.groupBy("__d").agg(F.count(F.lit(1)).alias("__c"), F.array_sort(F.collect_set("__f")).alias("__fs")).filter("__c > 1")
    found = common.checkpoint(several.select("__d", F.posexplode("__fs").alias("__k", "__f")).filter("__k > 0").select(F.col("__d").alias("__cd"), F.col("__f").alias("__cf"), "__k"))
    return None if found.isEmpty() else found


def fingerprint_of(rows: DataFrame, form: str, out: str, clashes: DataFrame | None) -> DataFrame:
    """Adds the fingerprint of a column with canonical forms."""
    if clashes is None:
        return rows.withColumn(out, digest(F.col(form)))
    marked = rows.withColumn("__d", digest(F.col(form)))
    joined = marked.join(clashes, (F.col("__d") == F.col("__cd")) & (F.col(form) == F.col("__cf")), "left")
    return joined.withColumn(out, F.concat_ws("-", "__d", F.col("__k").cast("string"))).drop("__d", "__cd", "__cf", "__k")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(common.text_or_empty(text_col)).alias("__f"))
    return fingerprint_of(rows, "__f", "fingerprint", conflicts(docs, text_col)).select("doc_id", "fingerprint")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds not above the key, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    array = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    heads, tails = array([g[0] for g in groups]), "array(" + ", ".join(array(g) for g in groups) + ")"
    at = F.size(F.filter(F.expr(heads), lambda b: b <= key))
    inner = F.size(F.filter(F.element_at(F.expr(tails), F.greatest(at, F.lit(1))), lambda b: b <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * step + inner)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next one by ascending id.

    Rows are dealt by ranges of ids and sorted within them: texts are shuffled once and no
    window spans the table. The first row of a range is also sent to the range before it, and
    the first of all to the last range.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST))
    rows = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"), key.alias("__key"))
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = rows.agg(F.percentile_approx("__key", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("b")).first()["b"]
    rows = rows.withColumn("__range", _range_of(F.col("__key"), sorted(set(points or []))))
    starts = [(r["__range"], r["first"]) for r in rows.groupBy("__range").agg(F.min("__key").alias("first")).orderBy("__range").collect()]
    before = [(first, starts[k - 1][0]) for k, (_, first) in enumerate(starts)]
    extra = docs.sparkSession.createDataFrame(before or [], "__first long, __before int")
    sent = rows.join(F.broadcast(extra), F.col("__key") == F.col("__first"), "left")
    copies = F.when(F.col("__before").isNull(), F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("x")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("x")), F.struct(F.col("__before").alias("r"), F.lit(1).alias("x"))))
    sent = sent.withColumn("__to", F.explode(copies)).select("doc_id", "text", "__key", F.col("__to.r").alias("__r"), F.col("__to.x").alias("__x"))
    order = Window.partitionBy("__r").orderBy("__x", "__key", "text")
    return sent.withColumn("next_text", F.lead("text").over(order)).filter("__x = 0").select("doc_id", "text", "next_text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and the likeness to it and to the next text.

    Edited: the last quarter of the code points replaced by the first as many of the next text.
    """
    clashes = conflicts(docs, text_col)
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("__f"), canonical(F.col("__edited")).alias("__e"), canonical(F.col("next_text")).alias("__n"))
    rows = fingerprint_of(fingerprint_of(rows, "__f", "fingerprint", clashes), "__e", "edited_fingerprint", clashes)
    same = lambda other: (F.xxhash64("__f") == F.xxhash64(other)) & (F.col("__f") == F.col(other))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.when(same("__e"), 1.0).otherwise(0.0).alias("near_edited"), F.when(same("__n"), 1.0).otherwise(0.0).alias("near_next"))
