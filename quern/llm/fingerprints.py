"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's distinct five-word shingles. The sketch of a
union is the k smallest of the parts' hashes, so sketches merge; they estimate resemblance, containment and the
number of distinct shingles.

Cases: null text is empty; a text under five words has one shingle, all its words; a text without words has an empty
sketch; two empty sketches are alike (1), an empty and another aren't (0); equal texts have equal fingerprints; an
empty table gives no rows; extra columns are ignored; rows with one id are ordered by text, null ids come first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import let, words

K = 128
SHINGLE = 5
#: Ranges of ids, and ranges in each.
RANGES = 128


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k smallest hashes of the distinct n-word shingles, ascending."""

    def hashes(w: Column) -> Column:
        size = F.size(w)
        many = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
        return F.when(size >= n, many).when(size > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(let(words(text), hashes))), 1, k)


def merge(*sketches: Column, k: int = K) -> Column:
    """The sketch of the union of the parts."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(*sketches))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""
    shared = F.size(F.array_intersect(merge(a, b, k=k), F.array_intersect(a, b)))
    total = F.least(F.lit(k), F.size(F.array_union(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / total)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merged(sketches: DataFrame, keys: list[str], col: str = "sketch", k: int = K, spread: int = 64) -> DataFrame:
    """One sketch a key, of all its rows' sketches; hot keys are merged in `spread` parts first, at most k hashes from each."""
    h, part, rank = "sketch_hash", "sketch_part", "sketch_rank"
    rows = sketches.select(*keys, F.explode(col).alias(h)).distinct().withColumn(part, F.pmod(F.col(h), F.lit(spread)))
    least = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, part).orderBy(h))).where(F.col(rank) <= k)
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(h)), 1, k).alias(col))


def written(a: Column) -> Column:
    """A sketch as text: its hashes' bytes in base 64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def _among(cuts: dict[int, list[int]], of: Column, key: Column) -> Column:
    """How many of a row's cuts are at or below its key; of tells which cuts are a row's. They reach the plan as one literal."""
    table = F.from_json(F.lit(json.dumps([cuts.get(k, []) for k in range(max(cuts, default=-1) + 1)])), "array<array<bigint>>")
    return F.size(F.filter(F.coalesce(F.get(table, of.cast("int")), F.array().cast("array<bigint>")), lambda c: c <= key))


def in_ranges(docs: DataFrame, id_col: str, text_col: str, bucket: str, ways: int = RANGES) -> tuple[DataFrame, list[int]]:
    """docs with a bucket that ascends in the order of id (nulls first) and text; and the buckets that there are.

    Ids fall into `ways` ranges by approximate quantiles, and each range into `ways` by quantiles of its own, so a bucket
    holds about one in ways * ways of the rows however the ids lie; rows with one id share a bucket. Rows without an id
    are dealt in the same way by the first bytes of their text. The driver gets at most ways * ways numbers of each kind.
    """
    i = F.col(id_col).cast("long")
    kind, key = F.lit(1), i
    if not docs.where(i.isNull()).isEmpty():  # else no text is read here
        start = F.rpad(F.hex(F.substring(F.col(text_col).cast("binary"), 1, 7)), 14, "0")
        kind, key = F.when(i.isNull(), 0).otherwise(1), F.when(i.isNull(), F.conv(start, 16, 10).cast("long")).otherwise(i)
    shares = [k / ways for k in range(1, ways)]

    def quantiles(part: Column, accuracy: int) -> dict[int, list[int]]:
        rows = docs.select(part.alias("part"), key.alias("key")).groupBy("part").agg(F.percentile_approx("key", shares, accuracy).alias("cuts")).collect()
        return {r.part: sorted(set(r.cuts)) for r in rows}

    wide = kind * ways + _among(quantiles(kind, 10_000), kind, key)
    narrow = wide * ways + _among(quantiles(wide, 1_000), wide, key)
    there = docs.select(narrow.cast("long").alias("bucket")).distinct().collect()
    return docs.withColumn(bucket, narrow.cast("long")), sorted(r.bucket for r in there)


def with_next(docs: DataFrame, id_col: str, text_col: str, more: dict[str, Column], ways: int = RANGES) -> DataFrame:
    """Rows (doc_id, text, next_text, and each of `more`, a column of the text, with its next_). The last row's next is the first.

    Texts move once, to their bucket of the order. A bucket's last row gets the first text of the bucket behind, from a
    table with one text a bucket.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base, there = in_ranges(base, "doc_id", "text", "bucket", ways)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = base.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id"), F.col("text")))["text"].alias("first_text"))
    pairs = json.dumps([{"bucket": b, "behind": a} for a, b in zip([*there[-1:], *there[:-1]], there)])
    before = spark.range(1).select(F.inline(F.from_json(F.lit(pairs), "array<struct<bucket:long,behind:long>>")))  # bounded by ways * ways
    firsts = firsts.join(F.broadcast(before), "bucket").select("behind", "first_text")
    w = Window.partitionBy("bucket").orderBy("doc_id", "text")
    moved = base.repartition(n, "bucket").select("*", *(c.alias(name) for name, c in more.items()))
    led = moved.select("*", F.lead("text").over(w).alias("led_text"), *(F.lead(name).over(w).alias(f"led_{name}") for name in more))
    joined = led.join(firsts, F.col("bucket") == F.col("behind"), "left")
    return joined.select("doc_id", "text", *more, F.coalesce("led_text", "first_text").alias("next_text"), F.col("led_text").isNull().alias("at_end"), *(f"led_{name}" for name in more))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each text's fingerprint, that of its edited text (the second half replaced by the start of the next document), and the likenesses."""
    rows = with_next(docs, id_col, text_col, {"own": sketch(F.col("text"), k)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = rows.withColumn("edited", edited).withColumn("near", F.when(F.col("at_end"), sketch(F.col("next_text"), k)).otherwise(F.col("led_own"))).withColumn("other", sketch(F.col("edited"), k))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("near"), k).alias("near_next"),
    )
