"""Substring dedup: hash every run of several consecutive sentences, join the hashes globally, and remove sentences
that a non-first occurrence of a repeated run covers.

A sentence ends behind ., ! or ? with white space, or behind a line end; it keeps the white space behind it, so
sentences join to the text again. Sentences are compared by their words. From each sentence on, and up to each
sentence, the shortest run that has `span` sentences and `least` words counts, so long passages of short sentences are
found as well; a sentence of `long` words or more is a run by itself. Of the occurrences of a run, over all
documents, the one with the smallest (doc_id, place) is the first and stays; the others' sentences go.

Occurrences of a run are counted before they meet, so a run that many documents share costs one row a task, and the
join that marks its places can be split.

Of a verbatim passage of more than `passage` words, whose edge sentences may run on into other text, the whole
sentences go, if they are `span` or more, however short: a window of `span` sentences below `least` words counts where
it is repeated with the words around it, in all more than `passage`. One of the two sides has half of these words at
least, so windows with half on one side are joined first; only those shared, and not covered already, are extended
word by word. No occurrences are paired. A passage with fewer than `span` whole sentences stays, unless one has `long`
words.

Cases: null text is empty; empty texts stay; rows without an id count as ids below all others; rows with one id are
told apart by a hash of the text, and equal rows are one document, so all copies of the row get the same text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch

#: What ends a sentence.
END = re.compile(r"[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*")
#: Rows without an id.
NO_ID = -(1 << 63)
#: In the low half of a place: it is a window with half of the words around it, not a run.
HALF = 1 << 30
#: So many documents, 12 bytes each, are broadcast at most.
FEW = 1_000_000


def sentences(text: str) -> list[str]:
    """The text in pieces that join to it."""
    out, at = [], 0
    for m in END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if at < len(text) else out


def runs(pieces: list[str], span: int, least: int, long: int) -> list[tuple[int, int, int]]:
    """(first sentence, number of sentences, hash) of each run."""
    from xxhash import xxh3_64_intdigest as digest

    words = [p.encode().split() for p in pieces]
    n, size = len(words), [len(w) for w in words]
    keys = np.array([digest(b" ".join(w)) for w in words], "<u8").tobytes()
    found = {(i, i + 1) for i in range(n) if size[i] >= long}
    total = j = 0
    for i in range(n):  # from each sentence on
        while j < n and (j < i + span or total < least):
            total += size[j]
            j += 1
        if j < i + span or total < least:
            break
        found.add((i, j))
        total -= size[i]
    total, i = 0, n
    for j in range(n, 0, -1):  # up to each sentence
        while i > 0 and (i > j - span or total < least):
            i -= 1
            total += size[i]
        if i > j - span or total < least:
            break
        found.add((i, j))
        total -= size[j - 1]
    return [(i, j - i, digest(keys[8 * i : 8 * j]) - (1 << 63)) for i, j in sorted(found)]


def windows(pieces: list[str], span: int, least: int) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The words, and (first sentence, first word, word behind) of each window of `span` sentences below `least` words."""
    words = [p.encode().split() for p in pieces]
    ends = [0]
    for w in words:
        ends.append(ends[-1] + len(w))
    return [x for w in words for x in w], [(i, ends[i], ends[i + span]) for i in range(len(words) - span + 1) if ends[i + span] - ends[i] < least]


def halves(pieces: list[str], span: int, least: int, passage: int) -> list[tuple[int, int]]:
    """(first sentence, hash) of each window with half of the words that it lacks, on the right and on the left."""
    from xxhash import xxh3_64_intdigest as digest

    words, found = windows(pieces, span, least)
    out = []
    if len(words) > passage:
        for i, a, b in found:
            more = max(0, passage + 2 - (b - a)) // 2
            if b + more <= len(words):
                out.append((i, digest(b"right %d " % (b - a) + b" ".join(words[a : b + more])) - (1 << 63)))
            if more <= a:
                out.append((i, digest(b"left %d " % (b - a) + b" ".join(words[a - more : b])) - (1 << 63)))
    return out


def extended(pieces: list[str], at: set[int], span: int, least: int, passage: int) -> list[tuple[int, int]]:
    """(first sentence, hash) of each stretch of more than `passage` words around each window that starts at one of at."""
    from xxhash import xxh3_64_intdigest as digest

    words, found = windows(pieces, span, least)
    out = []
    for i, a, b in found:
        if i in at:
            n = max(passage + 1, b - a)
            # with the window's place in it, so that two windows of one stretch are no repeat
            out += [(i, digest(b"%d %d " % (a - k, b - a) + b" ".join(words[k : k + n])) - (1 << 63)) for k in range(max(0, b - n), min(a, len(words) - n) + 1)]
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 2, least: int = 25, long: int = 40, passage: int = 50) -> DataFrame:
    """Per row: doc_id, n_sentences, n_removed, n_chars (of what stays), text (what stays)."""
    s = Scratch(docs.sparkSession, "substring-dedup")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def key(text: str) -> int:
        return zlib.crc32(text.encode()) - (1 << 31)

    def rows(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        """of: gives (hash, place) for a text and what stands in the columns behind it."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                cols: tuple[list, ...] = ([], [], [], [])
                for i, t, *more in zip(*(c.to_pylist() for c in b.columns)):
                    if t:
                        found = of(sentences(t), *more)
                        cols[0].extend([h for h, _ in found])
                        cols[1].extend([i] * len(found))
                        cols[2].extend([key(t)] * len(found))
                        cols[3].extend([p for _, p in found])
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["hash", "id", "row", "place"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(batches, lambda pieces: [*((h, at << 32 | n) for at, n, h in runs(pieces, span, least, long)), *((h, at << 32 | HALF) for at, h in halves(pieces, span, least, passage))])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(batches, lambda pieces, at: [(h, i << 32 | span) for i, h in extended(pieces, set(at), span, least, passage)])

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of later windows that the removed runs don't cover."""
        for b in batches:
            out: set[int] = set()
            for places, half in zip(b.column("places").to_pylist(), b.column("half").to_pylist()):
                gone = {k for p in places for k in range(p >> 32, (p >> 32) + (p & 0xFFFFFFFF))}
                out.update(x["hash"] for x in half if x["later"] and not all(k in gone for k in range(x["at"], x["at"] + span)))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int64())], names=["needed"])

    # place: first sentence in the high half, number of sentences in the low half
    schema = "hash long, id long, row int, place long"
    where = F.struct("id", "row", "place")

    def repeated(places: DataFrame, name: str) -> DataFrame:
        """places whose hash has several, with the first one."""
        shared = places.groupBy(F.col("hash").alias("of")).agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").select("of", "first")
        shared = s.write(shared, name)  # read from a table, so that the join below has an exchange on both sides, which can be split
        return places.join(shared, F.col("hash") == F.col("of"))

    hits = repeated(base.mapInArrow(split, schema), "shared").withColumn("later", where != F.col("first"))
    is_half = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) == HALF
    window = F.struct("hash", F.shiftright("place", 32).cast("int").alias("at"), "later")
    hits = hits.where(is_half | F.col("later")).groupBy("id", "row")
    hits = s.write(hits.agg(F.collect_set(F.when(~is_half, F.col("place"))).alias("places"), F.collect_set(F.when(is_half, window)).alias("half")), "hits")

    # windows to extend: those with a hash that an uncovered later one has
    needed = s.write(hits.where(F.size("half") > 0).select("places", "half").mapInArrow(bare, "needed long").distinct(), "needed")
    some = hits.select("id", "row", F.explode("half").alias("x")).join(needed, F.col("x.hash") == F.col("needed"))
    some = s.write(some.groupBy("id", "row").agg(F.collect_set("x.at").alias("starts")), "windows")
    # the same number as key()
    own = (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - (1 << 31)).cast("int")
    same = (F.col("doc_id") == F.col("id")) & (own == F.col("row"))
    few = some.count() <= FEW
    near = base.join(F.broadcast(some.select("id", "row")), same, "left_semi") if few else base
    stretches = s.write(near.join(some, same).select("doc_id", "text", "starts").mapInArrow(extend, schema), "stretches")
    later = repeated(stretches, "shared-stretches").where(where != F.col("first")).groupBy("id", "row").agg(F.collect_set("place").alias("places"))
    gone = hits.where(F.size("places") > 0).select("id", "row", "places").unionByName(later).groupBy("id", "row")
    gone = s.write(gone.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")), "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                ids, sizes, lost, texts = [], [], [], []
                for i, t, marked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    pieces, drop = sentences(t or ""), set()
                    for p in marked or ():
                        drop.update(range(p >> 32, (p >> 32) + (p & 0xFFFFFFFF)))
                    ids.append(None if i == NO_ID else i)
                    sizes.append(len(pieces))
                    lost.append(len(drop))
                    texts.append("".join([x for k, x in enumerate(pieces) if k not in drop]) if drop else t or "")
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_sentences", "n_removed", "n_chars", "text"])

    both = base.join(gone, same, "left").select("doc_id", "text", "places")
    return both.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, n_chars long, text string")
