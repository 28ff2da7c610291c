"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each text's set of word shingles gives a signature of `coordinates` minima. Texts with equal sets are one class,
   and only the class's smallest document id goes on.
2. Documents are posted under keys: the values of `together` neighbouring coordinates, with their place. A single value
   is one frequent shingle that more and more unlike documents share as the table grows; two values at once are not.
   Each of the coordinates - matches that may differ spoils one key, so two documents with `matches` equal ones share at
   least `shared_keys`, one of them among the rarest keys - shared_keys + 1 of both. Only these prefixes are kept; keys
   that one document alone has count as the rarest, and a document with fewer than `shared_keys` keys in common with
   others drops out: no pair with `matches` is lost by that. Of posting lists with the same members one is kept.
3. In each posting list, a leader is compared with every other member: rows grow with the lists, not their squares.
   Collisions are counted on the signatures; candidates with `matches` or more are confirmed on the full sets.
   Confirmed links are joined to components. A second round takes leaders by chance, in lists that still hold several components.
4. What then still lies in one list but in different components is compared exhaustively: members outside the
   list's largest component against all, in blocks of bounded size, by counting shared shingles through the block's
   sorted shingles. So long lists are skipped, not dropped, and no link between components is lost. Lists that hang
   together by their members are compared as one where fewer sets move so.

Tables with a row a list, heap or node are written before they meet the rows of those keys: a broadcast carries them
if they are few by count, else both sides of the join have an exchange, so that a hot list or heap can be split.

A document is missed only if a linked pair shares fewer than `matches` of `coordinates` values: at 80 % similarity,
60 of 96 fall short with a probability of about 2 in 100,000, and a component then still holds by its other links.

Cases: null and empty texts, and texts without words, have an empty set and no links; a text with fewer words than a
shingle is one shingle; ids are compared as numbers, rows with one id count each by their text, which keep_first()
tells apart by a hash, and of rows with equal id and text it keeps one; rows without an id aren't linked, have no
component and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE_CHARS, Scratch, fresh


@dataclass(frozen=True)
class Settings:
    """percent: Jaccard similarity from which documents are linked. outsiders, members: shingles in a block of
    either side of an exhaustive comparison; the members' are sorted. together: coordinates in a key. few_ids, few_rows: so many ids, or rows of several numbers, are broadcast at most."""

    shingle: int = 5
    percent: int = 80
    coordinates: int = 96
    matches: int = 60
    together: int = 2
    outsiders: int = 4_000_000
    members: int = 500_000
    few_ids: int = 1_000_000
    few_rows: int = 200_000
    seed: int = 5

    @property
    def shared_keys(self) -> int:
        """Keys that two documents with `matches` equal coordinates share at least."""
        n = -(-self.coordinates // self.together) - (self.coordinates - self.matches)
        if n < 1:
            raise ValueError("so many coordinates in a key could lose documents with `matches` equal ones")
        return n


class Shingler:
    """Sets of shingle hashes of texts in bytes; keeps the hashes of a bounded number of words."""

    KEPT = 500_000

    def __init__(self, s: Settings):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        self.s, self.known, self.hash, self.wide = s, {}, xxh3_64_intdigest, xxh3_128_digest
        rng = np.random.default_rng(s.seed)
        self.factors = rng.integers(0, 1 << 63, s.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def set(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes of the shingles. bytes.lower() and split() know ASCII letters and white space only."""
        words = text.lower().split()
        n = min(self.s.shingle, len(words))
        if not n:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.KEPT:
            self.known.clear()
        known, found = self.known, list(map(self.known.get, words))
        if None in found:
            for w, h in zip(words, found):
                if h is None:
                    known[w] = self.hash(w)
            found = list(map(known.__getitem__, words))
        h = np.array(found, np.uint64)
        m = len(h) - n + 1
        out = h[:m] + np.uint64(n)
        for j in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : m + j]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return np.unique(out ^ (out >> np.uint64(29)))

    def signature(self, x: np.ndarray) -> np.ndarray:
        low = np.full(self.s.coordinates, np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(x), 1024):
            np.minimum(low, np.multiply.outer(self.factors, x[lo : lo + 1024]).min(axis=1), out=low)
        return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


_shinglers: dict[Settings, Shingler] = {}


def shingler(s: Settings) -> Shingler:
    return _shinglers.setdefault(s, Shingler(s)) if s not in _shinglers else _shinglers[s]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def text_key(col: str) -> Column:
    """A hash that tells the texts of rows with one id apart."""
    return F.xxhash64(F.col(col).cast("string"))


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, signature); the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shingler(s)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                sizes, keys, sigs = [], [], []
                for t in b.column(2).to_pylist():
                    x = f.set((t or "").encode())
                    sizes.append(len(x))
                    keys.append(f.wide(x.tobytes()) if len(x) else None)
                    sigs.append(f.signature(x) if len(x) else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(sigs, pa.int32())], names=["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    return docs.select("doc_id", text_key("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, signature array<int>")


def postings(nodes: DataFrame, s: Settings) -> DataFrame:
    """(node, pair) for each key of nodes (node, signature); pair is a hash of the key's place and values, so equal keys always meet."""
    keys = F.transform(F.sequence(F.lit(1), F.lit(s.coordinates), F.lit(s.together)), lambda i: F.xxhash64(i, F.slice("signature", i, s.together)))
    return nodes.select("node", F.explode(keys).alias("pair"))


def shingle_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(node, signature, shingles) for documents (doc_id, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shingler(s)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                found = [f.set((t or "").encode()) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([f.signature(x) for x in found], pa.int32()), _lists([x.view(np.int64) for x in found], pa.int64())], names=["node", "signature", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, signature array<int>, shingles array<long>")


def components(edges: DataFrame, scratch: Scratch, name: str, few: int) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node reachable.

    Alternating large and small stars: each round sends nodes to their smallest neighbour, by grouping and joining only,
    until nothing changes. Of more than `few` edges, the smallest neighbours are written before they meet the edges.
    """
    e = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    seen, n, before = None, e.count(), f"{name}-edges"
    for k in itertools.count():
        held = (lambda df, x: scratch.write(df, f"{name}-{x}-{k}")) if n > few else lambda df, x: df  # noqa: B023
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = held(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.where("a <> b").distinct(), f"{name}-large-{k}")
        least = held(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least-large")
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = scratch.write(small.where("a <> b").distinct(), f"{name}-{k}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(f"{name}-large-{k}", f"{name}-least-{k}", f"{name}-least-large-{k}", before)
        before, n = f"{name}-{k}", now[0]
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _linked(shared: object, a: object, b: object, percent: int) -> object:
    return 100 * shared >= percent * (a + b - shared)


def _brought(pairs: DataFrame, values: DataFrame, near) -> DataFrame:
    """pairs (a, b) with both nodes' columns, as ..._a and ..._b: b's move to a, once a pair; a's once."""
    one = values.select(*(F.col(c).alias(f"{c}_a") for c in values.columns)).join(near(pairs.select(F.col("a").alias("node_a")).distinct()), "node_a", "left_semi")
    two = values.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in values.columns)).join(near(pairs), "b")
    return two.join(one, F.col("a") == F.col("node_a"))


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings, w: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b), those with enough signature matches whose full sets are similar.

    Signatures, which are short, are compared first; sets move for the pairs that they leave. Of few pairs, 16 bytes
    each, the rows that they need are picked where they lie.
    """
    near = F.broadcast if pairs.count() <= s.few_ids else lambda x: x
    marks = sets.select("node", "signature", F.size("shingles").alias("n"))
    close = 100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b")
    alike = F.size(F.filter(F.arrays_zip("signature_a", "signature_b"), lambda x: x["signature_a"] == x["signature_b"])) >= s.matches
    left = w.write(_brought(pairs, marks, near).where(F.when(close, alike).otherwise(False)).select("a", "b"), f"alike-{name}")
    shared, n, m = F.size(F.array_intersect("shingles_a", "shingles_b")), F.size("shingles_a"), F.size("shingles_b")
    return _brought(left, sets.select("node", "shingles"), near).where(_linked(shared, n, m, s.percent)).select("a", "b")


def _cross_links(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links between rows of left and right, (node, component, shingles), of different components; one for each left row and component of right."""
    left, right = (t.rename_columns([c.rsplit("_", 1)[0] for c in t.column_names]) for t in (left, right))
    shingles, size = _flat(right.column("shingles"))
    order = np.argsort(shingles, kind="stable")
    keys, owner = shingles[order], np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
    comp, node = right.column("component").to_numpy(), right.column("node").to_numpy()
    mine, sizes = _flat(left.column("shingles"))
    a, b, end = [], [], 0
    for u, c, n in zip(left.column("node").to_pylist(), left.column("component").to_pylist(), sizes.tolist()):
        x, end = mine[end : end + n], end + n
        first = np.searchsorted(keys, x, "left")
        times = np.searchsorted(keys, x, "right") - first
        # each shingle of right is hit once at most
        hits = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        shared = np.bincount(owner[hits], minlength=len(size))
        found = np.flatnonzero(_linked(shared, n, size, percent) & (comp != c) & (shared > 0))
        for k in {comp[k]: k for k in found}.values():
            a.append(u)
            b.append(int(node[k]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and each list's length."""
    whole = lists.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), np.asarray(whole.value_lengths(), np.int64)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (doc_id = component_id)."""
    return _rows(docs, id_col, text_col, s, Scratch(docs.sparkSession, "near-dedup")).drop("text_key")


def _rows(docs: DataFrame, id_col: str, text_col: str, s: Settings, w: Scratch) -> DataFrame:
    """link() with text_key."""

    def held(df: DataFrame, name: str) -> DataFrame:
        """A table, broadcast where it has few rows."""
        df = w.write(df, name)
        return F.broadcast(df) if df.count() <= s.few_rows else df

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = w.write(signatures(base, s), "signed")
    classes = w.write(signed.where("set_key is not null and doc_id is not null").groupBy(F.col("set_key").alias("key")).agg(F.min("doc_id").alias("node")), "classes")
    nodes = signed.join(classes, (F.col("set_key") == F.col("key")) & (F.col("doc_id") == F.col("node"))).select("node", "signature")
    nodes = w.write(nodes, "nodes")
    sized = w.write(signed.drop("signature"), "sized")
    w.drop("signed")

    # keys that one node alone has are told by their absence
    posted = postings(nodes, s)
    lists = w.write(posted.groupBy(F.col("pair").alias("of")).agg(F.count("*").alias("n")).where("n > 1"), "posted")
    # what grows with the documents is never broadcast, so the plan is the same at every size
    shared = posted.join(lists.hint("merge"), F.col("pair") == F.col("of"))
    ranked = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("by")).where(F.size("by") >= s.shared_keys)
    prefix = ranked.select("node", F.explode(F.slice("by", F.lit(1), F.size("by") - (s.shared_keys - 1))).alias("p")).select("node", F.col("p.pair").alias("pair"))
    prefix = w.write(prefix, "prefix-all")
    # of lists with the same members one is enough
    members = prefix.groupBy("pair").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("all"))
    once = w.write(members.where("all > 1").groupBy("x", "y", "all").agg(F.min("pair").alias("only")).select("only", "all"), "once")
    prefix = w.write(prefix.join(once.hint("merge"), F.col("pair") == F.col("only")).select("node", "pair", "all"), "prefix")

    # signatures and full sets of the nodes that still have a list in common with another
    left = w.write(prefix.select("node").distinct(), "left")
    few = left.count() <= s.few_ids  # of so many ids, 8 bytes each
    mine = base.join(F.broadcast(left) if few else left, F.col("doc_id") == F.col("node")).select("doc_id", "text")
    sets = w.write(shingle_sets(mine.where(F.trim(F.translate("text", SPACE_CHARS, " ")) != ""), s), "sets")
    if sets.count() > left.count():  # repeated rows, or rows with one id and different texts: all are tried, equal ones once
        sets = w.write(sets.dropDuplicates(["node", "shingles"]), "sets-once")
    w.drop("nodes", "posted", "prefix-all", "once")

    comp = None
    links = None
    for k in range(2):
        at = prefix if comp is None else prefix.join(comp, "node", "left")
        at = at.withColumn("component", F.col("node") if comp is None else F.coalesce("component", "node"))
        order = F.col("node") if k == 0 else F.xxhash64("node", "pair", F.lit(s.seed))
        leaders = at.groupBy(F.col("pair").alias("of")).agg(F.min_by(F.struct("node", "component"), F.struct(order, F.col("node"))).alias("lead"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("of", "lead")
        leaders = held(leaders, f"leaders-{k}")
        pairs = at.join(leaders, F.col("pair") == F.col("of")).where(F.col("component") != F.col("lead.component"))
        pairs = pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).groupBy("a", "b").agg(F.count("*").alias("collisions")).select("a", "b")
        if k:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = tried = w.write(pairs, f"pairs-{k}")
        found = w.write(_confirmed(pairs, sets, s, w, str(k)), f"links-{k}")
        links = found if links is None else links.unionByName(found)
        comp = w.write(components(links, w, f"stars-{k}", s.few_rows), f"components-{k}")

    # lists that still hold several components: members outside the largest one against all, in blocks
    sizes = sets.groupBy("node").agg(F.max(F.size("shingles")).cast("long").alias("size"))
    # the first round has compared both members of a list of two
    at = prefix.where("all > 2").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sizes, "node")
    at = w.write(at.select("pair", "node", "component", "size"), "lists")
    mixed = at.groupBy("pair").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("node").alias("lead")).where("c0 <> c1")
    mixed = held(mixed.select(F.col("pair").alias("of"), "lead"), "leads")
    at = w.write(at.join(mixed, F.col("pair") == F.col("of")).select("pair", "node", "component", "size", "lead"), "mixed")
    # lists that share members overlap in most of them: those that hang together may be compared as one list
    heap = components(at.select(F.col("node").alias("a"), F.col("lead").alias("b")), w, "heaps", s.few_rows).select(F.col("node").alias("in"), F.col("component").alias("heap"))
    at = w.write(at.join(heap, F.col("node") == F.col("in")).select("pair", "node", "component", "size", "heap"), "in-heaps")
    # as one, each member moves once for each block of outsiders, and each outsider once a block; else once a list
    parts = at.groupBy("heap", "node", "component").agg(F.max("size").alias("size"), F.sum("size").alias("apart")).groupBy("heap", "component").agg(F.sum("size").alias("words"), F.sum("apart").alias("apart"))
    whole = parts.groupBy(F.col("heap").alias("one")).agg(F.sum("words").alias("words"), (F.sum("words") - F.max("words")).alias("out"), F.sum("apart").alias("apart"))
    together = F.col("words") * F.ceil(F.col("out") / s.outsiders) + F.col("out") * F.ceil(F.col("words") / s.members)
    small = held(whole.where(together <= F.col("apart") + F.col("words")).select("one"), "small-heaps")
    at = at.join(small, F.col("heap") == F.col("one"), "left")
    # should a heap's number equal a list's, both are compared with each other in vain, but nothing is lost
    at = w.write(at.select(F.when(F.col("one").isNotNull(), F.xxhash64(F.lit("heap"), "heap")).otherwise(F.col("pair")).alias("pair"), "node", "component", "size"), "dealt")
    at = w.write(at.distinct(), "heaped")
    by = at.groupBy("pair", "component").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    open_lists = by.groupBy(F.col("pair").alias("of")).agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("words").alias("words"), F.max(F.struct("n", "component", "words"))["words"].alias("held"))
    open_lists = held(open_lists, "open-lists")
    blocks = lambda words, most: F.ceil(words / most).cast("int")
    at = w.write(at.join(open_lists, F.col("pair") == F.col("of")).select("pair", "node", "component", (F.col("component") != F.col("largest")).alias("outside"), blocks(F.col("words"), s.members).alias("cols"), blocks(F.col("words") - F.col("held"), s.outsiders).alias("rows")), "open")
    within = lambda n: F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    col = at.select("pair", "node", "component", within(F.col("cols")).alias("col"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    row = at.where("outside").select("pair", "node", "component", within(F.col("rows")).alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    full = sets.select("node", "shingles")
    # new names, so that the two sides' columns are told apart
    side = lambda x, end: x.join(full, "node").select(*(F.col(c).alias(c + end) for c in ("pair", "row", "col", "node", "component", "shingles"))).groupBy(*(c + end for c in ("pair", "row", "col")))
    percent = s.percent
    last = side(row, "_1").cogroup(side(col, "_2")).applyInArrow(lambda x, y: _cross_links(x, y, percent), "a long, b long")
    links = links.unionByName(w.write(last.distinct(), "links-last"))
    comp = w.write(components(links, w, "stars-last", s.few_rows), "components-last")

    out = sized.join(classes, F.col("set_key") == F.col("key"), "left").join(comp.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """docs without the rows that a smaller id represents, and with one of those that have equal id and text; columns as they were."""
    w = Scratch(docs.sparkSession, "keep-first")
    found = _rows(docs, id_col, text_col, s, Scratch(docs.sparkSession, "near-dedup")).where("doc_id is not null")
    names = [fresh(docs, x) for x in ("near_dedup_id", "near_dedup_key")]
    marks = w.write(found.groupBy("doc_id", "text_key").agg(F.every("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1").select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]), "kept"), "marks")
    same = (F.col(id_col).cast("long") == F.col(names[0])) & (text_key(text_col) == F.col(names[1]))
    n_twice, n_all = marks.agg(F.count_if("kept"), F.count("*")).first()
    # so many marks, 16 bytes each, go to where the texts lie; more of them move the texts once
    near = F.broadcast if n_all <= s.few_ids else lambda x: x
    rest = docs.join(near(marks.where("not kept").select(*names)), same, "left_anti")
    twice = near(marks.where("kept").select(*names))
    if not n_twice:
        return rest.select(*docs.columns)
    key = fresh(docs, "near_dedup_text")
    one = rest.join(twice, same, "left_semi").withColumn(key, text_key(text_col)).dropDuplicates([id_col, key])
    return rest.join(twice, same, "left_anti").unionByName(one.drop(key)).select(*docs.columns)
