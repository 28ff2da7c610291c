"""Token-ID output: documents encoded with a public tokenizer into Parquet list columns, and read back.

Files hold, in ascending document id: doc_id, part, local_start, n_tokens and ids (list of int32). ids is dictionary
encoded; the metadata columns are delta encoded; row groups and pages are bounded, and Parquet's page indexes let a
reader fetch the metadata, or the tokens of a few documents, without the rest. `part` is the range partition, so a
file's base offset is the sum of the parts before it: one row a part, which is all that the driver gathers.

Cases: null text is empty; an empty text holds only the end id; rows with the same id are ordered by text; null ids
come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words, ids and offsets that a worker keeps, in Arrow arrays: when they are passed, the older half goes.
CACHED_BYTES = 16 << 20
#: Longer words are encoded, but not kept.
KEPT_WORD = 64
#: Texts with white space before a space aren't cut into words. (More than the tokenizer's white space does no harm.)
UNSAFE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}] "
#: Marks that may end a word: behind a letter or digit, a run of them is a pre-token of its own.
MARKS = ".,;:!?)#$%&*|"
MARKED, STEM = r"[\p{L}\p{N}][" + MARKS + "]+$", r"(?s)^.*[\p{L}\p{N}]"
#: Documents and bytes of text that are encoded at once; rows that Spark hands to a worker at once.
DOCUMENTS, BYTES, BATCH_ROWS = 2_000, 4 << 20, 2_000

_encoders: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level tokenizers write bytes: a printable byte is itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def _joined(a: pa.ListArray, b: pa.ListArray) -> pa.ListArray:
    """Each list of a followed by that of b."""
    n, both = len(a), pa.concat_arrays([a, b])
    order = np.arange(2 * n).reshape(2, n).T.ravel()
    found = both.take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[::2]), found.flatten())


class Encoder:
    """The tokenizer with a cache by word.

    A single space after a visible character always begins a new pre-token, so a text may be cut before each of
    them without any effect on the ids. Texts with other white space before a space aren't cut. Marks that end a word
    after a letter or digit are a pre-token of their own, and a word of letters with its space is one, which goes to
    the tokenizer's model directly. What is kept lies in Arrow arrays, a few bytes a word, and is looked up and put
    together without a Python object for a word; only new words are handled one by one.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.words = pa.array([], pa.string())  # without the space before them and the marks behind them
        self.ids = pa.array([], pa.list_(pa.int32()))
        self.letters = byte_letters()
        self.space = self.letters[0x20]
        probe = ["the", "Straße", "été", "данные", "日本", "x" * 40]
        self.direct = self.tokenizer.normalizer is None and [self.word(w) for w in probe] == self.raw([" " + w for w in probe]).to_pylist()

    def raw(self, texts: list[str]) -> pa.ListArray:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return self.lists([len(x.ids) for x in found], [i for x in found for i in x.ids])

    @staticmethod
    def lists(sizes: list[int], ids: list[int]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.int32()))

    def word(self, w: str) -> list[int]:
        """Ids of a word of letters, with a space before it."""
        as_letters = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(self.space + as_letters)]

    def new(self, words: list[str]) -> pa.ListArray:
        """Ids of words with a space before them."""
        if not self.direct:
            return self.raw([" " + w for w in words])
        other = [" " + w for w in words if not w.isalpha()]
        rest, sizes, ids = [], [], []
        for lo in range(0, len(other), 5_000):
            rest += [x.ids for x in self.tokenizer.encode_batch_fast(other[lo : lo + 5_000], add_special_tokens=False)]
        behind, word = iter(rest), self.word
        for w in words:
            x = word(w) if w.isalpha() else next(behind)
            sizes.append(len(x))
            ids += x
        return self.lists(sizes, ids)

    def look_up(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct words with a space before them, from the cache or new; new ones that are short are kept."""
        at = pc.index_in(words, value_set=self.words)
        lacking = words.filter(at.is_null())
        fresh = self.new(lacking.to_pylist())
        place = at.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(place), len(self.words) + np.cumsum(np.isnan(place)) - 1, place).astype(np.int64) if at.null_count else place
        found = pa.concat_arrays([self.ids, fresh]).take(pa.array(place))
        short = pc.less_equal(pc.binary_length(lacking), KEPT_WORD)
        self.words, self.ids = pa.concat_arrays([self.words, lacking.filter(short)]), pa.concat_arrays([self.ids, fresh.filter(short)])
        if self.words.nbytes + self.ids.nbytes > CACHED_BYTES:
            half = pa.array(np.arange(len(self.words) // 2, len(self.words)))
            self.words, self.ids = self.words.take(half), self.ids.take(half)
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[pa.Array, np.ndarray]:
        """All ids of the texts, each followed by end, and where each text's begin, and the last's end."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, UNSAFE)
        cuttable = pc.if_else(whole, "", texts)
        cut = pc.split_pattern(cuttable, " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary
        marked = pc.match_substring_regex(words, MARKED)
        stems = pc.if_else(marked, pc.utf8_rtrim(words, MARKS), words)
        tails = pc.if_else(marked, pc.replace_substring_regex(words, STEM, ""), "").dictionary_encode()
        stem = stems.dictionary_encode()
        ids = _joined(self.look_up(stem.dictionary).take(stem.indices), self.raw(tails.dictionary.to_pylist()).take(tails.indices))
        # what stands at a text's start has no space before it; a text that isn't cut is one piece
        firsts = pc.if_else(whole, texts, pc.list_element(cut, 0)).to_pylist()
        pieces = pa.concat_arrays([ids, self.raw(firsts), pa.array([[end]], pa.list_(pa.int32()))])
        # each text's pieces, the first one its start, with the end behind the last
        index = np.empty(len(coded) + n, np.int32)
        last = at[1:] + np.arange(n)
        inner = np.ones(len(index), bool)
        inner[last] = False
        index[inner] = coded.indices.to_numpy()
        index[at[:-1] + np.arange(n)] = len(words) + np.arange(n)
        index[last] = len(pieces) - 1
        found = pieces.take(pa.array(index))
        return found.flatten(), found.offsets.to_numpy()[np.append(at[:-1] + np.arange(n), len(index))].astype(np.int64)


def encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (doc_id, part, local_start, n_tokens, ids) in ascending id, range partitioned; the vocabulary is broadcast."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo : lo + DOCUMENTS]), BYTES, "right")))
                ids, at = enc.encode(texts.slice(lo, hi - lo), end_id)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], schema=schema)
                start += int(at[-1])
                lo = hi

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, row_group_bytes: int = 8 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000, **kw: object) -> None:
    """Writes encode_documents() as Parquet: dictionary ids, delta metadata, bounded row groups, pages with indexes."""
    options = {
        "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd",
    }
    conf, rows = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(rows)
    conf.set(rows, str(min(int(was), BATCH_ROWS) if int(was) > 0 else BATCH_ROWS))
    try:
        encode_documents(docs, tokenizer_file, **kw).write.options(**options).mode("overwrite").parquet(path)
    finally:
        conf.set(rows, was)


def read_token_files(spark, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids): start counts the ids of all documents before, over all files.

    The offsets of the parts are summed on the driver: as many rows as the files have range partitions.
    """
    stored = spark.read.schema("doc_id long, part int, local_start long, n_tokens long, ids array<int>").parquet(path)
    base, rows = 0, []
    for part, n in sorted((r.part, r.n) for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        rows.append((part, base))
        base += n
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    return stored.join(offsets, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """ids_crc32 of the ids as little-endian unsigned 32-bit integers, in place of ids."""
    keep = [c for c in tokens.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    return tokens.mapInArrow(run, ", ".join(f"{c} long" for c in keep) + ", ids_crc32 long")
