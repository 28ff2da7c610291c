"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Spaces become the marker U+2581, and a text that isn't empty gets one marker in front. The best segmentation has the
highest sum of piece scores; of equal ones, at each position the earlier start (the longer last piece) wins. A character that
no piece of its own covers is one unknown unit, scored 10 below the worst piece and written as byte pieces. A marker
that the text itself holds goes the same way, so decoding gives every text back.

Models that were made by merging hold ranks instead of log scores (whole numbers, none twice). Their ranks become log
probabilities of a Zipf-Mandelbrot law, so a piece costs something beyond its rank and few frequent pieces win over
many; pieces, ids and their order stay.

Cases: null and empty texts have no ids; decoding no ids gives an empty text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Fixed value: what an unknown character costs beside the worst piece.
UNKNOWN = 10.0
#: Scores at or below this mark pieces that are never the best choice, and don't count as the worst piece.
NEVER = -1e8


@dataclass
class Vocabulary:
    """Pieces by id; scores; the ids of the 256 byte pieces; base, check and id of the double-array trie over UTF-8 bytes."""

    surface: list[bytes]
    scores: np.ndarray
    byte_ids: list[int]
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    unknown: float
    neighbours: frozenset[str]


def double_array(keys: list[tuple[bytes, int]], tries: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, id: from state s, byte c leads to t = base[s] + c + 1 if check[t] == s; id[t] >= 0 if a key ends there.

    A state's children go to the first place where all fit, of so many free cells; else behind the last cell in use.
    """
    keys = sorted(keys)
    base, check, ident = [0] * 512, [-1] * 512, [-1] * 512
    check[0], last = 0, 0
    holes: list[int] = []  # free cells below last, newest at the end; cells taken since are skipped
    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if len(keys[lo][0]) == depth:
            ident[state] = keys[lo][1]
            while lo < hi and len(keys[lo][0]) == depth:
                lo += 1
        children: list[tuple[int, int, int]] = []
        while lo < hi:
            c, first = keys[lo][0][depth], lo
            while lo < hi and keys[lo][0][depth] == c:
                lo += 1
            children.append((c, first, lo))
        if not children:
            continue
        low = children[0][0] + 1
        at = max(0, last + 1 - low)
        while holes and check[holes[-1]] != -1:
            holes.pop()
        for cell in holes[: -tries - 1 : -1]:
            if check[cell] == -1 and cell >= low and all(cell - low + c + 1 >= len(check) or check[cell - low + c + 1] == -1 for c, _, _ in children):
                at = cell - low
                break
        grow = at + 258 - len(check)
        if grow > 0:
            base += [0] * (grow + 4096)
            check += [-1] * (grow + 4096)
            ident += [-1] * (grow + 4096)
        base[state] = at
        for c, x, y in children:
            cell = at + c + 1
            check[cell] = state
            if cell > last:
                holes += range(last + 1, cell)
                last = cell
            todo.append((cell, x, y, depth + 1))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(ident, np.int32)


def vocabulary(pieces: list[tuple[str, float]], byte_ids: list[int], special: set[int]) -> Vocabulary:
    """pieces: (piece, log score) by id. special: ids that never match text (unknown, control and byte pieces)."""
    usable = [(p, k) for k, (p, _) in enumerate(pieces) if k not in special and p]
    scores = np.array([s for _, s in pieces], np.float64)
    least = min((s for k, (_, s) in enumerate(pieces) if k not in special and s > NEVER), default=0.0)
    surface = [p.replace(MARK, " ").encode() for p, _ in pieces]
    for value, k in enumerate(byte_ids):
        surface[k] = bytes([value])
    for k in special - set(byte_ids):
        surface[k] = b""
    base, check, ident = double_array([(p.encode(), k) for p, k in usable])
    pairs = frozenset(p[i : i + 2] for p, _ in usable for i in range(len(p) - 1))
    return Vocabulary(surface, scores, byte_ids, base, check, ident, least - UNKNOWN, pairs)


def log_probabilities(scores: list[float], usable: list[int], shift: float = 2.7) -> list[float]:
    """scores, with the usable ones, if they are ranks, as normalised logarithms of 1 / (rank + shift)."""
    ranks = [-scores[k] for k in usable if scores[k] > NEVER]
    if len(set(ranks)) < len(ranks) or not all(r == int(r) >= 0 for r in ranks):
        return scores
    whole = math.log(sum(1 / (r + shift) for r in ranks) or 1.0)
    out = list(scores)
    for k in usable:
        if scores[k] > NEVER:
            out[k] = -math.log(shift - scores[k]) - whole
    return out


def load(model_file: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file; only these are used, not the library's own segmentation."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(k), sp.get_score(k)) for k in range(n)]
    by_byte = {int(p[3:5], 16): k for k, (p, _) in enumerate(pieces) if sp.is_byte(k)}
    special = {k for k in range(n) if sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)}
    scores = log_probabilities([x for _, x in pieces], [k for k in range(n) if k not in special])
    return vocabulary([(p, x) for (p, _), x in zip(pieces, scores)], [by_byte[v] for v in range(256)], special)


class Codec:
    """Encodes and decodes; keeps the ids of a bounded number of runs of text.

    A text may be cut between two characters that stand side by side in no piece, since no piece spans them: first
    before each marker that follows another character and around line ends, where that holds for the vocabulary.
    """

    KEPT = 400_000

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        self.base, self.check, self.piece, self.scores = v.base.tolist(), v.check.tolist(), v.piece.tolist(), v.scores.tolist()
        whole = any(p[1] == MARK and p[0] != MARK or "\n" in p for p in v.neighbours)
        self.cut = re.compile(r"[\s\S]+" if whole else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.as_bytes = [np.array([v.byte_ids[c]], "<i4").tobytes() for c in range(256)]

    def viterbi(self, run: str) -> list[int]:
        data = run.encode()
        n = len(data)
        base, check, piece, scores = self.base, self.check, self.piece, self.scores
        limit, unknown = len(check), self.v.unknown
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here = best[i]
            single = False
            state, j = 0, i
            while j < n:
                t = base[state] + data[j] + 1
                if t >= limit or check[t] != state:
                    break
                state = t
                j += 1
                k = piece[t]
                if k >= 0:
                    s = here + scores[k]
                    b = best[j]
                    if b is None or s > b:
                        best[j], back[j] = s, (i, k)
                    if j - i == width:
                        single = True
            if not single:
                s, j = here + unknown, i + width
                b = best[j]
                if b is None or s > b:
                    best[j], back[j] = s, (i, -1)
            i += width
        out: list[int] = []
        j = n
        byte_ids = self.v.byte_ids
        while j:
            i, k = back[j]
            out += [k] if k >= 0 else [byte_ids[c] for c in reversed(data[i:j])]
            j = i
        return out[::-1]

    def learn(self, run: str) -> bytes:
        """The ids of a run that isn't known yet, from its parts between characters that no piece joins."""
        pairs, known, parts, lo = self.v.neighbours, self.known, [], 0
        for k in range(1, len(run)):
            if run[k - 1 : k + 1] not in pairs:
                parts.append(run[lo:k])
                lo = k
        if not parts:
            found = np.array(self.viterbi(run), "<i4").tobytes()
        else:
            parts.append(run[lo:])
            found = b"".join([known.get(p) or self.learn(p) for p in parts])
        if len(run) <= 64:
            known[run] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self.known) > self.KEPT:
            self.known.clear()
        known, learn = self.known, self.learn
        if MARK not in text:
            return b"".join([known.get(r) or learn(r) for r in self.cut.findall(MARK + text.replace(" ", MARK))])
        literal = b"".join(self.as_bytes[c] for c in MARK.encode())
        first, *rest = text.split(MARK)
        return literal.join([self.encode_part(MARK + first), *map(self.encode_part, rest)])

    def encode_part(self, text: str) -> bytes:
        return b"".join([self.known.get(r) or self.learn(r) for r in self.cut.findall(text.replace(" ", MARK))])

    def decode(self, ids) -> str:
        surface = self.v.surface
        return b"".join([surface[k] for k in ids])[1:].decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids; with check also round_trip, whether decoding its ids gives the text back.

    The vocabulary, which doesn't grow with the documents, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{id(shared)}-{len(v.surface)}"
    names = ["doc_id", "n_tokens", "ids", *["round_trip"] * check]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                texts = [t or "" for t in b.column(1).to_pylist()]
                got = [np.frombuffer(codec.encode(t), "<i4") for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(got)))
                more = [pa.array([codec.decode(x.tolist()) == t for x, t in zip(got, texts)])] if check else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), ids, *more], names=names)

    kind = "doc_id long, n_tokens long, ids array<int>" + ", round_trip boolean" * check
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def decode(tokens: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(v)
    key = f"{tokens.sparkSession.sparkContext.applicationId}-{id(shared)}-{len(v.surface)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
