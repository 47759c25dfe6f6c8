"""Best-fit packing of tokenized documents into sequences of a fixed length.

A piece has one of at most `size` lengths, so range-sorting pieces and gaps comes down to
counting them by length: the sweep that finds every piece's successor gap runs over length
classes, whose number does not grow with the data. A round takes the longest unplaced class
and its successor, the class of smallest gaps that hold it; pieces and gaps of the two classes
meet by rank, which resolves all conflicts at once; the gaps left over form new classes and the
next round follows. This is exactly best-fit decreasing, whatever the number of documents. The
documents themselves are ranked within their length and placed in one distributed pass."""
from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

SIZE, END_ID = 2048, 0
#: Words whose ids a Python worker keeps; beyond, it starts anew.
CACHE = 200_000
#: Parts in which the ranks of one length are counted.
PARTS = 1024
_WORD = 64

RUN = np.dtype([("length", "i8"), ("first", "i8"), ("count", "i8"), ("sequence", "i8"), ("offset", "i8"), ("each", "i8")])


class Ids:
    """Token ids as little-endian bytes. Text between single spaces is tokenized on its own: in
    a byte-level vocabulary a space opens the next word, so words never share a token. Texts
    with other white space next to a space are given to the tokenizer whole. The file's added tokens
    are their own ids wherever they stand in a text."""

    def __init__(self, path: str):
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda t: [t]
        self.ranked = _ranked(path)
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.ranked.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        parts = self.apart(text)
        return self._plain(text) if len(parts) == 1 else b"".join([self.added.get(p) or self._plain(p) for p in parts if p])

    def _plain(self, text: str) -> bytes:
        parts = text.split(" ")
        if not all(parts) or _mixed_space(text):
            return self._encode(text)
        known, out = self.words, []
        if len(known) > CACHE:
            known.clear()
        out.append(self._encode(parts[0]))
        for p in parts[1:]:
            ids = known.get(p)
            if ids is None:
                ids = self._encode(" " + p)
                if len(p) < _WORD:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


def _mixed_space(text: str) -> bool:
    return re.search(r"\s \s", text) is not None


def _ranked(path: str):
    """The file's vocabulary as byte ranks: merged pairs have ids in merge order, so the lowest
    id is the merge that comes first."""
    import public_tokenizers
    import tiktoken
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that the file writes as themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w != "<|endoftext|>"}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _ids(name: str) -> Ids:
    import public_tokenizers
    return Ids(public_tokenizers.path(name))


def token_pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. A document's ids are its text's and END_ID; only documents of more than
    `size` ids are cut, the first piece takes what the full ones leave."""
    def run(batches):
        ids = _ids(tokenizer)
        for b in batches:
            rows = []
            for doc, text, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = ids(text.as_py() or "") + END_ID.to_bytes(4, "little")
                n = len(data) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                rows += [(doc, h, k, s, e - s, zlib.crc32(data[4 * s:4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:] if n > size else [n]))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)],
                ["doc_id", "h", "piece", "start", "length", "ids_crc32"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, piece int, start long, length long, ids_crc32 long")


def best_fit_runs(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rounds of best fit over length classes. A run says: of the pieces of `length`, ranks
    `first` to `first + count - 1` go to sequences from `sequence` on, `each` to a sequence, the
    first of each at `offset`."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number), for gaps > 0
    order: list[int] = []
    runs, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                seq, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap = size
                seq, n = used, -(-left // (size // length))
                used += n
            each = gap // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, seq, size - gap, each))
                rank, left = rank + full * each, left - full * each
                _keep(gaps, order, gap - each * length, seq, full)
            if left and full < n:  # the last sequence of the class takes what is left of the pieces
                runs.append((length, rank, left, seq + full, size - gap, left))
                _keep(gaps, order, gap - left * length, seq + full, 1)
                full, rank, left = full + 1, rank + left, 0
            if full < n:
                _keep(gaps, order, gap, seq + full, n - full)
    return np.array(sorted(runs), RUN)


def _keep(gaps, order, gap, seq, n):
    if gap:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((seq, n))


def _placed(runs: np.ndarray):
    def run(batches):
        key = runs["length"] << 44 | runs["first"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            r, i = runs[at], rank - runs["first"][at]
            out = {f.name: b.column(k) for k, f in enumerate(b.schema) if f.name != "rank"}
            out["sequence_id"] = pa.array(r["sequence"] + i // r["each"])
            out["offset"] = pa.array(r["offset"] + i % r["each"] * length)
            yield pa.RecordBatch.from_pydict(out)
    return run


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every row.
    Null and empty texts are one id, END_ID; repeated rows are packed each; an empty table gives
    no rows. Sequences are filled from 0 without gaps."""
    pieces = stored(token_pieces(docs, size, tokenizer, id_col, text_col).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "h"), F.lit(PARTS)).cast("int")), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = best_fit_runs(counts, size)
    before = by_part.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "h")) - 1
    ranked = pieces.withColumn("inside", inside).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
