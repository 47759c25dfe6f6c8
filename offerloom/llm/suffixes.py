"""Removal of repeated passages by induced suffix sorting, byte by byte and exactly.

Every 200-byte string holds the anchor of its windows: the 64-byte gram whose hash is the least
among the string's grams. Two equal strings hold the same anchor at the same place, so only texts
around anchors that occur again can repeat, and whatever repeats meets at one anchor. An
occurrence whose whole context (all 200-byte strings that hold the anchor) occurs again is
settled by counting. The contexts that differ are dealt out by anchor; Spark's external sort is
the queue on disk from which a task takes them, anchor by anchor, in blocks of bounded size.

In a block the suffixes of all contexts are sorted by induction. Contexts are aligned at their
anchors; the order of the suffixes that start in one column follows from the order in the
column to its right by one stable distribution on the bytes, and the common prefix of two
neighbours is one more than the least common prefix between them in the column to the right, or
nothing. Suffix tuples (byte, rank to the right) and common-prefix values go from column to
column; a string repeats where a suffix shares 200 bytes with a neighbour. Context lengths are
bounded, so the induction needs no recursion into renamed texts, and memory is bounded by the
block, not by the shard. Anchors with more contexts than a block are settled by counting their
strings, which no single task has to hold."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

LENGTH, GRAM = 200, 64
#: Bytes before and after an anchor's start that strings holding it reach.
LEFT, RIGHT = LENGTH - GRAM, LENGTH
_WIDTH = LEFT + RIGHT
#: Contexts of a block, and of one anchor at most.
BLOCK, LARGE = 8_192, 65_536
#: Slots of the set that tells which documents may take part in a join.
SLOTS = 1 << 20
_PART = 1 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _over_windows(v: np.ndarray, width: int, take) -> np.ndarray:
    """Minimum or maximum of every run of `width` values."""
    k = 1
    while 2 * k <= width:
        v = take(v[:-k], v[k:])
        k *= 2
    return take(v[:len(v) - (width - k)], v[width - k:]) if width > k else v


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some 200-byte string."""
    span = LENGTH - GRAM + 1
    places, hashes = [], []
    for at in range(0, len(data) - LENGTH + 1, _PART):
        a = np.frombuffer(data, np.uint8, min(_PART + LENGTH - 1, len(data) - at), at).astype(np.uint64)
        h, k, m = (a + np.uint64(1)) * _MIX[0], 1, _MIX[1]
        with np.errstate(over="ignore"):
            while k < GRAM:
                h = h[:-k] * m + h[k:]
                h ^= h >> np.uint64(29)
                m, k = m * m, 2 * k
            h = h * _MIX[2]
        h ^= h >> np.uint64(32)
        least = _over_windows(h, span, np.minimum)
        edge = np.zeros(span - 1, np.uint64)
        found = np.flatnonzero(h == _over_windows(np.concatenate([edge, least, edge]), span, np.maximum))
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first].view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.to_binary(text, F.lit("utf-8")).alias("data"))


def _marked(rows: DataFrame) -> DataFrame:
    """(doc_id, h, marks): anchors of every row with the hash of their contexts."""
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("at", pa.int32())]))

    def run(batches):
        for b in batches:
            sizes, all_p, all_h, all_c = [0], [], [], []
            for d in b.column(2):
                data = d.as_py()
                p, h = anchors(data)
                all_p.append(p)
                all_h.append(h)
                c = [xxhash.xxh64_intdigest(data[max(0, x - LEFT):x + RIGHT], min(x, LEFT)) for x in p.tolist()]
                all_c.append(np.array(c, np.uint64).view(np.int64))
                sizes.append(len(p))
            fields = [np.concatenate(v) if v else np.empty(0, np.int64) for v in (all_h, all_c, all_p)]
            flat = pa.StructArray.from_arrays([pa.array(fields[0], pa.int64()), pa.array(fields[1], pa.int64()), pa.array(fields[2].astype(np.int32))], fields=list(kind.value_type))
            marks = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), marks.cast(kind)], ["doc_id", "h", "marks"])
    return rows.mapInArrow(run, "doc_id long, h long, marks array<struct<anchor:bigint,context:bigint,at:int>>")


def _cut(data: bytes, at: int) -> tuple[int, bytes]:
    return min(at, LEFT), data[max(0, at - LEFT):at + RIGHT]


def _contexts(batches):
    """Contexts of the wanted anchors of every text."""
    for b in batches:
        anchor, row, at, sole, left, context, large = [], [], [], [], [], [], []
        for data, r, want in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            data = data.as_py()
            for w in want:
                n, c = _cut(data, w["at"])
                anchor.append(w["anchor"])
                row.append(r)
                at.append(w["at"])
                sole.append(w["sole"])
                large.append(w["large"])
                left.append(n)
                context.append(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(sole, pa.bool_()), pa.array(large, pa.bool_()),
             pa.array(left, pa.int32()), pa.array(context, pa.binary())], ["anchor", "row", "at", "sole", "large", "left", "context"])


_CONTEXT = "anchor long, row long, at int, sole boolean, large boolean, left int, context binary"


def repeated(contexts: list[bytes], left: np.ndarray) -> np.ndarray:
    """Where, in contexts aligned at their anchors, a 200-byte string begins that another of them
    has in the same column: a boolean per context and column."""
    n = len(contexts)
    size = np.array([len(c) for c in contexts])
    first, last = LEFT - left, LEFT - left + size
    m = np.zeros((n, _WIDTH), np.uint8)
    columns = np.arange(_WIDTH)
    inside = (columns >= first[:, None]) & (columns < last[:, None])
    m[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    m, inside = np.ascontiguousarray(m.T), np.ascontiguousarray(inside.T)
    order, common = np.arange(n), np.zeros(n, np.uint8)
    out = np.zeros((_WIDTH, n), bool)
    for j in range(_WIDTH - 1, -1, -1):
        here = m[j][order]
        step = np.argsort(here, kind="stable")
        # least common prefix between neighbours' old ranks, from minima over powers of two
        table, k = [common], 1
        while 2 * k <= n:
            table.append(np.minimum(table[-1][:-k], table[-1][k:]))
            k *= 2
        a, b = step[:-1] + 1, step[1:]
        same = (here[step[1:]] == here[step[:-1]])
        a, b = a[same], b[same]
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        least = np.empty(len(a), np.uint8)
        for v in np.unique(level):
            s = level == v
            least[s] = np.minimum(table[v][a[s]], table[v][b[s] - (1 << int(v)) + 1])
        order = order[step]
        common = np.zeros(n, np.uint8)
        common[1:][same] = np.minimum(least, LENGTH - 1) + 1
        ok = inside[j][order]
        common[1:][~(ok[1:] & ok[:-1])] = 0
        whole = common >= LENGTH
        hit = whole.copy()
        hit[:-1] |= whole[1:]
        out[j][order] = hit
    return out.T


def _block_spans(rows) -> tuple[list, list, list]:
    """Covered runs of a block of (row, at, sole, left, context), in the places of their texts."""
    hits = repeated([r[4] for r in rows], np.array([r[3] for r in rows]))
    out = [], [], []
    for (row, at, sole, _, _), hit in zip(rows, hits):
        starts = np.flatnonzero(hit)
        if sole and len(starts):
            gap = np.flatnonzero(np.diff(starts) > LENGTH)
            begin, end = starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + LENGTH
            for s, e in zip(begin.tolist(), end.tolist()):
                out[0].append(row)
                out[1].append(at - LEFT + s)
                out[2].append(at - LEFT + e)
    return out


_RUN = "row long, start int, end int"


def _spans_batch(out):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["row", "start", "end"])


def _sorted_spans(batches):
    """Contexts come in the order of anchors. A block holds whole anchors."""
    block, own, last = [], [], None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("anchor", "row", "at", "sole", "left", "context")]
        for anchor, *rest in zip(*cols):
            if anchor != last:
                if len(own) > 1:
                    block += own
                own, last = [], anchor
                if len(block) >= BLOCK:
                    yield _spans_batch(_block_spans(block))
                    block = []
            own.append(rest)
    block += own if len(own) > 1 else []
    if block:
        yield _spans_batch(_block_spans(block))


def _strings(batches):
    """Hashes of all 200-byte strings of contexts, with their places."""
    for b in batches:
        key, row, start, sole = [], [], [], []
        for r, at, s, left, c in zip(*[b.column(b.schema.get_field_index(x)).to_pylist() for x in ("row", "at", "sole", "left", "context")]):
            for i in range(len(c) - LENGTH + 1):
                key.append(xxhash.xxh128_digest(c[i:i + LENGTH]))
                row.append(r)
                start.append(at - left + i)
                sole.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(sole, pa.bool_())],
                                         ["key", "row", "start", "sole"])


def _slots(keys: DataFrame) -> DataFrame:
    """Slots of the keys' hashes: at most SLOTS rows, however many keys there are."""
    return F.broadcast(keys.select(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).distinct())


def _with_slot(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slot", F.pmod("h", F.lit(SLOTS)).cast("int"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, spans): byte ranges [start, end) of texts (h: their hash) that 200-byte strings
    cover which start elsewhere too, overlapping and unsorted; documents without any are left
    out. Rows equal in doc_id and text are documents of their own and share one result row."""
    rows = _keyed(docs, id_col, text_col)
    marked = stored(_marked(rows).withColumn("row", F.monotonically_increasing_id()), "anchors")
    names = marked.select("row", "doc_id", "h")
    marks = marked.select("row", F.inline("marks"))
    # written first: a join can split a hot anchor's rows only where both sides come from a shuffle or a table
    again = stored(marks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "again")
    occurring = stored(marks.join(again, "anchor"), "occurring")
    # by context: how often it occurs, and its first place; by anchor: how many contexts
    same = occurring.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("first"))
    kinds = same.groupBy("anchor").agg(F.count("*").alias("kinds"))
    same = stored(same.join(kinds, "anchor"), "contexts")
    settled = occurring.join(same.where("n > 1").select("anchor", "context"), ["anchor", "context"]).select(
        "row", F.greatest(F.col("at") - LEFT, F.lit(0)).alias("start"), (F.col("at") + RIGHT).alias("end"))
    want = same.where("kinds > 1").select(
        F.col("first.row").alias("row"), F.struct("anchor", F.col("first.at").alias("at"), (F.col("n") == 1).alias("sole"), (F.col("kinds") > LARGE).alias("large")).alias("w"))
    want = stored(want.groupBy("row").agg(F.collect_list("w").alias("want")).join(names, "row"), "want")
    some = _with_slot(rows).join(_slots(want), "slot", "left_semi")
    wanted = want.withColumnsRenamed({"doc_id": "i", "h": "j"})
    contexts = some.join(wanted, F.expr("doc_id <=> i and h = j")).select("data", "row", "want").mapInArrow(_contexts, _CONTEXT)
    contexts = stored(contexts, "differing")
    sorted_ = contexts.where("not large").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_spans, _RUN)
    strings = contexts.where("large").mapInArrow(_strings, "key binary, row long, start int, sole boolean")
    # a string lies in the contexts of all anchors that it holds: places count, not rows
    place = F.struct("row", "start")
    twice = strings.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min("sole").alias("sole")).where(
        "a <> b or not sole").select("key")
    counted = strings.where("sole").join(twice, "key").select("row", "start", (F.col("start") + LENGTH).alias("end"))
    spans = settled.unionByName(sorted_).unionByName(counted).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return spans.join(names, "row").groupBy("doc_id", "h").agg(F.first("spans").alias("spans"))


def _merged(spans, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], min(x["end"], n)) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _removed(batches):
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for doc, data, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            data = data.as_py()
            runs, kept, at = _merged(spans.as_py(), len(data)), [], 0
            for s, e in runs:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            for c, v in zip(cols, (doc, len(data), sum(e - s for s, e in runs), [{"start": s, "end": e} for s, e in runs], b"".join(kept))):
                c.append(v)
        runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), runs, pa.binary()))],
                                         ["doc_id", "n_bytes", "n_removed", "runs", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, runs (maximal removed byte ranges), kept (the
    remaining bytes). Null texts are empty and lose nothing; texts under 200 bytes lose nothing;
    equal texts of 200 bytes and more lose everything. An empty table gives no rows."""
    rows = _with_slot(_keyed(docs, id_col, text_col))
    found = stored(repeats(docs, id_col, text_col), "repeats")
    slots = _slots(found)
    spans = found.withColumnsRenamed({"doc_id": "i", "h": "j"})
    some = rows.join(slots, "slot", "left_semi").join(spans, F.expr("doc_id <=> i and h = j"), "left").select("doc_id", "data", "spans")
    rest = rows.join(slots, "slot", "left_anti").select("doc_id", "data", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, runs array<struct<start:int,end:int>>, kept binary"
    return some.unionByName(rest).mapInArrow(_removed, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
