"""SimHash fingerprints and near-duplicate groups.

Fingerprints are embedded as bit counts of 32 two-bit segments. The Manhattan distance of two
count vectors never exceeds the Hamming distance of the fingerprints, so links within three
bits lie within distance three; of two halves of the vector one is then within distance one.
That gives an exact range join on a grid: every fingerprint is at home in one cell of each
half and also visits the cells one count above; the join on cells meets every link. Candidates
are verified by Hamming distance in tasks that hold one block pair of one cell, and a task
keeps a spanning forest of its links, never all pairs."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .graph import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Rows of a cell that one task compares; larger cells are dealt out as pairs of blocks.
BLOCK = 2048
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of lower-cased three-word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else list(map(b" ".join, zip(words, words[1:], words[2:])))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _CHUNK):
        part = shingles[i:i + _CHUNK]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp) for every row: the text's hash, and the 64 bits as a signed number."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "h", "fp"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(
        run, "doc_id long, h long, fp long")


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp, home): two home cells and the cells one count above in one segment."""
    half = F.array(*[F.struct(
        F.lit(k).cast("long").alias("k"), F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")) for k in (0, 1)])
    # two bits hold a count of 0 to 2: the bits less their upper one
    by_half = fps.select("fp", F.inline(half)).select(
        "fp", "k", (F.col("b") - F.shiftright("b", 1).bitwiseAND(F.lit(0x55555555))).alias("c"))
    at = [F.when(F.shiftright("c", 2 * s).bitwiseAND(F.lit(3)) < 2, F.col("c") + F.lit(1 << (2 * s))) for s in range(16)]
    cells = F.concat(
        F.array(F.struct(F.col("c").alias("cell"), F.lit(True).alias("home"))),
        F.transform(F.array_compact(F.array(*at)), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))
    return by_half.select("fp", "k", F.inline(cells)).select(
        F.shiftleft("k", 40).bitwiseOR(F.col("cell")).alias("cell"), "fp", "home")


def _forest(fp: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between a home fingerprint and any other of one cell."""
    label, out = np.arange(len(fp)), []
    for i in np.flatnonzero(home):
        near = np.bitwise_count(fp ^ fp[i]) <= BITS
        own = label[i]
        other = np.unique(label[near])
        other = other[other != own]
        if len(other):
            first = {int(x): j for j, x in reversed(list(enumerate(label))) if near[j]} if len(fp) < 64 else None
            for x in other:
                j = first[int(x)] if first else int(np.flatnonzero(near & (label == x))[0])
                out.append((i, j))
            label[np.isin(label, other)] = own
    return out


def _linked(batches):
    """Links of lists of (fp, home), one list per block pair of a cell."""
    for b in batches:
        lists = b.column(0)
        ends = lists.offsets.to_numpy()
        rows = lists.values
        fp = rows.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        home = rows.field("home").to_numpy(zero_copy_only=False).astype(bool)
        size = np.diff(ends)
        us, vs = [], []
        for n in np.unique(size):
            at = ends[:-1][size == n]
            if n < 2:
                continue
            if n <= 12:
                for i in range(n):
                    for j in range(i + 1, n):
                        a, c = fp[at + i], fp[at + j]
                        ok = (home[at + i] | home[at + j]) & (np.bitwise_count(a ^ c) <= BITS) & (a != c)
                        us.append(a[ok])
                        vs.append(c[ok])
                continue
            for s in at:
                own = fp[s:s + n]
                for i, j in _forest(own, home[s:s + n]):
                    us.append(own[i:i + 1])
                    vs.append(own[j:j + 1])
        u = np.concatenate(us or [np.empty(0, np.uint64)]).view(np.int64)
        v = np.concatenate(vs or [np.empty(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """(u, v) that connect distinct fingerprints `fps` (fp) exactly as all pairs within three
    bits would."""
    cells = _cells(fps)
    live = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any").select(
        "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # no broadcast: Catalyst sizes the cells as it does the fingerprints, of which they are some 26 times as many rows
    rows = cells.hint("merge").join(live, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    pairs = rows.select("cell", "fp", "home", "own", other)
    lists = pairs.groupBy("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).agg(
        F.collect_list(F.struct("fp", "home")).alias("rows"))
    return lists.where(F.size("rows") > 1).select("rows").mapInArrow(_linked, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp, component_id) for every row of `docs`: documents whose fingerprints differ
    in at most three bits are linked, component_id is the smallest doc_id reachable. Null and
    empty texts have fingerprint zero and link like any other; repeated rows stay. A component
    in which no row has a doc_id gets null. An empty table gives no rows."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = components(links(first.select("fp")))
    rooted = first.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "h", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, in all their columns, that stay when one row of each group does: the one
    with the smallest doc_id, of several such rows the one with the smallest text hash. Rows
    without a doc_id can't be told apart and stay."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name of the input clashes
    text, number = (F.col(f"c{names.index(c)}") for c in (text_col, id_col))
    groups = near_duplicates(docs, id_col, text_col).where("doc_id is not null")
    first = stored(groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "h")).alias("r")).select(
        F.col("r.doc_id").alias("_i"), F.col("r.h").alias("_j")), "representatives")
    keyed = own.withColumns({"_id": number.cast("long"), "_h": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))})
    kept = keyed.join(first, F.expr("_id = _i and _h = _j"), "left_semi")
    equal = groups.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if equal.limit(1).count():
        kept = kept.dropDuplicates(["_id", "_h"])
    return kept.unionByName(keyed.where("_id is null")).select(*own.columns).toDF(*names)


def unsigned_hex(c):
    """A signed 64-bit number as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
