"""Repair of the structure of conversations.

A row becomes a symbol: its role's initial and its first fault. Conversations are strings of these
symbols; the cheapest edits into the role pattern (s?(ua)+)? are found on the grammar of all strings
of a batch (`grammar`), so equal stretches of different conversations are solved once.

Rows of one conversation are sorted by range, so a conversation of any length is spread over tasks
and only its symbols, one byte a row as in the audit it gets, meet in one place; equal rows are
counted before they are shuffled; a row's earlier twin is found by an aggregation, not in its
conversation. Texts are edited in a stream over sorted rows that starts with the audit."""
from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored
from .grammar import EMPTY, Rope, cheapest, product

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CLASSES = "sua"  # and any other initial
OK, CUT, BLANK, DUPLICATE = range(4)
SYMBOLS = "abcdefghijklmnop"  # 4 * class + fault
_SPACE = " \t\n\x0b\x0c\r"
#: State (nothing yet, after s, after u, after a) to which a role's initial leads.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_NEXT = {0: ("user", 2), 1: ("user", 2), 3: ("user", 2), 2: ("assistant", 3)}


def _matrices():
    none = [[None] * 4 for _ in range(4)]
    gaps = [[(0, EMPTY) if i == j else None for j in range(4)] for i in range(4)]
    one = [list(r) for r in none]
    for i, (_, j) in _NEXT.items():
        one[i][j] = (INSERT, Rope("I"))
    reach = gaps
    for _ in range(3):  # more insertions than states never pay
        reach = product(reach, one)
        gaps = [[min((e for e in (g, r) if e), key=lambda e: e[0], default=None) for g, r in zip(a, b)] for a, b in zip(gaps, reach)]
    out = []
    for initial in (*CLASSES, ""):
        for fault in range(4):
            m = [list(r) for r in none]
            extra = TRUNCATED if fault == CUT else 0
            for i in range(4):
                m[i][i] = (DELETE, Rope("D"))
                if fault < BLANK:
                    m[i][_NEXT[i][1]] = (REROLE + extra, Rope("R"))
                    if (i, initial) in _STEP:
                        m[i][_STEP[i, initial]] = (KEEP + extra, Rope("K"))
            out.append(product(gaps, m))
    # a sequence may end with nothing or after an a
    finish = [min((g for g in (gaps[i][0], gaps[i][3]) if g), key=lambda e: e[0]) for i in range(4)]
    return out, finish


TERMINALS, FINISH = _matrices()
START = [(0, EMPTY), None, None, None]


def audits(sequences: list[str]) -> dict[str, tuple[int, str]]:
    """(cost, audit) of every different string of symbols."""
    todo = sorted(set(sequences))
    return dict(zip(todo, cheapest([[SYMBOLS.index(c) for c in s] for s in todo], TERMINALS, START, FINISH)))


def illegal(symbols: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    kinds = ["suao"[SYMBOLS.index(c) // 4] for c in symbols]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn`, and how
    often each row is there then (`copies`, 0 for dropped ones). Nulls read as one space."""
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(rows: DataFrame) -> DataFrame:
    """Each different (conv_id, turn, role, text) once, with `symbols`, a letter for every copy: blank
    if it has nothing but white space, duplicate if its role and text stand earlier in the
    conversation (or in an earlier copy), cut if its last visible character is none of .!? ."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    copies = F.coalesce(F.col("copies"), F.lit(0)) if "copies" in rows.columns else F.lit(1)
    once = rows.select("conv_id", "turn", *[x.alias(c) for c, x in said.items()], copies.cast("long").alias("copies")).groupBy(
        "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    seen = F.rtrim("text", F.lit(_SPACE))
    once = stored(once.withColumns({
        "blank": seen == "", "cut": ~F.right(seen, F.lit(1)).isin(".", "!", "?"),
        "same": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))}), "turns")
    first = once.where(~F.col("blank") & (F.col("copies") > 0)).groupBy(
        F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(F.struct("turn")).alias("first"))
    known = once.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left").drop("c", "s")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)

    def letter(fault):
        return F.substr(F.lit(SYMBOLS), kind + fault + 1, F.lit(1))
    new = F.col("first.turn").eqNullSafe(F.col("turn"))
    own = F.when(F.col("cut"), letter(CUT)).otherwise(letter(OK))
    symbols = F.when(F.col("copies") == 0, "").when(F.col("blank"), F.repeat(letter(BLANK), F.col("copies").cast("int"))).otherwise(
        F.concat(F.when(new, own).otherwise(letter(DUPLICATE)), F.repeat(letter(DUPLICATE), (F.col("copies") - 1).cast("int"))))
    return known.select("conv_id", "turn", "role", "text", symbols.alias("symbols"))


def _schema(df: DataFrame, **more) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *[T.StructField(k, t) for k, t in more.items()]])


def _table(batch: pa.RecordBatch, ids: list, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), *columns.values()], ["conv_id", *columns])


def sequences(marked: DataFrame) -> DataFrame:
    """(conv_id, symbols) of every conversation, in the order of turn (nulls first), role and text."""
    order = ["conv_id", "turn", "role", "text"]

    def chunks(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            rows = [(i, "".join(s for _, s in g)) for i, g in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), lambda r: r[0])]
            yield _table(b, [i for i, _ in rows], {"part": pa.array([part] * len(rows), pa.int32()), "batch": pa.array([k] * len(rows), pa.int32()),
                                                   "symbols": pa.array([s for _, s in rows], pa.string())})
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "symbols")
    pieces = ranged.mapInArrow(chunks, _schema(marked, part=T.IntegerType(), batch=T.IntegerType(), symbols=T.StringType()))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("part", "batch", "symbols"))), lambda s: s["symbols"]), "").alias("symbols"))


def solved(strings: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of (conv_id, symbols)."""
    counted = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT}

    def run(batches):
        for b in batches:
            symbols = b.column(1).to_pylist()
            best = audits(symbols)
            of = {s: [*(sum(map(s.count, SYMBOLS[f::4])) for f in counted.values()), illegal(s), *best[s]] for s in best}
            values = list(zip(*(of[s] for s in symbols))) or [()] * 6
            yield _table(b, b.column(0).to_pylist(), {k: pa.array(v, pa.string() if k == "audit" else pa.int64())
                                                      for k, v in zip((*counted, "illegal", "cost", "audit"), values)})
    long = T.LongType()
    return strings.mapInArrow(run, _schema(strings, **dict.fromkeys(counted, long), illegal=long, cost=long, audit=T.StringType()))


def gaps(marked: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns missing between the first and the last; 0 without turns, null beyond
    64 bits."""
    turns = marked.where(F.col("symbols") != "").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).where(F.col("turn").isNotNull())
    wide = [F.max("turn").cast("decimal(38,0)"), F.min("turn").cast("decimal(38,0)"), F.count("one").cast("decimal(38,0)")]
    return turns.groupBy("conv_id").agg((wide[0] - wide[1] + 1 - wide[2]).try_cast("long").alias("gaps"))


def repaired(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): what the audits of `found` make of the rows, a conversation's
    rows one after another within a partition. Inserted rows have an empty text."""
    rows = found.select("conv_id", F.lit(False).alias("row"), F.lit(None).cast(marked.schema["turn"].dataType).alias("turn"),
                        F.lit("").alias("role"), F.lit("").alias("text"), F.col("audit").alias("symbols")).unionByName(
        marked.where(F.col("symbols") != "").withColumn("row", F.lit(True)))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "text").select("conv_id", "row", "role", "text", "symbols")

    def run(batches):
        conv, audit, at, state, position, out = None, "", 0, 0, 0, []

        def say(role, text, to):
            nonlocal state, position
            state, position = to, position + 1
            out.append((conv, position, role, text))

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                role, to = _NEXT[state]
                say(role, "", to)
        for b in batches:
            for i, row, role, text, symbols in zip(*(c.to_pylist() for c in b.columns)):
                if not row:
                    inserted()
                    conv, audit, at, state, position = i, symbols, 0, 0, 0
                    continue
                for _ in symbols:
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        say(role, text, _STEP[state, role[:1]])
                    elif edit == "R":
                        new, to = _NEXT[state]
                        say(new, text, to)
            yield emit(b, out)
            out = []
        inserted()
        if out:
            yield emit(b, out)

    def emit(b, out):
        cols = list(zip(*out)) or [()] * 4
        return _table(b, list(cols[0]), {"position": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string())})
    return ordered.mapInArrow(run, _schema(marked, position=T.LongType(), role=T.StringType(), text=T.StringType()))


def hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of `repaired`, in the same stage: SHA-256 of `role:text`
    joined by newlines, fed row by row."""
    def run(batches):
        conv, sha, b = None, None, None
        for b in batches:
            done = []
            for i, position, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if position == 1:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = i, hashlib.sha256()
                sha.update((f"\n{role}:{text}" if position > 1 else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            yield emit(b, done)
        if sha is not None:
            yield emit(b, [(conv, sha.hexdigest())])

    def emit(b, done):
        return _table(b, [i for i, _ in done], {"repaired_sha256": pa.array([h for _, h in done], pa.string())})
    return rows.mapInArrow(run, _schema(rows, repaired_sha256=T.StringType()))


def repair(rows: DataFrame):
    """(found, marked): per conversation its counts, cost and audit, and its rows for `repaired`.
    `rows` has conv_id, turn, role, text and perhaps `copies` (0: only the conversation is known).
    Null roles and texts read as one space, a null conv_id is a conversation of its own, equal rows
    are copies of one another, rows of one turn follow by role and text. An empty table gives none."""
    marked = stored(faults(rows), "marked-turns")
    missing = gaps(marked).select(F.col("conv_id").alias("c"), "gaps", F.lit(True).alias("known"))
    found = solved(sequences(marked)).join(missing, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return stored(found.select("conv_id", F.when(F.col("known"), F.col("gaps")).otherwise(0).alias("gaps"), *names), "audits"), marked


def digest(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every
    conv_id of `rows`. Without rows: zeros, an empty audit and the hash of nothing."""
    found, marked = repair(rows)
    sha = hashes(repaired(marked, found)).withColumnRenamed("conv_id", "c")
    return found.join(sha, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
