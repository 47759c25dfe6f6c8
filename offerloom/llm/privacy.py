"""Personal data: base patterns, and information-theoretic sanitisation of the words around them.

A word discloses a protected entity (an address, a number) as far as seeing the word makes the
entity likely. Over the whole corpus, N documents are counted, those with the entity, with the
word, and with the word close to the entity; the pointwise mutual information of the two is at
most the entity's information content, log2(N / documents with it). The probability of the
entity given the word is smoothed by a part of a document in which the entity is as likely as
anywhere, so an entity of one text is measured too, and few documents prove less than many. A
word whose information comes within a threshold of the content is generalised, one that
practically names the entity is removed, at all its places in the documents that hold both."""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: The base patterns. Lookbehinds only spare attempts inside a run of digits.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
KINDS = ["email", "ip", "card", "phone", "general", "removed"]

#: Words on either side of an entity that count as its context in the estimate.
NEAR = 8
#: Documents added to those with a word, the entity in them as likely as in all documents.
PRIOR = 0.5
#: Shares of the entity's information content from which a word is generalised and removed.
GENERALISE, REMOVE = 0.9, 0.99
_WORD = re.compile(r"\w+")
_SLOTS = 1 << 23
_SPAN = "array<struct<start:int,ord:int,end:int>>"
_NEAR = "array<struct<entity:bigint,term:string>>"
_PLACES = "array<struct<start:int,end:int>>"


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` from its @ outwards, so a long
    run without @ costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(s: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42)).view(np.int64))


def _entities(text: str, spans) -> list[int]:
    """The hash of every span's entity."""
    values = (text[s:e].lower() if kind == 0 else text[s:e] if kind == 1 else _digits(text[s:e]) for s, kind, e in spans)
    return [_hash(f"{KINDS[kind]}:{value}") for (_, kind, _), value in zip(spans, values)]


def _words(text: str, spans) -> list[tuple[int, int, bool]]:
    """(start, end, whether it counts) of the whole words of a text. Words inside a base span or of
    one or two characters don't count."""
    out, k, reach = [], 0, 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][2])
            k += 1
        out.append((a, b, b - a > 2 and reach <= a))
    return out


def contexts(text: str, spans) -> list[dict]:
    """(entity, term) of the words near the entities, once each."""
    words = _words(text, spans)
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    found = set()
    for (s, _, e), entity in zip(spans, _entities(text, spans)):
        left, right = bisect_right(ends, s), bisect_left(starts, e)
        for a, b, counts in words[max(0, left - NEAR):left] + words[right:right + NEAR]:
            if counts:
                found.add((entity, text[a:b].lower()))
    return [{"entity": k, "term": t} for k, t in sorted(found)]


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, base, near): base spans and contexts of every row."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("ord", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string())]))

    def run(batches):
        for b in batches:
            base, close = [], []
            for t in b.column(1):
                t = t.as_py()
                spans = base_spans(t)
                base.append([{"start": s, "ord": k, "end": e} for s, k, e in spans])
                close.append(contexts(t, spans) if spans else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(base, span), pa.array(close, near)], ["doc_id", "h", "base", "near"])
    return _text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, h long, base {_SPAN}, near {_NEAR}")


def _slots(rows: DataFrame, key: Column) -> bytes:
    """One bit per slot of a 64-bit hash, set where `rows` has a key; of fixed size."""
    slot = F.pmod(key, F.lit(_SLOTS))
    parts = rows.select(F.shiftright(slot, 15).alias("part"), F.pmod(slot, F.lit(1 << 15)).alias("at")).groupBy("part").agg(
        F.bitmap_construct_agg("at").alias("bits")).collect()
    out = bytearray(_SLOTS // 8)
    for r in parts:
        out[r["part"] << 12:(r["part"] + 1) << 12] = r["bits"]
    return bytes(out)


def _marked(packed: bytes, key: int) -> bool:
    key %= _SLOTS
    return bool(packed[key >> 3] >> (key & 7) & 1)


def _documents_with(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(term, n_term): documents that hold each of `terms` (term). A bit per slot of the terms'
    hashes, of fixed number, tells tasks which words to count; the join drops what only shares a slot."""
    packed = _slots(terms, F.xxhash64("term"))

    def run(batches):
        known: dict[str, bool] = {}
        count: dict[str, int] = {}

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
        for b in batches:
            for t in b.column(0):
                for w in {w.lower() for w in set(_WORD.findall(t.as_py()))}:
                    hit = known.get(w)
                    if hit is None:
                        if len(known) > 200_000:
                            known.clear()
                        hit = known[w] = _marked(packed, _hash(w))
                    if hit:
                        count[w] = count.get(w, 0) + 1
                if len(count) > 200_000:
                    yield counted()
                    count = {}
        yield counted()
    counts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term string, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term")


def disclosing(docs: DataFrame, scan: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, ord) of the words that disclose an entity, from the counts of all documents."""
    near = scan.select(F.inline("near")).select("entity", "term")
    meet = stored(near.groupBy("entity", "term").agg(F.count("*").alias("n_both")), "meet")
    schema = "entity long, term string, ord int"
    if not meet.limit(1).count():
        return docs.sparkSession.createDataFrame([], schema)
    held = scan.select("doc_id", "h", F.array_distinct(F.transform("near", lambda x: x["entity"])).alias("e")).select(F.explode("e").alias("entity"))
    n_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_term = _documents_with(docs, meet.select("term").distinct(), text_col)
    total = F.lit(scan.count())
    content = F.log2(total / F.col("n_entity"))
    usual = F.col("n_entity") / total
    share = F.log2((F.col("n_both") + PRIOR * usual) / (F.col("n_term") + PRIOR) / usual) / content
    rows = meet.join(n_entity, "entity").join(n_term, "term").where(content > 0).withColumn("share", share)
    return rows.where(F.col("share") >= GENERALISE).select("entity", "term", F.when(F.col("share") >= REMOVE, 5).otherwise(4).alias("ord"))


def placed(docs: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, entity, term, places): all places of the disclosing words `told` in the documents
    that hold the entity. Slot bits, of the words and of the pairs, tell tasks which rows to make;
    what only shares a slot goes with the join on `told`."""
    terms = _slots(told, F.xxhash64("term"))
    pairs = _slots(told, F.xxhash64("term").bitwiseXOR(F.col("entity")))
    place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("entity", pa.int64()), ("term", pa.string()), ("places", place)])

    def run(batches):
        for b in batches:
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                spans = base_spans(t)
                if not spans:
                    continue
                at: dict[str, list] = {}
                for x, y, counts in _words(t, spans):
                    if counts:
                        at.setdefault(t[x:y].lower(), []).append({"start": x, "end": y})
                hashes = {w: k for w in at if _marked(terms, k := _hash(w))}
                hits = [(e, w) for e in set(_entities(t, spans)) for w, k in hashes.items() if _marked(pairs, k ^ e)]
                for k in range(0, len(hits), 10_000):
                    part = hits[k:k + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": [b.column(0)[i].as_py()] * len(part), "h": [b.column(2)[i].as_py()] * len(part), "entity": [e for e, _ in part],
                        "term": [w for _, w in part], "places": [at[w] for _, w in part]}, schema)
    out = _text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, h long, entity long, term string, places {_PLACES}")
    return out.join(told, ["entity", "term"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, h (hash of the text), base and all: arrays of (start, ord of
    KINDS, end), in code points, end exclusive, sorted. Null texts are empty; equal rows get equal
    spans and are returned each; an empty table gives no rows. Base spans always stay; words are
    added only in documents that hold an entity they disclose."""
    scan = stored(scanned(docs, id_col, text_col), "privacy")
    told = stored(disclosing(docs, scan, text_col), "disclosing")
    near = placed(docs, told, id_col, text_col)
    span = F.transform("places", lambda p: F.struct(p["start"].alias("start"), F.col("ord").alias("ord"), p["end"].alias("end")))
    more = near.select("doc_id", "h", F.explode(span).alias("s")).groupBy("doc_id", "h").agg(F.collect_set("s").cast(_SPAN).alias("words"))
    more = more.withColumnsRenamed({"doc_id": "i", "h": "j"})
    # a word may disclose two entities; the stronger measure holds
    words = F.filter("words", lambda s: ~F.exists("words", lambda o: (o["start"] == s["start"]) & (o["ord"] > s["ord"])))
    joined = scan.join(more, F.expr("doc_id <=> i and h = j"), "left")
    return joined.select("doc_id", "h", "base", F.when(F.col("words").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", words))).alias("all"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def mask(text: str | None, spans) -> str | None:
    """The text with its spans replaced: entities by their kind, words by their general form or
    nothing. Of overlapping spans the first, and of those the longest, decides."""
    if text is None or spans is None or not len(spans):
        return text
    out, free = [], 0
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2], x[1])):
        if s < free:
            if e <= free:
                continue
            s = free
        word = text[s:e]
        out += [text[free:s], f"[{KINDS[k].upper()}]" if k < 4 else "" if k == 5 else "[NUMBER]" if word.isdigit() else "[WORD]"]
        free = e
    return "".join([*out, text[free:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of `docs`, in all their columns, with the text masked. `length_col`, if given, is
    set to the code points of a masked text."""
    spans = find(docs, id_col, text_col).where(F.size("all") > 0).select(
        F.col("doc_id").alias("_i"), F.col("h").alias("_j"), F.col("all").alias("_spans")).dropDuplicates(["_i", "_j"])
    names = docs.columns
    at = names.index(text_col)
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name of the input clashes
    keyed = own.withColumns({"_id": F.col(f"c{names.index(id_col)}").cast("long"), "_h": F.xxhash64(F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")))})
    joined = keyed.join(spans, F.expr("_id <=> _i and _h = _j"), "left")

    def run(batches):
        for b in batches:
            texts, spans = b.column(at), b.column(len(names))
            new = [mask(t.as_py(), [(x["start"], x["ord"], x["end"]) for x in s.as_py()]) if s.is_valid else t.as_py() for t, s in zip(texts, spans)]
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(new, pa.string())
            if length_col:
                k = names.index(length_col)
                cols[k] = pa.array([len(n) if s.is_valid and n is not None else x for n, s, x in zip(new, spans, cols[k].to_pylist())], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names)
    return joined.select(*own.columns, "_spans").mapInArrow(run, docs.schema)
