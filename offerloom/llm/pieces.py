"""SentencePiece encoding and decoding with merge-type vocabularies.

The pairs of adjacent symbols that make a piece wait in an agenda ordered by score and then by
place; the best one is merged, its neighbours enter the agenda, entries whose symbols have changed
meanwhile are passed over. In a vocabulary where a word mark stands only at the start of a piece no
merge crosses from a letter to a mark, so a text falls into segments with agendas of their own.
The agendas of all short segments that are new in a batch form one array, from which each segment's
best entry is taken at the same time; a long segment has a heap. A worker keeps the ids of short
segments. Every segment that is merged anew is also given to the sentencepiece library, batch by
batch; a difference ends the job."""
from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments whose ids a Python worker keeps, and the longest kept; beyond, it starts anew.
CACHE, LONGEST = 150_000, 48
#: Texts of an Arrow batch that are in hand at once.
ROWS = 256
#: Symbols up to which an agenda is a part of the batch's array.
SHORT = 64
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NEVER = np.iinfo(np.int64).max

codecs.register_error("offerloom_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A merge-type model read from its file, which has to leave text as it is (identity) and may
    have byte pieces for characters without a piece."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix \
                or any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in model.pieces):
            raise ValueError("only merge-type models that leave the text as it is are read")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if check else None
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.unknown, self.end = model.trainer_spec.unk_id, model.trainer_spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        shown = [b"" if p.type == _CONTROL else model.trainer_spec.unk_surface.encode() if p.type == _UNKNOWN
                 else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.shown = Ragged([list(x) for x in shown], np.uint8)
        self.control = np.array([p.type == _CONTROL for p in model.pieces])
        self.opens = np.array([p.type == _NORMAL and p.piece.startswith(MARK) for p in model.pieces])
        apart = not any(MARK in p.lstrip(MARK) for p in self.ids) and self.prefix
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"(?s).+").findall
        self._pairs()
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.kept = Ragged([[self.end]], np.int32)  # entry 0 ends a text

    def _pairs(self):
        """Pairs of symbols that make a piece, by key, with the place of its score and its id. A
        symbol is a piece's id, or the number of pieces and the code point of a character that is none."""
        self.size = max(self.ids.values(), default=0) + 1
        place = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}

        def symbol(text):
            return self.ids.get(text, self.size + ord(text) if len(text) == 1 else None)
        found = sorted((symbol(w[:k]) << 21 | symbol(w[k:]), place[self.cost[w]], i) for w, i in self.ids.items() for k in range(1, len(w))
                       if symbol(w[:k]) is not None and symbol(w[k:]) is not None)
        self.keys, self.place, self.whole = np.array(found, np.int64).reshape(-1, 3).T.copy()
        self.symbols = self.size + np.arange(0x110000, dtype=np.int32)
        for w, i in self.ids.items():
            if len(w) == 1:
                self.symbols[ord(w)] = i

    def _entries(self, left, right, at):
        """Agenda entries (score's place, then place in the array) and the pieces they make."""
        key = left << 21 | right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = self.keys[k] == key
        return np.where(fits, self.place[k] << 32 | at, _NEVER), self.whole[k]

    def merged_batch(self, segments: list[str]):
        """(symbols, length of each segment) after all merges of short segments; every round takes
        the best entry of each."""
        sym = self.symbols[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        length, who = np.fromiter(map(len, segments), np.int64, len(segments)), np.arange(len(segments))
        last = np.cumsum(length) - 1
        agenda, make = self._entries(sym, np.append(sym[1:], 0), np.arange(len(sym)))
        agenda[last] = _NEVER
        done = []
        while len(who):
            best = np.minimum.reduceat(agenda, last - length + 1)
            more = best != _NEVER
            if not more.all():
                keep = np.repeat(more, length)
                done.append((who[~more], length[~more], sym[~keep]))
                sym, make, agenda = _left(keep, sym, make, agenda)
                who, length = who[more], length[more]
                last = np.cumsum(length) - 1
                best = np.minimum.reduceat(agenda, last - length + 1) if len(who) else best[:0]
            at = best & 0xFFFFFFFF
            sym[at] = make[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, make, agenda = _left(keep, sym, make, agenda)
            at = at - np.arange(len(at))  # one symbol of each segment before is gone
            length = length - 1
            last = np.cumsum(length) - 1
            for here in (at[at < last], at[at > last - length + 1] - 1):
                agenda[here], make[here] = self._entries(sym[here], sym[here + 1], here)
            agenda[last] = _NEVER
        if not done:
            return sym, length
        who, length, sym = map(np.concatenate, zip(*done))
        order = np.argsort(who)
        return _gather(sym, np.cumsum(length)[order] - length[order], length[order]), length[order]

    def merged(self, text: str) -> list[int]:
        """Symbols of a segment after all merges of its agenda, a heap of (cost, place, length)."""
        cost, sym, n = self.cost, list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, 2) for i, p in enumerate(map("".join, zip(sym, sym[1:]))) if p in cost]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            j = after[i]
            if not sym[i] or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                c = cost.get(sym[i] + sym[k])
                if c is not None:
                    heappush(agenda, (c, i, size + len(sym[k])))
            h = before[i]
            if h >= 0:
                c = cost.get(sym[h] + sym[i])
                if c is not None:
                    heappush(agenda, (c, h, size + len(sym[h])))
        return [self.ids[s] if s in self.ids else self.size + ord(s) for s in sym if s]

    def _spelled(self, sym: np.ndarray, length: np.ndarray):
        """(ids, length of each segment): a character without a piece is its bytes, or unknown, of
        which neighbours are one."""
        odd = sym >= self.size
        if not odd.any():
            return sym, length
        chars, which = np.unique(sym[odd] - self.size, return_inverse=True)
        said = Ragged([[self.bytes[b] for b in chr(ch).encode()] if self.bytes else [self.unknown] for ch in chars.tolist()], np.int64)
        each, start = np.ones(len(sym), np.int64), np.arange(len(sym))
        each[odd], start[odd] = said.length[which], len(sym) + said.start[which]
        if not self.bytes:
            first = np.zeros(len(sym), bool)
            first[np.cumsum(length) - length] = True
            each[odd & ~first & np.append(False, odd[:-1])] = 0
        sums = np.append(0, np.cumsum(each))
        ends = np.cumsum(length)
        return _gather(np.concatenate([sym, said.flat[:said.used]]), start, each), sums[ends] - sums[ends - length]

    def encode_arrays(self, texts: list[str]):
        """(ids of all texts, where each text's ids end); an end id closes every text."""
        if len(self.known) > CACHE:
            self._forget()
        known = self.known
        parts = [self.split(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*parts).difference(known)
        long = [s for s in new if len(s) > SHORT]
        new = [*new.difference(long), *long]
        if new:
            merges = [self.merged_batch(new[:len(new) - len(long)])] if len(new) > len(long) else []
            merges += [(np.array(m), np.array([len(m)])) for m in map(self.merged, long)]
            ids, length = self._spelled(*map(np.concatenate, zip(*merges)))
            self._check(new, ids, length)
            known.update(zip(new, range(len(self.kept), len(self.kept) + len(new))))
            self.kept.extend(ids, length)
        get = known.__getitem__
        out = self.kept.gathered([[*map(get, p), 0] for p in parts])
        if any(len(s) > LONGEST for s in long):  # not worth keeping
            self._forget()
        return out

    def _check(self, segments, ids, length):
        if not self.library:
            return
        cut = len(self.prefix)
        given = self.library.encode([s[cut:].replace(MARK, " ") for s in segments], num_threads=1)
        if self.prefix in segments:  # an empty text has no ids in the library, a lone mark has
            k = segments.index(self.prefix)
            given[k] = ids[(e := int(length[:k + 1].sum())) - int(length[k]):e].tolist()
        if list(map(len, given)) != length.tolist() or list(chain.from_iterable(given)) != ids.tolist():
            ends = np.cumsum(length)
            wrong = [s for s, g, n, e in zip(segments, given, length.tolist(), ends.tolist()) if g != ids[e - n:e].tolist()]
            raise ValueError(f"ids differ from the library's: {wrong[0][:200]!r}")

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_arrays(texts)
        return [x.tolist() for x in np.split(ids, ends[:-1])]

    def _text(self, data: bytes, first) -> str:
        text = data.decode("utf-8", "offerloom_each_byte")
        return text[1:] if self.prefix and first is not None and self.opens[first] else text

    def decode(self, ids) -> str:
        """The text of ids: control ids say nothing, runs of byte pieces are read as UTF-8, every
        byte that is none of it is shown as U+FFFD; the first word's mark goes."""
        cuts = [-1, *(k for k, i in enumerate(ids) if self.control[i]), len(ids)]
        runs = [ids[s + 1:e] for s, e in zip(cuts, cuts[1:]) if e > s + 1]
        return "".join(self._text(self.shown.gathered([r])[0].tobytes(), None if k else r[0]) for k, r in enumerate(runs))

    def decode_arrays(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        data, to = _gather(self.shown.flat, self.shown.start[ids], self.shown.length[ids]), np.cumsum(self.shown.length[ids])
        said = np.flatnonzero(self.control[ids])
        start = np.append(0, ends[:-1])
        # control ids within a text keep the bytes around them apart; the usual one at its end does not
        inside = set(np.searchsorted(ends, said[np.isin(said + 1, ends, invert=True)], "right").tolist())
        out = []
        for k, (s, e) in enumerate(zip(start.tolist(), ends.tolist())):
            if k in inside:
                out.append(self.decode(ids[s:e].tolist()))
            else:
                raw = data[to[s - 1] if s else 0:to[e - 1] if e else 0].tobytes() if e > s else b""
                out.append(self._text(raw, ids[s] if raw else None))
        return out


def _left(keep, sym, make, agenda):
    """What is kept, with the entries' places counted anew."""
    sym, make, agenda, back = sym[keep], make[keep], agenda[keep], np.cumsum(~keep)[keep]
    return sym, make, np.where(agenda != _NEVER, agenda - back, _NEVER)


def _gather(flat, start, length):
    """flat[start:start + length] of every entry, one after another."""
    stop = np.cumsum(length)
    return flat[np.repeat(start - stop + length, length) + np.arange(int(stop[-1]) if len(stop) else 0)]


class Ragged:
    """Lists of numbers in one growing array."""

    def __init__(self, lists, dtype):
        self.flat, self.length, self.start, self.used = np.empty(1024, dtype), np.empty(0, np.int64), np.empty(0, np.int64), 0
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        self.extend(np.fromiter(chain.from_iterable(lists), dtype, int(length.sum())), length)

    def __len__(self):
        return len(self.length)

    def extend(self, numbers, length):
        end = self.used + len(numbers)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.empty(self.used + 2 * len(numbers), self.flat.dtype)])
        self.flat[self.used:end] = numbers
        self.start = np.append(self.start, self.used + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.used = end

    def gathered(self, chosen):
        """(numbers, ends): the lists named by each entry of `chosen`, one after another."""
        ends = np.cumsum(np.fromiter(map(len, chosen), np.int64, len(chosen)))
        which = np.fromiter(chain.from_iterable(chosen), np.int64, int(ends[-1]) if len(ends) else 0)
        length = self.length[which]
        return _gather(self.flat, self.start[which], length), np.append(0, np.cumsum(length))[ends]


@functools.lru_cache(maxsize=2)
def load(name: str, check: bool) -> Pieces:
    import public_tokenizers
    return Pieces(public_tokenizers.path(name), check)


def encoded(text: Column, model: str = MODEL, check: bool = True) -> Column:
    """Ids of whole texts, an end id last, as array<int>. A null text is an empty one: its end id."""
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(model, check)
        for b in batches:
            for k in range(0, len(b), ROWS):
                out, ends = pieces.encode_arrays([t or "" for t in b.slice(k, ROWS).to_pylist()])
                yield pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))
    return ids(text.cast("string"))


def decoded(ids: Column, model: str = MODEL) -> Column:
    """Texts of ids. Null ids are no ids: an empty text; null entries say nothing. An id outside the model ends the job."""
    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(model, False)
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.slice(k, ROWS)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy())
                yield pa.array(pieces.decode_arrays(part.flatten().to_numpy(), ends), pa.string())
    return texts(F.array_compact(ids))


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """All rows and columns with `ids` (a column of that name is replaced). Repeated rows and equal
    texts give equal ids; a text of any length is one row's work."""
    return docs.withColumn("ids", encoded(F.col(text_col), model, check))


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """All rows and columns with `decoded` (a column of that name is replaced)."""
    return rows.withColumn("decoded", decoded(F.col(ids_col), model))


def round_trip(docs: DataFrame, text_col: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """`encode` and `decode` of the ids in one pass of one worker: all rows and columns with `ids` and
    `decoded` (columns of these names are replaced)."""
    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = load(model, check)
        for b in batches:
            for k in range(0, len(b), ROWS):
                out, ends = pieces.encode_arrays([t or "" for t in b.slice(k, ROWS).to_pylist()])
                yield pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out)), pa.array(pieces.decode_arrays(out, ends), pa.string())], ["ids", "decoded"])
    made = docs.withColumn("ids", both(F.col(text_col).cast("string")))
    return made.withColumns({"decoded": F.col("ids.decoded"), "ids": F.col("ids.ids")})


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
