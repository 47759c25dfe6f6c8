"""Secrets in texts, in DataFrame functions only.

Base patterns find assignments, access keys and hex runs. Beside them, tokens of the shortest
secret's length and more are judged by
two character Markov models, one of random strings and one of ordinary identifiers: the log
likelihood ratio of a token's transitions says which explains it better. The models are counts of
character pairs: of encoded digests for random strings, and of the tokens of all documents
outside base matches for ordinary ones."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that the models judge: as long as the shortest secret of the base patterns.
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{ASSIGN_LEAST},}}"
_ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
#: A token is a secret at this log likelihood ratio (nats) in all and per transition.
RATIO, RATIO_EACH = 20.0, 0.7
#: Random strings made.
SAMPLE_RANDOM = 4_096
KINDS = ["assign", "access", "hex", "random"]
_SPAN = "array<struct<start:int,ord:int,end:int>>"


def _pairs(strings: DataFrame) -> dict:
    """Counts of character pairs of a string column `s`: at most one row per pair of the alphabet.
    Equal strings are counted first and taken apart once."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.substr("s", i, F.lit(2)))).alias("pair")
    return {r["pair"]: r["n"] for r in strings.where(F.char_length("s") > 1).groupBy("s").agg(F.count("*").alias("n")).select(
        pair, "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def _logs(counts: dict) -> dict:
    out = {}
    for a in ALPHABET:
        row = [counts.get(a + b, 0) + 0.5 for b in ALPHABET]
        total = math.log(sum(row))
        out |= {a + b: math.log(c) - total for b, c in zip(ALPHABET, row)}
    return out


def train(docs: DataFrame, text_col: str = "text", sample_random: int = SAMPLE_RANDOM) -> list[float]:
    """Log likelihood ratios of all pairs of ALPHABET, row by row."""
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = _pairs(texts.select(F.explode(F.regexp_extract_all(plain, F.lit(_ORDINARY), 0)).alias("s")))
    digest = docs.sparkSession.range(sample_random).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    random = _pairs(digest.select(F.explode(F.array(
        F.col("d"), F.base64(F.unhex("d")), F.translate(F.base64(F.unhex(F.sha2(F.concat("d", F.lit("/")), 256))), "+/", "-_"))).alias("s")))
    p, q = _logs(random), _logs(ordinary)
    return [round(p[a + b] - q[a + b], 4) for a in ALPHABET for b in ALPHABET]


def _ratio(token: Column, table: Column) -> Column:
    place = lambda i: F.position(F.substr(token, i, F.lit(1)), F.lit(ALPHABET)) - 1
    return F.aggregate(F.sequence(F.lit(1), F.char_length(token) - 1), F.lit(0.0),
                       lambda s, i: s + F.get(table, place(i) * len(ALPHABET) + place(i + 1)))


def _spans(text: Column, pattern: str, order: int, keep=None, group: int = 0) -> Column:
    """Spans of a pattern's matches, leftmost and non-overlapping, for which `keep` holds of the
    match's group. The text between the matches gives their places, in code points."""
    none = F.array().cast(_SPAN)

    def placed(found, values):
        def run(between):
            def add(a, k):
                def span(start):
                    end = start + F.char_length(F.get(found, k - 1))
                    one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"))).cast(_SPAN)
                    more = F.concat(a["spans"], one)
                    return F.struct(end.alias("at"), (more if keep is None else F.when(keep(F.get(values, k - 1)), more).otherwise(a["spans"])).alias("spans"))
                return let((a["at"] + F.char_length(F.get(between, k - 1))).cast("int"), span)
            return F.aggregate(F.sequence(F.lit(1), F.size(found)), F.struct(F.lit(0).alias("at"), none.alias("spans")), add)["spans"]
        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), run))
    match = F.regexp_extract_all(text, F.lit(pattern), 0)
    if not group:
        return let(match, lambda m: placed(m, m))
    return let(match, lambda m: F.when(F.size(m) == 0, none).otherwise(
        let(F.regexp_extract_all(text, F.lit(pattern), group), lambda v: placed(m, v))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, ratios: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, base and all (arrays of start, ord of KINDS, end; code points, end
    exclusive, sorted). Tokens that touch a base span are left to it. Null texts are empty;
    repeated rows are returned each; an empty table gives no rows."""
    ratios = train(docs, text_col) if ratios is None else ratios
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    none = F.array().cast(_SPAN)

    def base(t):
        return F.concat(
            _spans(t, ASSIGN, 0, lambda v: F.char_length(v) >= ASSIGN_LEAST, 2),
            F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1, lambda v: F.char_length(v) >= ACCESS_LEAST)).otherwise(none),
            _spans(t, HEX, 2))

    def odd(v):
        return let(_ratio(v, table), lambda r: (r >= RATIO) & (r >= RATIO_EACH * (F.char_length(v) - 1)))

    def row(t):
        return let(F.array_sort(base(t)), lambda b: let(
            F.filter(_spans(t, TOKEN, 3, odd), lambda s: ~F.exists(b, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))),
            lambda more: F.struct(b.alias("base"), F.array_sort(F.concat(b, more)).alias("all"))))
    found = let(F.coalesce(F.col(text_col).cast("string"), F.lit("")), row)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("f")).select("doc_id", "f.base", "f.all")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
