"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every five-word shingle is hashed once; the upper bits of the hash choose one of 256 bins and the
least hash of a bin stays. A bin without shingles takes the value of another one: it tries bins in
an order of its own, given by a hash of its number and the attempt (optimal densification), so
equal sets fill alike; what it takes is hashed with its own number, so that few shingles do not agree
or differ by chance in all bins at once. Of every bin the lowest four bits are packed, sixteen bins to a number. Two
fingerprints agree by chance in one bin of sixteen; the likeness takes that out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from ..storage import stored

SHINGLE, BINS, BITS = 5, 256, 4
#: Attempts before an empty bin takes the filled bin whose hash with it is least.
ATTEMPTS = 8
_SHIFT = 56  # a hash's upper eight bits are its bin
_LOW = (1 << _SHIFT) - 1
_PER = 64 // BITS


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def _least_by_bin(words: Column) -> Column:
    """256 hashes in the order of bins. One mark per bin, above every hash of it, is sorted with
    the shingles' hashes; what follows the mark of the bin before is a bin's least hash, or its
    own mark."""
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))),
                           lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
                        lambda b: F.shiftleft(b.cast("long"), _SHIFT).bitwiseOR(F.lit(_LOW)))
    return F.sort_array(F.concat(shingles, marks))


def _first_of_bins(hashes: Column) -> Column:
    before = F.concat(F.array(F.lit(_LOW)), hashes)
    return F.array_compact(F.zip_with(hashes, before, lambda x, b: F.when(_empty(b), x)))


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)) == _LOW


def _densified(bins: Column) -> Column:
    def fill(x, i):
        tried = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), x, lambda a, t: F.when(
            _empty(a), F.get(bins, F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int"))).otherwise(a))
        rest = lambda: F.array_min(F.transform(
            F.filter(bins, lambda y: ~_empty(y)), lambda y: F.struct(F.xxhash64(i, F.shiftright(y, _SHIFT)).alias("p"), y.alias("y"))))["y"]
        return F.when(_empty(x), let(tried, lambda v: F.xxhash64(F.when(_empty(v), rest()).otherwise(v), i))).otherwise(x)
    return F.transform(bins, fill)


def _packed(bins: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER - 1)), lambda k: F.aggregate(
        F.slice(bins, k * _PER + 1, _PER), F.lit(0).cast("long"),
        lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))))


def fingerprint(text: Column) -> Column:
    """The fingerprint (array<long> of packed bits) of a text. A null text is an empty one; a text
    of fewer than five words is one shingle. Every step is bound in a lambda, so it is computed
    once, and array loops
    run in Spark's compiled classes, while in one generated method with joins around them
    they would outgrow what the JVM compiles."""
    return let(text, lambda t: let(_words(t), lambda w: let(_least_by_bin(w), lambda h: let(_first_of_bins(h), lambda b: let(_densified(b), _packed)))))


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from 0 to 1."""
    ones = F.lit(sum(1 << i for i in range(0, 64, BITS)))

    def differing(x, y):
        half = let(x.bitwiseXOR(y), lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1)))
        return F.bit_count(let(half, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 2))).bitwiseAND(ones))
    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((1 - differ / BINS) - chance) / (1 - chance)))


def _next_rows(ids: DataFrame) -> DataFrame:
    """(doc_id, h, next_id, next_h) of distinct rows in descending doc_id, null last, then h; the
    row after the last is the first. Ranges of the order are numbered, neighbours are found
    inside them, and the last row of a range takes the first of the next."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ranged = stored(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "next-ids")
    w = W.partitionBy("range").orderBy(*order)
    rows = ranged.withColumn("next", F.lead(F.struct("doc_id", "h")).over(w)).withColumn("at", F.row_number().over(w))
    firsts = rows.where("at = 1").select("range", F.struct("doc_id", "h").alias("first"))  # a row per range
    whole = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = firsts.select("range", F.coalesce(F.lead("first").over(W.orderBy("range")), F.first("first").over(whole)).alias("following"))
    return rows.join(following, "range").select("doc_id", "h", F.coalesce("next", "following").alias("next")).select(
        "doc_id", "h", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last third is replaced by
    the beginning of the next document: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next), the fingerprints as arrays of packed bits. Null
    texts are empty. Rows equal in doc_id and text count as one place in the order and are
    returned each. A single row is its own next document; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ids = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.first(F.char_length("text")).alias("n_chars"))
    ids = stored(ids, "ids")
    repeated = ids.where("n > 1").limit(1).count() > 0
    once = (lambda df: df.dropDuplicates(["doc_id", "h"])) if repeated else (lambda df: df)
    links = _next_rows(ids.select("doc_id", "h")).join(ids.withColumnsRenamed({"doc_id": "i", "h": "j"}).drop("n"), F.expr("doc_id <=> i and h = j")).select(
        "doc_id", "h", "next_id", "next_h", "n_chars", F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    nexts = once(rows).join(links.withColumnsRenamed({"doc_id": "own_id", "h": "own_h"}), F.expr("doc_id <=> next_id and h = next_h")).select(
        "own_id", "own_h", "next_id", "next_h", "n_chars", "cut", F.substr("text", F.lit(1), "cut").alias("tail"))
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars") - F.col("cut")), F.col("tail"))
    both = rows.join(nexts, F.expr("doc_id <=> own_id and h = own_h")).select(
        "doc_id", "h", "next_id", "next_h", F.col("n_chars").cast("long").alias("n_chars"),
        F.inline(F.array(F.struct(F.lit(False).alias("is_edit"), F.col("text")), F.struct(F.lit(True).alias("is_edit"), edited.alias("text")))))
    sha = F.when(F.col("is_edit"), F.sha2("text", 256))
    marked = stored(both.withColumns({"edited_sha256": sha, "fingerprint": fingerprint(F.col("text"))}).drop("text"), "fingerprints")
    own = marked.where("not is_edit").drop("edited_sha256")
    edits = once(marked.where("is_edit")).select(
        F.col("doc_id").alias("e_id"), F.col("h").alias("e_h"), "edited_sha256", F.col("fingerprint").alias("edited_fingerprint"))
    following = once(own).select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), F.col("fingerprint").alias("following"))
    return own.join(edits, F.expr("doc_id <=> e_id and h = e_h")).join(following, F.expr("next_id <=> f_id and next_h = f_h")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"))
