"""SentencePiece ids and texts against the library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from offerloom.llm import pieces
from offerloom.llm.queries import QUERIES

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("short", [0, 5, 64])
def test_ids_equal_the_library(library, monkeypatch, short):
    monkeypatch.setattr(pieces, "SHORT", short)
    monkeypatch.setattr(pieces, "CACHE", 500)
    r = random.Random(7)
    signs = list("ab the1  ▁▁é漢😀\t\n\x00​　Ａ<>") + ["</s>", "<0x41>", "ing", " " * 20]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(2000)]
    own = pieces.Pieces(PATH)
    for k in range(0, len(texts), 100):
        part = texts[k:k + 100]
        assert own.encode_batch(part) == [[*x, 2] for x in library.encode(part)]


def test_any_ids_are_decoded_as_the_library_does(library):
    r, own = random.Random(3), pieces.Pieces(PATH, check=False)
    for _ in range(5000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(3, 259), r.randrange(259, 32000), 28705, 259]) for _ in range(r.randrange(10))]
        assert own.decode(ids) == library.decode(ids), ids
        batch = [ids, [], [2], ids + [2], [2] + ids]
        assert own.decode_arrays(np.array([i for x in batch for i in x], int), np.cumsum([len(x) for x in batch])) == [library.decode(x) for x in batch]


def test_a_difference_from_the_library_ends_the_job(monkeypatch):
    monkeypatch.setattr(pieces, "SHORT", 0)
    own = pieces.Pieces(PATH)
    del own.cost["▁the"]
    with pytest.raises(ValueError):
        own.encode_batch(["the"])


def test_long_text_without_spaces(library):
    text = "zxy" * 100_000 + " end"
    assert pieces.Pieces(PATH).encode_batch([text]) == [[*library.encode(text), 2]]


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode(d.text or "", add_eos=True), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_edge(edge):
    docs = edge.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = pieces.decode(pieces.encode(docs))
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert r.decoded == (r.text or "").replace("▁", " ") and r.ids[-1] == 2
    assert sorted(map(tuple, pieces.digest(pieces.round_trip(docs)).collect()), key=repr) == sorted(map(tuple, pieces.digest(out).collect()), key=repr)
    assert pieces.digest(pieces.round_trip(edge.limit(0))).count() == 0
    nothing = edge.limit(1).select(F.lit(None).cast("array<int>").alias("ids")).union(edge.limit(1).select(F.array(F.lit(None).cast("int"), F.lit(2))))
    assert [r.decoded for r in pieces.decode(nothing).collect()] == ["", ""]
