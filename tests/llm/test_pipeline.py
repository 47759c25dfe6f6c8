"""The pipeline against brute force on a small table, and its stages on odd rows."""
import numpy as np

import corpus_pipeline as cp
from offerloom.llm import packing, privacy, quality, simhash
from offerloom.storage import stored

from .test_operators import _gapless, _groups, _plain_fp, _plain_spans

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(cp.STAGES)
    first = stored(stage["quality classifier"](spark, docs, SF), "t")
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good
    trees = quality.fit(docs, labels)
    assert all((r.doc_id in good) == (trees.probability(np.array([quality.statistics(r.text)], np.float32))[0] >= 0.7) for r in docs.collect())

    second = stored(stage["simhash near-dedup"](spark, first, SF), "t")
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert second.columns == docs.columns
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(_groups([i for i, _ in rows], [_plain_fp(t) for _, t in rows])))

    third = stored(stage["personal data"](spark, second, SF), "t")
    texts = {r.doc_id: r.text for r in second.collect()}
    spans = {r.doc_id: r for r in privacy.find(second).collect()}
    for r in third.collect():
        old = texts[r.doc_id]
        base = [tuple(s) for s in spans[r.doc_id]["base"]]
        assert base == _plain_spans(old) and r.n_chars == len(r.text)
        assert r.text == privacy.mask(old, [tuple(s) for s in spans[r.doc_id]["all"]])
        assert all(old[s:e] not in r.text for s, _, e in base)

    fourth = stored(stage["source mixing"](spark, third, SF), "t")
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert fourth.columns == docs.columns and abs(words(fourth) / words(third) - 1.5) < 0.05  # twenty small sources, each within a document of its target
    last = stage["best-fit packing"](spark, fourth, SF).toPandas()
    assert (last.piece == 0).sum() == fourth.count()
    _gapless(last)
    whole = cp.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].to_numpy().tolist())) == sorted(map(tuple, last[key].to_numpy().tolist()))


def test_stages_on_odd_rows(spark, edge):
    for name, stage in cp.STAGES:
        out = stage(spark, edge, SF)
        assert name == cp.STAGES[-1][0] or out.columns == edge.columns
        out.count()
        assert stage(spark, edge.limit(0), SF).count() == 0
    kept = cp.near_dedup(spark, edge, SF).toPandas()
    assert kept.doc_id.dropna().is_unique and kept.doc_id.isna().sum() == 2
    assert {1, 4} <= set(kept.doc_id.dropna()) and not {2, 5, 6, 8} & set(kept.doc_id.dropna())


def test_registered():
    import __spark_entry__ as e
    assert [n for n, _ in cp.STAGES] and "pipeline" in e.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert simhash.BITS == 3 and packing.SIZE == 2048


def test_queries_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as e
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name in ("op2_suffix_array_dedup", "op9_source_mixing"):
        want = con.execute(e.oracle_sql()[name]).df()
        got = e.queries()[name](spark, SF).toPandas()[list(want.columns)]
        assert sorted(map(str, got.to_numpy().tolist())) == sorted(map(str, want.to_numpy().tolist()))
