"""The corpus pipeline: each stage reads what the one before it wrote.

Documents pass the quality classifier, one of each near-duplicate group stays, personal data is
masked, sources are mixed to their targets, and what is left is packed into sequences."""
from __future__ import annotations

from offerloom.llm import mixing, packing, privacy, quality, simhash
from offerloom.storage import ship, stored


def keep_quality(spark, docs, sf_dir):
    """Rows that the classifier accepts. It is trained on the labels of documents it may learn from. A
    null text is scored as an empty one; equal texts have equal scores, so repeated rows go or stay
    together; other columns pass unread; an empty table stays empty."""
    ship(spark)
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays, the one with its smallest doc_id. Texts without
    words, null and empty ones included, are one group; repeated rows count as copies; rows without a doc_id stay."""
    ship(spark)
    return simhash.representatives(docs)


def mask_personal_data(spark, docs, sf_dir):
    """All rows, with personal data and the words that disclose it masked in the text; n_chars
    follows the text. A null text stays null; repeated rows are masked alike."""
    ship(spark)
    return privacy.sanitised(docs, length_col="n_chars")


def mix_sources(spark, docs, sf_dir):
    """Rows as often as the mix takes them. Rows without words, null texts among them, add nothing and
    go; a null source is a source of its own; equal rows are taken equally often."""
    ship(spark)
    return mixing.mixed(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of the documents and their places in sequences. A null text is an empty one: its end id;
    every repeated row has pieces of its own; an empty table has none."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("simhash near-dedup", near_dedup), ("personal data", mask_personal_data),
          ("source mixing", mix_sources), ("best-fit packing", pack_sequences)]
#: Trees, fingerprints and tokens can't be stated in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents. Every stage's result is a table in the shared folder, with the
    columns of documents but for the last one's pieces. Without documents there are no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
