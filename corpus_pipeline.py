"""The training-data pipeline: stages over documents, each written as Parquet and read again by the next.

Quality drops what the classifier rejects; near-dedup leaves one document of each class; secrets redacts what the scan
finds; mix repeats or leaves out documents so that the sources' words come near their targets; pack lays all documents
that are left into sequences. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from quarry.llm import mixing, packing, secrets
from quarry.llm.common import fresh_path
from quarry.llm.near_dups import near_dedup_stage
from quarry.llm.quality import quality_stage


def secrets_stage(spark, docs, sf_dir):
    """docs with the secrets in their texts redacted."""
    return secrets.redacted(docs)


def mix_stage(spark, docs, sf_dir):
    """Whole documents as often as the mix takes them; texts are never cut."""
    return mixing.mixed_documents(docs)


def pack_stage(spark, docs, sf_dir):
    """The pieces of all documents with their sequences and places."""
    return packing.pack(docs, lean=True)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mix", mix_stage), ("pack", pack_stage)]
#: Trained weights, hashes of shingles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
