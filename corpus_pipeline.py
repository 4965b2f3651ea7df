"""A pipeline over ``documents``: toxicity, near-duplicates, benchmark decontamination, personal data, SentencePiece.

Each stage works on all that its predecessor kept. The first three drop documents, the fourth replaces personal data by
placeholders, the last gives the identifiers' count, digests and the decoded text's digest of each document left.
"""

from __future__ import annotations

import uuid

import public_tokenizers

from tessera.llm import decontaminate, pieces, pii, shingles, toxicity
from tessera.llm.common import shared_dir, small_batches


def drop_toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark, docs, sf_dir):
    return shingles.keep_first(docs)


def drop_benchmark(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal(spark, docs, sf_dir):
    return pii.redact(docs)


def encode(spark, docs, sf_dir):
    return pieces.encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), cache=10_000, together=200_000)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_benchmark), ("personal_data", redact_personal), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
