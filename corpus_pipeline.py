"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of ``documents``.  ``run`` writes each stage's rows as Parquet
in the shared checkpoint folder and reads them back for the next one.
"""

from bootlens.llm import bpe, mixing, quality_rules, registry, secret_scan, simhash
from bootlens.llm.common import staged, table


def drop_low_quality(spark, docs, sf_dir):
    """Documents that break a quality rule go (operator 9)."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of near-duplicates the smallest doc_id stays (operator 8)."""
    return simhash.keep_one(docs, shingle=registry.SHINGLE, seed=registry.SHINGLE_SEED, max_bits=registry.MAX_BITS)


def mask_secrets(spark, docs, sf_dir):
    """Secrets in texts are masked; ``n_chars`` follows (operator 7)."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark, docs, sf_dir):
    """Every document as often as the mix takes it: not at all, once or twice (operator 4)."""
    return mixing.take(docs)


def encode(spark, docs, sf_dir):
    """Token ids of every whole text, with digests of ids and decoded text (operator 1)."""
    return bpe.encode_documents(docs, registry.tokenizer_path())


STAGES = [
    ("quality_rules", drop_low_quality),
    ("simhash_near_dup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The forest of the secret scan and the merges of BPE have no SQL form; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
