"""The registered queries on the small tables: SQL where there is any, and the pipeline against plain Python."""

import hashlib
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bootlens.llm import registry, secret_scan
from bootlens.llm.common import prefix_sums
from check_oracle import TABLES, digest
from tests.conftest import SF_SMALL
from tests.llm.rows import documents, odd_rows
from tests.llm.test_quality_rules import plain as plain_quality, words
from tests.llm.test_simhash import plain_components, plain_fingerprint

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(registry.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert digest(df.columns, rows)[:2] == digest(cols, res.fetchall())[:2]


@pytest.mark.parametrize("name", ["op1_bpe", "op3_token_store", "op6_language_id", "op8_simhash"])
def test_one_row_per_document(spark, name):
    ids = [r["doc_id"] for r in registry.QUERIES[name](spark, SF_SMALL).select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect())


def test_op8_as_brute_force(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    fp = {i: plain_fingerprint(t) for i, t in text.items()}
    near = plain_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op8_simhash"](spark, SF_SMALL).collect()}
    assert got == {i: (f"{fp[i]:016x}", near[i]) for i in fp}


def plain_pipeline(rows):
    """Ids and texts after rules, near-duplicates and masking of ``token = "hex"`` values."""
    kept = []
    for i, text in rows:
        (n, chars, symbols, dup, _), failed = plain_quality(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        stop = sum(w.lower() in registry.quality_rules.STOP_WORDS for w in words(text or ""))
        if not failed and 2 * n <= chars <= 12 * n and symbols <= 0.15 * chars and stop >= 0.01 * n and dup <= 0.5 * len(lines):
            kept.append((i, text))
    fp = {i: plain_fingerprint(t) for i, t in kept}
    near = plain_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    hidden = re.compile(r'(?i)(token = ")[0-9a-f]{40}(")')
    return {i: hidden.sub(rf"\1{secret_scan.MASK}\2", t) for i, t in kept if near[i] == i}


def test_pipeline_as_plain_python(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    texts = plain_pipeline(rows)
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    library = Tokenizer.from_file(public_tokenizers.path(registry.TOKENIZER))
    times = {}
    for r in got:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert max(times.values()) <= 2
    sizes = {i: len(words(t)) for i, t in texts.items()}
    assert sum(sizes[i] * n for i, n in times.items()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.02)


def test_stages_on_odd_rows_and_empty(spark):
    for rows in (odd_rows(), []):
        docs = documents(spark, rows)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF_SMALL)
            assert out.collect() is not None
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == columns


def test_prefix_sums_with_a_hot_key(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.lit(None)).otherwise("b").alias("k"), F.col("id"))
    got = prefix_sums(df, ["k"], ["id"], "v").orderBy("id").collect()
    sums = {}
    for r in got:
        assert r["before"] == sums.get(r["k"], 0)
        sums[r["k"]] = sums.get(r["k"], 0) + r["v"]


def test_entry_works_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "bootlens.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 50 and not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
