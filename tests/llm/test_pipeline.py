"""The pipeline's stages on a small folder, each against what its operator says of its own input."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tarnrank.llm import byte_bpe, simhash

from .test_operators import PASSAGE, TEXTS, secrets_in


def near_copies_by_brute_force(rows):
    """One (id, text) of each group of fingerprints within 3 bits: the smallest id's, null ids last, and of its texts the one of the least hash."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fps, group = [simhash.fingerprint(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    return {rows[g] for g in group}


def test_pipeline_of_empty_tables_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, version string, blob string, score double, kept_id long"
    for name, rows in (("none", []), ("odd", [(1, "ab cd", "en", None, None, "x", "y", 1.0, 1), (None, None, None, None, None, None, None, None, None), (2, "ab cd", None, "s", 5, None, None, None, 2)])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string, extra long").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == corpus_pipeline.COLUMNS
        got = corpus_pipeline.run(spark, folder).select("doc_id", "decoded_sha256").collect()
        assert [tuple(r) for r in got] == ([(1, hashlib.sha256(b"ab cd").hexdigest())] if rows else [])


def test_pipeline(spark, tmp_path):
    rows = [(i, t, None if k % 5 == 0 else "en", "s", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({(r.doc_id, r.text) for r in docs.collect()})
    lettered = {(i, t) for i, t in TEXTS if any(c.isalpha() for c in t or "")}
    assert kept[0] == lettered
    assert kept[1] == near_copies_by_brute_force(kept[0])
    assert kept[1] <= kept[0] and (8, TEXTS[7][1]) not in kept[1] and (4, TEXTS[3][1]) in kept[1] and sum(i == 22 for i, _ in kept[1]) == 1
    assert kept[2] == {(i, t) for i, t in kept[1] if PASSAGE not in t}
    assert len(kept[3]) == len(kept[2]) and not any(any(secrets_in(t)) for _, t in kept[3])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in out.collect()}
    assert got == {(i, tuple(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept[3]}
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
