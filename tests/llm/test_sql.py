"""The SQL of the operators' queries against the operators, on fixtures with nulls, repeats, long texts and planted findings."""

import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest

from tarnrank.llm import license_scan, queries, secret_scan, token_count

from .test_operators import ADDED, CLEAN, TEXTS, key, prose, rows_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def edited(seed):
    """Each license template with up to three words changed."""
    r, out = random.Random(seed), []
    for _, t in license_scan.TEMPLATES:
        for edits in range(4):
            words = t.split()
            for at in r.sample(range(len(words)), min(edits, len(words))):
                words[at] = "changed"
            out.append(prose(r.randrange(40)) + " " + " ".join(words) + " " + prose(r.randrange(40)))
    return out


@pytest.fixture(scope="module")
def rows():
    found = [v for _, v in ADDED] + CLEAN + ["eyJ" + "Q" * 20 + ".eyJ" + "R" * 9 + "." + "S_" * 9]
    joined = [" ".join(found), "".join(found), "_".join(found), "ghp_" + "a" * 36 + "-ghp_" + "b" * 36 + "_ghp_" + "c" * 36, "toKen=abcdefgh12 paſsword=abcdefgh12", 'a "api-key": "x" API_KEY="abcdefgh" token\n=abcdefgh']
    texts = [f"é\U0001f600 {v} , then" for v in found] + joined + edited(11) + ["языковедение 中国人民共和国 한국어\x0bx\x0cy", "\x1c   z"]
    # the vocabulary's SQL takes a step a piece: the longest words are left to the operators' own tests
    return [(i, t) for i, t in TEXTS if max(map(len, (t or "").split()), default=0) <= 1_000] + list(enumerate([t for t in texts if max(map(len, t.split()), default=0) <= 1_000], 1000))


@pytest.fixture(scope="module")
def tables(rows):
    con = duckdb.connect(config={"memory_limit": "4GB", "max_temp_directory_size": "1GB"})
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    return con


@pytest.mark.parametrize("name", ["op5_secret_scan", "op7_token_count", "op10_license_scan"])
def test_sql_gives_the_operators_rows(spark, rows, tables, tmp_path, name):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()[name](spark, str(tmp_path))
    want = tables.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(rows_of(got.select(*columns)), key=key) == sorted(want.fetchall(), key=key)


def test_planted_secrets_are_in_the_sql_too(tables):
    spans = [r[0] for r in tables.execute(f"select spans from ({queries.oracle_sql()['op5_secret_scan']})").fetchall()]
    assert {s.split(":")[0] for row in spans if row for s in row.split(",")} == {r.name for r in secret_scan.RULES}


def test_words_of_a_long_text_are_counted_alike(tables):
    starts, rest = token_count.pieces_of_ranks(open(RANKS, "rb").read())
    automaton = token_count.Automaton(starts, rest)
    sql = tables.execute(queries.oracle_sql()["op7_token_count"])
    names = [c[0] for c in sql.description]
    got = {r[names.index("doc_id")]: r[names.index("n_tokens")] for r in sql.fetchall()}
    assert got[4] == sum(max(1, automaton.count(w)) for w in dict(TEXTS)[4].encode().split())
