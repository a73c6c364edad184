"""Registered queries against their SQL, or twice against themselves, on the smallest tables."""

import hashlib
import importlib.util
import math
import os
import re
import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the standard tables are not here")


def ordered(rows):
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", queries.SQL)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert ordered([tuple(r[c] for c in columns) for r in df.collect()]) == ordered(want)


def beside(name):
    """Another test module of this folder, for its brute force."""
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def spans(found, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()


def test_op4_equals_the_patterns(spark, documents):
    brute = beside("test_pii").brute
    for r in queries.op4_pii(spark, FOLDER).collect():
        found = brute(documents[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(k == i for _, k, _ in found) for i in range(4)]
        assert r["base_sha256"] == spans(found, ("email", "ip", "card", "phone"))


def test_op9_equals_the_patterns(spark, documents):
    kinds = ("assign", "access", "hex")
    patterns = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "AKIA[A-Z0-9]+", "[0-9a-f]+")
    fits = (lambda m: len(m[1]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16)
    for r in queries.op9_secrets(spark, FOLDER).collect():
        text = documents[r["doc_id"]] or ""
        found = [(m.start(), k, m.end()) for k in range(3) for m in re.finditer(patterns[k], text) if fits[k](m)]
        assert [r[f"n_{k}"] for k in kinds] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert r["base_sha256"] == spans(found, kinds)


def test_op7_equals_all_pairs(spark, documents):
    import xxhash

    prints = {}
    for i, text in documents.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {i: i for i in prints}
    for _ in prints:
        before = dict(least)
        for i in prints:
            least[i] = min(least[j] for j in prints if bin(prints[i] ^ prints[j]).count("1") <= 4)
        if least == before:
            break
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in prints}


def test_op10_equals_the_library(spark, documents):
    tok = bpe._tokenizer(queries.VOCABULARY)
    for r in queries.op10_bpe(spark, FOLDER).collect():
        ids = tok.encode(documents[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op11_equals_all_overlaps(spark, documents):
    import sentencepiece
    from tokenizers import Tokenizer

    other = beside("test_alignment")
    a = Tokenizer.from_file(queries.VOCABULARY)
    a.encode_special_tokens = True
    both = a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES), other.alignment.first_pieces(queries.VOCABULARY), other.alignment.second_pieces(queries.PIECES)
    short = {i: t for i, t in documents.items() if len(t or "") < 20_000}
    if len(short) < len(documents):
        pytest.skip("texts too long for all overlaps")
    want = other.Counter((i, *w) for i, w in zip(short, other.brute(list(short.values()), both), strict=True))
    assert other.result(queries.op11_alignment(spark, FOLDER)) == want


def test_op12_equals_the_recursion(spark, documents):
    other = beside("test_backoff")
    rows = [(i, t, zlib.crc32(str(i).encode()) % 10 != 0) for i, t in documents.items()]
    got = sorted(((False, r["doc_id"]), not r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in queries.op12_backoff(spark, FOLDER).collect())
    other.same(got, other.expected(rows, 2))


@pytest.mark.parametrize("name", ["op2_language", "op5_audio", "op6_multi_index"])
def test_reruns_agree(spark, name):
    first = ordered(queries.QUERIES[name](spark, FOLDER).collect())
    assert ordered(queries.QUERIES[name](spark, FOLDER).collect()) == first


def test_one_query_for_each_operator():
    found = __spark_entry__.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in found if k[:2] == "op" and k[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in found
