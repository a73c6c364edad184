import random

import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return bpe._tokenizer(PATH)


def texts():
    rng = random.Random(8)
    bits = ["the", " the", "'s", "'ll", " ", "  ", "\n", "\r\n", "\t", "x1", "12", "½²", "é", "ÀÇ", "ñ", "_", "-", "…", " ", "\x85", "\x1c", "\x00", "日本", "Ω", "ǅ", "😀", "́", "ɐ", "<|endoftext|>", "<|endof", "'S", "​", "　", "٣", "A" * 30]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return [None, "", " ", "\n\n", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", *out]


def test_split_is_the_tokenizers_own(tok):
    words, rare = bpe.splitter()
    for x in range(bpe.PLAIN_END):
        for text in (f"a{chr(x)}b1 {chr(x)}{chr(x)} c", f"{chr(x)} {chr(x)}1"):
            assert words.findall(text) == [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)], hex(x)


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_same_ids_and_texts_as_the_library(spark, tok, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    rows = [(i, t, "z") for i, t in enumerate(texts())] + [(None, "the end", None), (5, "the end", None), (5, "the end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Block string").repartition(3)
    got = [(r["doc_id"], r["tokens"], r["decoded"]) for r in bpe.round_trip(docs, ["doc_id"], PATH).collect()]
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, tok.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_words_are_encoded_once(tok):
    import pyarrow as pa

    calls = []

    class Counting:
        def encode_batch(self, words, **options):
            calls.extend(words)
            return tok.encode_batch(words, **options)

    real, bpe._tokenizer = bpe._tokenizer, lambda path: Counting()
    try:
        blob = bpe._pack_words([b"the", b" cat", "é".encode()])
        batch = pa.RecordBatch.from_pydict({"block": [1, 2, 3], "p": [0, 0, 0], "words": [blob, bpe._pack_words([b" cat"]), blob]})
        out = list(bpe._encode(PATH)([batch]))
    finally:
        bpe._tokenizer = real
    assert sorted(calls) == sorted(["the", " cat", "é"]) and len(out) == 3


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], PATH).count() == 0


def test_decoded_documents_come_in_small_batches():
    import numpy as np
    import pyarrow as pa

    at = bpe._pack(np.array([100_000] * 3), np.zeros(300_000, np.int64), np.zeros(1, np.int64))
    row = {"at": at, "parts": [{"p": 0, "ids": bpe._pack(np.array([2]), np.array([7, 9]))}], "pieces": [{"id": 7, "piece": b"a"}, {"id": 9, "piece": b"b"}], "id_0": [1, 2, 3]}
    out = list(bpe._assemble(1, ["doc_id"])([pa.RecordBatch.from_pylist([row])]))
    assert [b.num_rows for b in out] == [1, 1, 1]
    assert all(b.column("tokens")[0].as_py() == [7, 9] * 100_000 and b.column("decoded")[0].as_py() == "ab" * 100_000 for b in out)


def test_words_are_encoded_in_short_calls(monkeypatch):
    words, calls = [b"w%d" % i for i in range(10_000)], []

    class Recorder:
        def encode_batch(self, some, add_special_tokens):
            calls.append(len(some))
            return [type("Encoded", (), {"ids": [int(w[1:]), 50_000]}) for w in some]

    monkeypatch.setattr(bpe, "_tokenizer", lambda path: Recorder())
    batch = pa.RecordBatch.from_pylist([{"block": 1, "p": 0, "words": bpe._pack_words(words)}, {"block": 2, "p": 0, "words": bpe._pack_words(words[::-1])}])
    first, second = ([x.tolist() for x in bpe._unpack(r.column("ids")[0].as_py())] for r in bpe._encode("")(iter([batch])))
    assert max(calls) <= bpe.TOGETHER and sum(calls) == 10_000
    assert first == [[2] * 10_000, [x for i in range(10_000) for x in (i, 50_000)]]
    assert second == [[2] * 10_000, [x for i in reversed(range(10_000)) for x in (i, 50_000)]]
