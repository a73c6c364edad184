"""Alignment of two tokenizers against whole encodings and all overlapping byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND), alignment.first_pieces(FIRST), alignment.second_pieces(SECOND)


def brute(texts, both):
    a, b, a_bytes, b_bytes = both
    rows, counts = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(a_bytes[i] for i in x) != whole or b"".join(b_bytes[i] for i in y) != whole:
            x, y = [], []
        spans = []
        for ids, pieces in ((x, a_bytes), (y, b_bytes)):
            ends = [0]
            for i in ids:
                ends.append(ends[-1] + len(pieces[i]))
            spans.append(list(zip(ids, ends, ends[1:])))
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        groups = ";".join("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in spans) for low, high in zip([0, *cuts], cuts))
        counts.update(links)
        rows.append((x, y, cuts, links, groups))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(len(x), len(y), len(cuts), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(groups.encode()).hexdigest() if x else "") for x, y, cuts, links, groups in rows]


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["the", " the", "'s", " ", "  ", "   ", "\n", "\n ", "\r\n", "\t", "\t ", "x1", "1234", "½²", "é", "ÀÇ", "ñ", "_", "…", "  ", "\x85", "\x1c ", "\x00", "日本", " 日本語", "Ω", "😀", "́", " ́", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "​", "　", "A" * 30, "-" * 9, "internationalization", ". ", ", and", "ﬁ"]
    return [None, "", " ", "  ", "a ", " a", "a  ", "▁", "\n", *["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]]


def result(df):
    return Counter((r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


@pytest.mark.parametrize("head, together, remembered, short", [(1 << 20, 2048, 1 << 20, 64), (50, 3, 100, 6), (0, 1, 0, 0)])
def test_equals_all_overlaps_of_whole_encodings(spark, both, monkeypatch, head, together, remembered, short):
    monkeypatch.setattr(alignment, "SHORT", short)
    monkeypatch.setattr(alignment, "HEAD_PAIRS", head)
    monkeypatch.setattr(alignment, "TOGETHER", together)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 700)
    rows = list(enumerate(texts(250, 5)))
    rows += [(None, "the end"), (7, "the end"), (7, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS Links", "2 AS n_a").repartition(3)
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], both), strict=True))
    assert result(alignment.alignment(docs, ["doc_id"], FIRST, SECOND)) == want


def test_long_texts(spark, both):
    rng = random.Random(1)
    words = "the quick brown internationalization über 日本語 don't 12345 x_y".split()
    text = " ".join(rng.choices(words, k=300_000))
    a, b, a_bytes, b_bytes = both
    got = alignment.alignment(spark.createDataFrame([(1, text), (2, "x" * 200_000)], "doc_id long, text string"), ["doc_id"], FIRST, SECOND)
    found = {r["doc_id"]: r for r in got.collect()}
    for i, t in ((1, text), (2, "x" * 200_000)):
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        assert (found[i]["n_a"], found[i]["n_b"]) == (len(x), len(y))
        ends = []
        for ids, pieces in ((x, a_bytes), (y, b_bytes)):
            at, own = 0, []
            for k in ids:
                at += len(pieces[k])
                own.append(at)
            ends.append(own)
        cuts = set(ends[0]) & set(ends[1])
        assert found[i]["n_groups"] == len(cuts)
        assert found[i]["n_links"] == len(x) + len(y) - len(cuts)
        sides = []
        for ids, own in zip((x, y), ends):
            groups, open_ = [], []
            for k, e in zip(ids, own):
                open_.append(str(k))
                if e in cuts:
                    groups.append(",".join(open_))
                    open_ = []
            sides.append(groups)
        assert found[i]["groups_sha256"] == hashlib.sha256(";".join(map("|".join, zip(*sides))).encode()).hexdigest()


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], FIRST, SECOND).count() == 0


def test_pieces_whose_tokens_end_in_the_same_order_are_aligned_once(spark, both):
    rng = random.Random(3)
    words = ["".join(rng.choices("aeinrstlo", k=rng.randint(3, 12))) for _ in range(2000)]
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    (block,) = alignment.tokenised(docs, ["doc_id"], FIRST, SECOND).collect()
    shapes = [(tuple(s["a_end"]), tuple(s["b_end"])) for s in block["shapes"]]
    assert len(set(shapes)) == len(shapes) < 0.1 * len(block["pieces"])
    assert all(sorted({*a, *b}) == [*range(1, a[-1] + 1)] and a[-1] == b[-1] for a, b in shapes)
    for p in block["pieces"]:
        a, b = shapes[p["shape"]]
        ends = []
        for ids, pieces in ((p["a"], both[2]), (p["b"], both[3])):
            ends.append([sum(len(pieces[i]) for i in ids[: k + 1]) for k in range(len(ids))])
        order = sorted({*ends[0], *ends[1]})
        assert [tuple(order.index(e) + 1 for e in own) for own in ends] == [a, b]
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], both), strict=True))
    assert result(alignment.alignment(docs, ["doc_id"], FIRST, SECOND)) == want
