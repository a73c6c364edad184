import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = {i: slow_print(t) for i, t in rows}
    best, changed = {i: i for i in prints}, True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and best[b] < best[a]:
                    best[a], changed = best[b], True
    return {i: (format(prints[i], "016x"), best[i]) for i in prints}


def texts():
    rng = random.Random(3)
    words = [f"w{i}É" for i in range(400)]
    out = [None, "", " \t\n", "one", "ONE", "a b c", "a b c d", "a b  c\x0bd", "x y z"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for k in range(5):
            copy = base[:]
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return list(enumerate(out, 10))


def test_fingerprints_and_components_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, print string, Key int").repartition(3)
    got = simhash.near_duplicates(docs, ["doc_id"]).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (format(r["print"] & (1 << 64) - 1, "016x"), r["component"]) for r in got} == brute(rows)


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    near = [int(centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))) for _ in range(120)]
    far = rng.integers(0, 1 << 63, 200).tolist()
    prints = list(dict.fromkeys(near + far))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), tile=10).collect()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = (int(np.array([x], np.int64).view(np.uint64)[0]) for x in r)
        root[find(a)] = find(b)
    want = {p: p for p in prints}
    for _ in range(70):
        for i, a in enumerate(prints):
            for b in prints[:i]:
                if (a ^ b).bit_count() <= 4:
                    want[a] = want[b] = min(want[a], want[b])
    assert len({find(p) for p in prints}) == len(set(want.values()))
    assert all((find(a) == find(b)) == (want[a] == want[b]) for a in prints[:60] for b in prints)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    prints[70:] = prints[:80] ^ np.uint64(0b1011001)
    got = simhash.within(simhash._planes(prints), len(prints), prints[:64], radius)
    assert (got == (np.bitwise_count(prints[None, :] ^ prints[:64, None]) <= radius)).all()


def test_long_texts_are_cut_between_words():
    text = " ".join(f"word{i % 977}" for i in range(700_000))
    assert len(text) > 4 << 20
    short = simhash._pieces
    try:
        simhash._pieces = lambda t: iter([t])
        whole = simhash.fingerprint(text.encode())
    finally:
        simhash._pieces = short
    assert simhash.fingerprint(text.encode()) == whole


def test_one_row_of_each_component_stays(spark):
    rows = [(3, "a b c d e", "p"), (1, "a b c d e", "q"), (1, "a b c d e", "r"), (None, "a b c d e", "s"), (7, "other words are here now", "t"), (None, "nobody names these rows ever", "u")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, component string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:6]) for r in got) == [(0, "nobody"), (1, "a b c "), (7, "other ")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty, ["doc_id"]).count() == 0
    assert simhash.representatives(empty).count() == 0
