"""Source divergence against a dense brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, most=200):
    times, within, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        times[lang, source].update(terms)
        within[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in within[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        counts = {s: times[lang, s] for s in own}
        whole = Counter({t: sum(counts[s][t] for s in own) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(counts[s]) for s in own}, share(whole)
        for s in own:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, most)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "été", "É", "日本", "a1b", "don't", "x\x00y", "z" * 300, "ab", "Ab", "ß", "q", "\x7f", "ﬁ"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(rng.choice([None, i]), rng.choice([None, "", " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randint(0, 40)))]) if rng.random() < 0.9 else "7 8", rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "s3", None])) for i in range(n)]


@pytest.mark.parametrize("broadcast", [10_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    rows = corpus(120, seed)
    rows += rows[:15]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS Size", "3 AS n").repartition(3)
    assert result(divergence.divergence(docs)) == brute(rows)


def test_only_the_first_terms_are_ranked(spark):
    rows = [(i, " ".join(f"t{'abcdefghij'[a]}{'abcdefghij'[b]}" for a in range(10) for b in range(3)), "en", "s1") for i in range(3)] + [(9, "x", "en", "s2")]
    got = result(divergence.divergence(spark.createDataFrame(rows, SCHEMA), most_terms=7))
    assert got == brute(rows, most=7) and sum(r[2] == "term" and r[1] == "s1" for r in got) <= 7


def test_languages_without_terms_and_empty_tables(spark):
    rows = [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "", None, None)]
    got = result(divergence.divergence(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert result(divergence.divergence(spark.createDataFrame([], SCHEMA))) == []


def test_counts_past_64_bits(spark):
    row = spark.range(1).selectExpr(f"{divergence._share('40000000000L', '50000000000L', '7L')} AS p").first()
    assert row["p"] == 1 + 10**9 * 40000000001 // 50000000007
