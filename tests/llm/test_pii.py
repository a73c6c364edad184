import hashlib
import random
import re

from tessera.llm import pii


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_plain_spans_match_the_patterns():
    rng = random.Random(1)
    bits = ["a", "b.c", "@", "@x", ".", "-", "_", "1", "12", "256", "4041894974608795", " ", "+", "+1 (988) 555-2485", "é", "10.0.0.1", "a@b.c", "%", "(", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert sorted(pii.plain(text)) == brute(text), text


def test_disguises_map_to_source_characters():
    cases = {
        "é mail joe.doe [at] mail [dot] example [dot] org now": ("email", "joe.doe [at] mail [dot] example [dot] org"),
        "write to joe at example dot com please": ("email", "joe at example dot com"),
        "cyrillic jое@ехаmрlе.соm here": ("email", "jое@ехаmрlе.соm"),
        "wide ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ!": ("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        "hidden jo​e@exam​ple.com": ("email", "jo​e@exam​ple.com"),
        "call plus one four one five five five five two six seven one ok": ("phone", "plus one four one five five five five two six seven one"),
        "host one nine two dot one six eight dot zero dot seven up": ("ip", "one nine two dot one six eight dot zero dot seven"),
        "card four zero four one eight nine four nine seven four six zero eight seven nine five.": ("card", "four zero four one eight nine four nine seven four six zero eight seven nine five"),
    }
    for text, (kind, piece) in cases.items():
        base = pii.plain(text)
        found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, base)]
        assert (kind, piece) in found and len(found) == 1, (text, found)


def test_disguised_addresses_stand_beside_their_plain_fragments():
    addresses = [
        "jаne.doe@example.com", "jane.doe@exаmple.com", "jane@example.cоm",
        "ja​ne.doe@example.com", "jane.doe@exa​mple.com", "jane.doe@example.c​om",
        "jane [dot] doe@example.com", "jane@mail [dot] example.com", "jane@mail.example [dot] com", "jane@example.co [dot] uk",
        "ｊane.doe@example.com", "jane.doe@example．com", "jane.doe@example.cｏm",
    ]
    for address in addresses:
        text = f"to {address} now"
        base = pii.plain(text)
        found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, base)]
        assert found == [("email", address)], (address, found)
    for text in ("jane@example.com [at] noon", "\u0430 jane@example.com 10.0.0.1"):
        assert pii.disguised(text, pii.plain(text)) == []


def test_the_prefilter_never_changes_a_result(monkeypatch):
    rng = random.Random(2)
    bits = [" arroba ", "mail.example", " klammeraffe ", "12", ". ", "eight", "acht", "Fünf", "UN", "fİve", "ſix", "8", "10", "256", "plus", " ", " ", " ", "-", ".", " dot ", " point ", " Punkt ", " punto ", " at ", "[at]", "( . )", "@", "joe", "com", "é", "x", "\n", "4041 8949 7460 879", " five"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(20000)]
    texts += [w.join([d] * 4) for d in ("eight", "acht", "8") for w in (" dot ", " point ", " punkt ", " punto ")]
    texts += ["card 4 0 4 1 8 9 4 9 7 4 6 0 8 7 9 five", "call plus 1 4 1 5 5 5 5 2 6 7 1", "8.8.8 point 8", "un point deux point trois point quatre"]
    got = [pii.disguised(x, pii.plain(x)) for x in texts]
    monkeypatch.setattr(pii, "CLUE", re.compile(""))
    assert got == [pii.disguised(x, pii.plain(x)) for x in texts]
    assert all(got[20000:])


def test_addresses_without_bounds():
    for address in (
        "j.a.n.e.x.y at example dot com", "first.last.a.b.c.d at example dot com", "jane at example.com", "jane at example dot pl", "jane arroba example punto com",
        "jane dot doe at example dot com", "jane klammeraffe example punkt de", "jeanne arobase exemple point fr", "jane [at] example dot com", "jane at a dot b dot c dot d dot e dot f dot g dot h dot i dot org",
        "a" * 200 + " at " + "b" * 200 + " dot " + "c" * 70 + " dot net", "ja\u200bne at exam\u200bple dot c\u200bom", "j\u0430ne dot doe at ex\u0430mple dot com", "x_1%y+z at sub-domain dot co dot uk",
    ):
        for before, after in (("", ""), ("write to ", " please"), ("(", ")"), ("to: ", ", or"), ("\u00e9 ", ".")):
            if before == "write to " and " dot " not in address and " punkt " not in address and " point " not in address and " punto " not in address:
                before = "mail "
            text = before + address + after
            found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, pii.plain(text)) if k == 0]
            assert found == [("email", address)], (text, found)
    text = "plus 49 151 2345 6789 zero"
    assert [text[a:b] for a, k, b in pii.disguised(text, []) if k == 3] == [text]


def test_planted_addresses_come_back_at_their_source():
    rng = random.Random(4)
    label = lambda more="": "".join(rng.choice("abcdefghij0189" + more) for _ in range(rng.choice([1, 3, 9, 80])))
    at = [" [at] ", "(at)", " at ", " arroba ", " {@} ", "@"]
    dot = [" [dot] ", "(dot)", " dot ", " punto ", ".", " ( . ) "]
    for _ in range(4000):
        signs = [rng.choice(dot) for _ in range(rng.randint(1, 9))]
        sign, local = rng.choice(at), rng.randint(0, len(signs) - 1)
        if all(x == "." for x in signs[local:]) and sign.strip().isalpha() or all(x == "." for x in signs) and sign == "@":
            sign = " [at] "
        labels = ["x" + label("_+") for _ in range(local + 1)], ["y" + label("-") for _ in range(len(signs) - local - 1)] + ["y", rng.choice(["com", "org", "pl", "se", "br"])]
        signs[local:local] = [sign]
        flat = [*labels[0], *labels[1]][: len(signs)] + [labels[1][-1]]
        address = "".join(a + b for a, b in zip(flat, signs)) + flat[-1]
        text = rng.choice(["", "(", "\u00e9; "]) + address + rng.choice(["", ")", "; ok", "\n"])
        found = [text[a:b] for a, k, b in pii.disguised(text, pii.plain(text)) if k == 0]
        assert address in found, (text, found)


def test_clean_prose_stays_clean():
    for text in ("", "Meet me at home (at noon). One or two dots.", "un deux trois", "two at a time, dot by dot", "Привет, как дела? Один два.", "[at] [dot]", "look at this dot", "Look at example.com", "see us at www.example.org or here", "arrive at 10.30", "He points at the dot is red", "at one point in time", "le point de vue", "un point. deux", "plus unique"):
        assert pii.plain(text) == [] and pii.disguised(text, []) == []


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a.b." * 80_000, "1.1." * 50_000, "+1" * 100_000, "@" * 200_000, "one " * 60_000, "a dot " * 40_000, "a at " * 40_000, "at dot " * 40_000, "x at dot " * 30_000, "x@a dot " * 30_000, "a. at " * 40_000):
        pii.disguised(text, pii.plain(text))


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a@b.cc and joe at example dot com", "z"), (3, "a@b.cc and joe at example dot com", "z"), (None, "10.0.0.1", None)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, Spans string"), ["doc_id"]).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in got if r["doc_id"] in (1, 2)] == [(i, 0, 0, 0, 0, empty, "", 0) for i in (1, 2)]
    same = [tuple(r) for r in got if r["doc_id"] == 3]
    assert same == [(3, 1, 0, 0, 0, hashlib.sha256(b"email:0:6").hexdigest(), "email:0:6,email:11:33", 1)] * 2
    assert [(r["n_ip"], r["spans"]) for r in got if r["doc_id"] is None] == [(1, "ip:0:8")]
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
