import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import secrets


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_plain_spans_match_the_patterns():
    rng = random.Random(2)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "toKen", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH01234567", "x", "é", "Z9/+", "deadbeef"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert sorted(secrets.candidates(text)[0]) == brute(text), text


def digest(spans):
    return hashlib.sha256(spans.encode()).hexdigest()


ROWS = [
    (1, "a password=hunter2hunter2 z", "src1"),
    (2, "a password=hunter2hunter2 z", "src2"),
    (3, "a password=hunter2hunter2 z", None),
    (4, "é passphrase: onlymine-onlymine password=mine0mine0mine0 end", "src1"),
    (4, "é passphrase: onlymine-onlymine password=mine0mine0mine0 end", "src1"),
    (5, None, "src1"),
    (6, "", None),
    (None, "secret=deadbeefdeadbeef0", "src9"),
]
SCHEMA = "doc_id long, text string, source string, n_chars long, Found string"


def test_verdict_by_owners(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "f") for r in ROWS], SCHEMA).repartition(3)
    got = sorted((r["doc_id"] or 0, r["spans"], r["live"], r["n_live"], r["n_example"], r["base_sha256"] == digest("assign:2:25")) for r in secrets.secrets(docs, ["doc_id"]).collect())
    mine = (4, "assign:2:31,assign:32:56", "assign:2:31,assign:32:56", 2, 0, False)
    example = [(i, "assign:2:25", "", 0, 1, True) for i in (1, 2, 3)]
    assert got == [(0, "assign:0:24,hex:7:24", "assign:0:24,hex:7:24", 2, 0, False), *example, mine, mine, (5, "", "", 0, 0, False), (6, "", "", 0, 0, False)]


def test_live_secrets_are_replaced(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "f") for r in ROWS], SCHEMA).repartition(3)
    got = secrets.redacted(docs)
    assert got.columns == docs.columns
    rows = {(r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()}
    assert (1, ROWS[0][1], 27) in rows and (5, None, 0) in rows and (6, "", 0) in rows
    assert (4, "é [SECRET] [SECRET] end", 23) in rows and (None, "[SECRET]", 8) in rows
    assert got.count() == len(ROWS)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.secrets(empty, ["doc_id"]).count() == 0 and secrets.redacted(empty).count() == 0


def test_prefilter_passes_every_candidate(spark):
    import random

    rng = random.Random(9)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "pwd", "private_key", "AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "=", ":", '"', " ", "0123456789abcdef", "ABCDEFGH0123456789", "x", "longvalue12345678", "\u017f", "\u212a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", secrets.may_hold(F.col("t")).alias("may"))
    may = {r["i"]: r["may"] for r in df.collect()}
    hits = [i for i, t in enumerate(texts) if secrets.candidates(t)[1]]
    assert len(hits) > 500 and all(may[i] for i in hits) and not all(may.values())


def test_redaction_of_odd_rows(spark):
    long = "word " * 50_000 + " ".join(f"password=secretvalue{i:06d}" for i in range(300))
    rows = [(1, "token=abcdefghijkl9 end", "s", 5, "x"), (1, "token=abcdefghijkl9 end", "s", 5, "x"), (2, None, None, None, "y"), (3, "", "s", 0, "z"), (4, long, "s", 1, "w"), (None, "secret: qwertyuiop12", "t", 7, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, Row_Of string")
    got = secrets.redacted(docs).collect()
    assert got[0].__fields__ == docs.columns and len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["text"] for r in by_id[1]] == ["[SECRET] end"] * 2 and by_id[2][0]["text"] is None and by_id[3][0]["text"] == ""
    assert by_id[4][0]["text"] == "word " * 50_000 + " ".join(["[SECRET]"] * 300) and by_id[4][0]["n_chars"] == len(by_id[4][0]["text"])
    assert by_id[None][0]["text"] == "[SECRET]" and secrets.redacted(docs.limit(0)).count() == 0
