"""Byte-exact reading: digests, bounds, receipts and each fault of a line."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import strict

GOOD = b'{"a":1,"b":"\xc3\xa9"}\n{"a":2,"b":""}\n'


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("whole", [1 << 26, 0])
def test_receipts_digest_what_is_read(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(strict, "PIECE", 7)
    files = {"a.jsonl": GOOD, "sub/b.jsonl.gz": gzip.compress(GOOD) + gzip.compress(b"more"), "c.txt": b"no end", "empty": b"", "bad.gz": b"\x1f\x8bnot", "cut.gz": gzip.compress(GOOD)[:-9], "big.gz": gzip.compress(b"x" * 5000)}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["file"]: r for r in strict.receipts(spark, str(tmp_path), str(tmp_path), most_unpacked=1000, whole=whole).collect()}
    assert got.keys() == files.keys()
    for name, body in files.items():
        r = got[name]
        assert r["bytes"] == len(body)
        fault = {"bad.gz": "bad_gzip", "cut.gz": "bad_gzip", "big.gz": "unpacked_too_large"}.get(name)
        assert r["fault"] == fault
        inner = gzip.decompress(body) if name == "sub/b.jsonl.gz" else body
        if not fault:
            assert r["sha256"] == hashlib.sha256(body).hexdigest() and r["unpacked_sha256"] == hashlib.sha256(inner).hexdigest() and r["unpacked_bytes"] == len(inner)
            assert r["lines"] == len(inner.splitlines())


def test_root_receipt_and_check(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / name).write_text(name)
    found = strict.receipts(spark, str(tmp_path), str(tmp_path)).cache()
    lines = "".join(f"{hashlib.sha256(n.encode()).hexdigest()}  {n}\n" for n in "abc")
    assert rows(strict.root_receipt(found)) == [(3, hashlib.sha256(lines.encode()).hexdigest())]
    expected = found.where("file <> 'c'").select("file", F.when(F.col("file") == "a", 9).otherwise(F.col("bytes")).alias("bytes"), "sha256").unionByName(spark.createDataFrame([("gone", 1, "x")], "file string, bytes int, sha256 string"))
    assert rows(strict.checked(found, expected)) == [("a", "changed"), ("b", "same"), ("c", "extra"), ("gone", "missing")]
    docs = spark.createDataFrame([("10", "x"), ("9", "y"), ("100", "z")], "k string, h string")
    assert rows(strict.document_set_digest(docs, "k", "h")) == [(3, hashlib.sha256(b"9\ty\n10\tx\n100\tz\n").hexdigest())]


FAULTS = {
    b"": [(0, "empty_file")],
    b'{"a":1}': [(1, "no_final_line_end")],
    b'{"a":1}\n\n{"a":2}\n': [(1, None), (2, "blank_line"), (3, None)],
    b'{"a":1}\r\n': [(1, "carriage_return")],
    b'\xef\xbb\xbf{"a":1}\n{"a":1}\n': [(1, "byte_order_mark"), (2, None)],
    b'{"a":"\xff"}\n': [(1, "not_utf8")],
    b"{broken\n": [(1, "not_json")],
    b'{"a":NaN}\n': [(1, "not_json")],
    b"[1]\n": [(1, "not_an_object")],
    b'{"a": 1}\n': [(1, "not_canonical")],
    b'{"b":1,"a":2}\n': [(1, "not_canonical")],
    b'{"a":"\\u00e9"}\n': [(1, "not_canonical")],
    b'{"a":1,"a":1}\n': [(1, "repeated_key")],
    b'{"a":1,"c":2}\n': [(1, "other_fields")],
}


@pytest.mark.parametrize("whole", [1 << 26, 0])
def test_each_fault_names_its_line(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(strict, "PIECE", 5)
    monkeypatch.setattr(strict, "BATCH", 2)
    want = []
    for i, (body, found) in enumerate(FAULTS.items()):
        (tmp_path / f"{i:02}.jsonl").write_bytes(body)
        want += [(f"{i:02}.jsonl", n, fault) for n, fault in found]
    lines = strict.strict_lines(spark, str(tmp_path), fields=["a"], whole=whole)
    # Fields are looked at last, so other faults stand for themselves.
    assert rows(lines.select(F.element_at(F.split("path", "/"), -1), "line", "fault")) == sorted(want)
    assert strict.first_fault(lines).endswith("00.jsonl: line 0: empty_file")
    (tmp_path / "bom").mkdir()
    (tmp_path / "bom" / "x.jsonl").write_bytes(b'\xef\xbb\xbf{"a":1}\n')
    assert rows(strict.strict_jsonl(spark, str(tmp_path / "bom"), "a int", bom=True)) == [(1,)]


def test_rows_content_ids_and_gzip(spark, tmp_path):
    def line(value, prefix="id:"):
        value["id"] = prefix + hashlib.sha256(strict.canonical(value)).hexdigest()
        return strict.canonical(value) + b"\n"

    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(line({"n": 1}) + line({"n": 2, "t": "é"})))
    got = strict.strict_jsonl(spark, str(tmp_path), "n int, t string", right=strict.content_id("id", "id:"))
    assert rows(got.fillna("")) == [(1, ""), (2, "é")]
    (tmp_path / "b.jsonl").write_bytes(line({"n": 3}) + line({"n": 4}, "other:"))
    with pytest.raises(ValueError, match="b.jsonl: line 2: other_id"):
        strict.strict_jsonl(spark, str(tmp_path), "n int", right=strict.content_id("id", "id:"))
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(b'{"n":1}\n' * 1000))
    lines = strict.strict_lines(spark, str(tmp_path / "c.jsonl.gz"), most_unpacked=1000)
    assert rows(lines.where("fault is not null").select("fault")) == [("unpacked_too_large",)]


def test_canonical_is_sorted_and_bare():
    assert strict.canonical({"b": [1, {"é": None}], "a": 0.5}) == '{"a":0.5,"b":[1,{"é":null}]}'.encode() and json.loads(strict.canonical({"x": "\n"})) == {"x": "\n"}


def test_scan_of_a_writer_whose_first_task_is_empty(spark, tmp_path):
    from tessera import file_queries

    statuses = F.element_at(F.array(F.lit("O"), F.lit("F")), (F.col("id") % 2 + 1).cast("int"))
    spark.range(20000).select(F.col("id").alias("o_orderkey"), statuses.alias("o_orderstatus"), F.sha2(F.col("id").cast("string"), 256).alias("more")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")  # one row group, so most tasks have no rows
    try:
        got = file_queries.strict_scan(spark, str(tmp_path))
        assert got.count() == 20000 and got.where("fault = 'empty_file'").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
