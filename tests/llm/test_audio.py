import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import audio, queries


def slow_resample(x):
    """Zero-stuffing, filtering with the whole filter, then dropping samples."""
    n = np.arange(-audio.UP * audio.TAPS // 2, audio.UP * audio.TAPS // 2)
    width = max(audio.UP, audio.DOWN)
    h = np.sinc(n / width) * np.hamming(len(n)) * audio.UP / width
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    full = np.convolve(stuffed, h)[-n[0] :]
    return np.concatenate((full, np.zeros(100)))[: -(-len(x) * audio.UP // audio.DOWN) * audio.DOWN : audio.DOWN]


def test_resampling_is_filtering_and_dropping():
    rng = np.random.default_rng(1)
    for size in (192, 193, 1000, 4801):
        samples = rng.integers(0, 256, size).astype(np.uint8)
        got, want = audio.resample(samples.tobytes()), slow_resample((samples - 128.0) / 128)
        assert len(got) == -(-size * audio.UP // audio.DOWN)
        assert np.allclose(got, want[: len(got)], atol=1e-9)


def test_frames_in_pieces_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    samples = rng.integers(0, 256, 192 * 60).astype(np.uint8)
    y = slow_resample((samples - 128.0) / 128)[: len(samples) * 3 // 4]
    monkeypatch.setattr(audio, "PIECE", 64)
    mels, energy = audio.log_mel(samples.tobytes())
    top = audio.RATE * 3 / 4 / 2
    points = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), audio.MELS + 2) / 2595) - 1)
    y = np.concatenate((y, np.zeros(audio.FRAME)))
    for i in range(len(mels)):
        frame = y[i * audio.HOP : i * audio.HOP + audio.FRAME]
        frame = frame - frame.mean()
        assert abs(energy[i] - 10 * np.log10((frame**2).mean() + 1e-9)) < 1e-6
        shaped = frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1)))
        bins = np.arange(audio.FFT // 2 + 1)
        power = np.array([abs((shaped * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FFT)).sum()) ** 2 for k in bins]) if i % 9 == 0 else None
        if power is not None:
            for b in range(audio.MELS):
                low, mid, high = points[b : b + 3]
                hz = bins * top / (audio.FFT // 2)
                weight = np.clip(np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid)), 0, None)
                assert abs(mels[i, b] - np.log((power * weight).sum() + 1e-6)) < 1e-3


def test_null_and_long_media(spark):
    media = spark.createDataFrame([(1, None), (2, audio.to_wav(b""))], "doc_id long, media binary")
    one, two = sorted(audio.tensor_features(media).collect())
    assert one["payload_bytes"] == two["payload_bytes"] == 0 and one["feature"] == two["feature"] and one["media_bytes"] == 0
    assert audio.audio_tensors(media, ["doc_id"]).count() == 2 and audio.audio_features(media).count() == 2
    assert one["feature"].startswith("frames=1;tensors=1;")


def test_wav_is_read_by_the_wave_module():
    import io
    import wave

    with wave.open(io.BytesIO(audio.to_wav(bytes(range(200)))), "rb") as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(999)) == (1, 1, audio.RATE, bytes(range(200)))


def test_memory_of_a_long_clip():
    import tracemalloc

    samples = b"some words of it " * (1 << 20)
    tracemalloc.start()
    energy, pieces = audio.heard(samples)
    assert sum(map(len, pieces)) == len(energy) and audio.segments(energy) is not None
    assert tracemalloc.get_traced_memory()[1] < len(samples) + (64 << 20)
    tracemalloc.stop()


def test_tone_lands_in_its_band():
    rate = audio.RATE
    x = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(rate) / rate)).astype(np.uint8).tobytes()
    mels, _ = audio.log_mel(x)
    top = audio.RATE * audio.UP / audio.DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), audio.MELS + 2) / 2595) - 1)
    band = int(mels.mean(axis=0).argmax())
    assert edges[band] <= 1000 <= edges[band + 2]


def test_hysteresis():
    level = np.array([0, 0, 5, 0.5, -0.5, 0, -3, 0, 0.9, 2, -2, 0, 0, 0, 0, 0, 0.0])
    state, want, runs = False, [], []
    for i, x in enumerate(level - np.median(level)):
        state = x >= audio.ON_DB or state and x >= audio.OFF_DB
        want.append(state)
    for i, on in enumerate([*want, False]):
        if on and (not i or not want[i - 1]):
            runs.append(i)
        elif not on and i and want[i - 1]:
            runs[-1] = (runs[-1], i)
    assert audio.segments(level) == runs == [(2, 6), (9, 10)]


def test_rows(spark):
    texts = [None, "", "a", "é" * 96, "b" * 193, "word " * 9000, "word " * 9000]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, Media string").repartition(3)
    got = {r["doc_id"]: r.asDict() for r in audio.audio_features(audio.store_media(docs, ["doc_id"])).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b" " * (192 * max(1, -(-len(data) // 192)) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        stored = audio.to_wav(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[0] | {"doc_id": 1} == got[1] and got[5] | {"doc_id": 6} == got[6]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert audio.audio_features(audio.store_media(empty, ["doc_id"])).count() == 0


def test_stored_tensors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words " * 3000), (2, "")], "doc_id long, text string")
    rows = audio.audio_tensors(audio.store_media(docs, ["doc_id"]), ["doc_id"])
    rows.write.parquet(str(tmp_path / "t"))
    table = audio.as_tensors(spark.read.parquet(str(tmp_path / "t")).orderBy("doc_id", "window").toArrow())
    kind = table.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.TENSOR_FRAMES, audio.MELS]
    mels, energy = audio.log_mel(audio.payload(b"some words " * 3000))
    mine = table.filter(pa.compute.equal(table["doc_id"], 1))
    assert mine.num_rows == -(-len(mels) // audio.TENSOR_FRAMES)
    flat = np.concatenate([x.to_numpy() for x in mine["tensor"].combine_chunks()])[: len(mels)]
    assert np.array_equal(flat, mels)
    assert sum(len(s) for s in mine["segments"].to_pylist()) == len(audio.segments(energy))
    ends = mine["end_ms"].to_pylist()
    assert mine["start_ms"].to_pylist()[1:] == ends[:-1]


def test_every_sample_is_in_a_frame():
    for units in range(1, 12):
        mels, energy = audio.log_mel(b"\x80" * (audio.UNIT * units - 32) + b"\xff" * 32)
        size = audio.UNIT * units * audio.UP // audio.DOWN
        assert len(mels) == len(energy) == 1 + max(0, -(-(size - audio.FRAME) // audio.HOP))
        assert energy[-1] > -40  # the sound at the very end is heard


def test_features_come_from_the_tensors(spark):
    texts = [None, "", "word " * 9000, "word " * 9000, "loud ~~~~ " * 50 + " " * 9000 + "~z" * 700, "a" * 577, "x" * 8192 * 3]
    docs = spark.createDataFrame([(min(i, 5), t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string").repartition(3)
    media = audio.store_media(docs, ["doc_id"]).cache()
    old = {(r["doc_id"], r["payload_sha256"]): r.asDict() for r in audio.audio_features(media).collect()}
    got = audio.tensor_features(media).collect()
    assert len(got) == len(texts) + 1 and set(old) == {(r["doc_id"], r["payload_sha256"]) for r in got}
    rows = {}
    for r in audio.audio_tensors(media.withColumn("sha", F.sha2("media", 256)), ["doc_id", "sha"]).collect():
        rows.setdefault((r["doc_id"], r["sha"]), []).append(r)
    for r in got:
        was, mine = old[r["doc_id"], r["payload_sha256"]], rows[r["doc_id"], r["media_sha256"]]
        assert {k: v for k, v in r.asDict().items() if k != "feature"} == {k: v for k, v in was.items() if k != "feature"}
        new, before = (dict(x.split("=") for x in f.split(";")) for f in (r["feature"], was["feature"]))
        assert new["span"] == f"0-{max(x['end_ms'] for x in mine)}" and len(new["digest"]) == 16
        assert int(new["tensors"]) == len(mine) and int(new["segments"]) == sum(len(x["segments"]) for x in mine)
        assert {k: new[k] for k in ("frames", "tensors", "segments", "ms")} == {k: before[k] for k in ("frames", "tensors", "segments", "ms")}
        assert np.allclose([float(x) for x in new["mel"].split(",")], [float(x) for x in before["mel"].split(",")], atol=2e-3)
    again = audio.tensor_features(media.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_registered_query_gives_digests_of_its_tensors(spark, tmp_path):
    spark.createDataFrame([(1, "some words " * 3000), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all(";digest=" in r["feature"] for r in queries.op5_audio(spark, str(tmp_path)).collect())
