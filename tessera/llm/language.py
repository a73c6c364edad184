"""Language identification by error-correcting output codes.

Every language gets a codeword; for every bit a binary n-gram classifier tells the languages whose
codewords have it from the others.  A text's margins are decoded to the codeword of least weighted
loss, so that single wrong bits are outvoted, and a runner-up close by flags the text as ambiguous.

The classifiers are log odds of hashed byte n-grams of letters.  Their counts come from a bounded
sample of labelled rows, ``most_rows`` for each language, chosen by a hash; the table of counts has
at most languages x sizes x ``BUCKETS`` entries whatever the corpus holds.  Prediction is one pass
without a shuffle over every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices, with_columns
from tessera.session import unused

SIZES = (2, 3, 4)
BUCKETS = 1 << 15
UNKNOWN = "und"
#: Languages that a model may tell apart.
MOST_LANGUAGES = 256
#: Bytes of text whose n-grams are looked up at once.
WINDOW = 1 << 20
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all ways to halve the languages where few, else the best of random codes."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 6:
        rows = [[1 if 0 in side and i in side or 0 not in side and i not in side else -1 for i in range(n)] for size in range(1, n) for side in combinations(range(n), size) if 0 in side]
        return np.array(rows, np.float32).T
    rng, length = np.random.default_rng(n), int(np.ceil(10 * np.log2(n)))

    def apart(code: np.ndarray) -> tuple[bool, float]:
        between = code @ code.T
        np.fill_diagonal(between, -length)
        return bool((np.abs(code.sum(axis=0)) < n).all()), -float(between.max())

    return max((rng.choice(np.array([-1, 1], np.float32), (n, length)) for _ in range(200)), key=apart)


def grams(text: bytes) -> list[np.ndarray]:
    """Buckets of the n-grams of a text, for each size in order."""
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    out, value = [], x
    for n in range(2, max(SIZES) + 1):
        value = value[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        if n in SIZES:
            out.append(value * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def _prepared(text: str | None) -> bytes:
    """Lower case, other ASCII bytes than letters as spaces, and a space at either end."""
    return b" " + (text or "").lower().encode().translate(LETTERS) + b" "


def _windows(text: bytes):
    """Windows of a text whose n-grams, taken once each, are those of the whole."""
    overlap = max(SIZES) - 1
    for start in range(0, max(1, len(text) - overlap), WINDOW):
        part = text[start : start + WINDOW + overlap]
        yield part, min(WINDOW, len(part))


@dataclass
class Model:
    """What prediction needs: about ``len(SIZES) * BUCKETS * bits`` floats."""

    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # sizes x buckets x bits
    weight: np.ndarray  # bits

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for part, own in _windows(text):
            for odds, at in zip(self.odds, grams(part), strict=True):
                total += odds.take(at[:own], axis=0).sum(axis=0, dtype=np.float64)
                n += len(at[:own])
        return total / max(n, 1)

    def decide(self, text: bytes, gain: float) -> tuple[str, float, float]:
        """Language, its share of the belief, and its lead over the runner-up."""
        if not self.languages:
            return UNKNOWN, 0.0, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        loss = np.logaddexp(0, -self.code * (gain * self.margins(text))) @ self.weight
        belief = np.exp(loss.min() - loss)
        belief /= belief.sum()
        first, second = np.argsort(-belief, kind="stable")[:2]
        return self.languages[first], float(belief[first]), float(belief[first] - belief[second])


def fit(docs: DataFrame, label: str, text: str, order: F.Column, *, most_rows: int = 4000) -> Model:
    """Learn from at most about ``most_rows`` rows of each label, those whose ``order`` hashes low.

    Rows with a null label or text teach nothing.  Without labelled rows the model knows no
    language.  More than ``MOST_LANGUAGES`` labels are an error, never silently dropped.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text_of"), F.pmod(F.xxhash64(order), F.lit(1 << 30)).alias("place"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], codewords(0), np.zeros((len(SIZES), BUCKETS, 0), np.float32), np.zeros(0))
    limit = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, most_rows / n))))])
    sample = known.where(F.col("place") < limit[F.col("label")]).select("label", "text_of")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text_of"):
                for name, value in zip(part.column("label").to_pylist(), part.column("text_of").to_pylist(), strict=True):
                    table = sums.setdefault(name, np.zeros((len(SIZES), BUCKETS), np.int64))
                    for window, own in _windows(_prepared(value)):
                        for row, at in zip(table, grams(window), strict=True):
                            np.add.at(row, at[:own], 1)
        for name, table in sums.items():
            for k in range(len(SIZES)):
                at = np.flatnonzero(table[k])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at + k * BUCKETS), pa.array(table[k][at])], ["label", "bucket", "n"])

    counted = sample.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    tables = np.zeros((len(languages), len(SIZES) * BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    tables[[place[x] for x in counted.column("label").to_pylist()], counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return model(languages, tables.reshape(len(languages), len(SIZES), BUCKETS))


def model(languages: list[str], tables: np.ndarray) -> Model:
    """Binary classifiers from counts of languages x sizes x buckets."""
    code = codewords(len(languages))
    share = tables.sum(axis=0) + 0.5
    share /= share.sum(axis=-1, keepdims=True)
    smooth = 200.0
    given = (tables + smooth * share) / (tables.sum(axis=-1, keepdims=True) + smooth)
    odds = np.zeros((len(SIZES), BUCKETS, code.shape[1]), np.float32)
    weight = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        yes, no = given[code[:, b] > 0].mean(axis=0), given[code[:, b] < 0].mean(axis=0)
        odds[:, :, b] = np.log(yes) - np.log(no)
        weight[b] = ((yes - no) * odds[:, :, b]).sum()  # how far apart the two sides lie
    return Model(languages, code, odds, weight / weight.mean() if code.shape[1] else weight)


def predict(docs: DataFrame, known: Model, text: str = "text", *, gain: float = 6.0, lead: float = 0.2, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"), keep_text: bool = False) -> DataFrame:
    """Language of every whole text, beside the other columns of ``docs``.

    Adds the language, a score from 0 to 1, and whether the belief leads the runner-up's by less
    than ``lead``, under ``names``; the text itself goes unless ``keep_text``.  Null texts and texts
    without a letter are ``und`` with score 0 and count as ambiguous, and so is every text if no
    language was learnt.  Rows, repeated ones too, stay one for one; no column may have one of ``names``.
    """

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for x in part.column(text).to_pylist():
            rows.append(known.decide(_prepared(x), gain) if x and any(map(str.isalpha, x)) else (UNKNOWN, 0.0, 0.0))
        return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] < lead for r in rows], pa.bool_())]

    fields = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return with_columns(docs, text, compute, fields, keep_text=keep_text)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that teaches nothing; rows without an id are not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", *, lead: float = 0.02) -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letters, or two languages as likely.

    Learns from the rows outside the held-out fold.  All columns of the other rows stay.
    Null texts go, repeated rows stay or go together, and an empty table gives none.
    """
    known = fit(docs.where(~held_out(doc_id)), label, text, F.col(doc_id).cast("string"))
    names = tuple(unused(docs, "lang_pred", "score", "ambiguous"))
    return predict(docs, known, text, lead=lead, names=names, keep_text=True).where(~F.col(names[2])).select(*docs.columns)
