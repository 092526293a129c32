"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A text's features are its words hashed into `WORDS` buckets (share of the text each), statistics of its structure and
its length. The score is sigmoid(b + <w, x> + 1/2 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise
interactions of all features, in time linear in the features.

The model is fitted on at most `max_rows` labelled rows (a documented bound), those with the smallest hashes of doc_id;
every row is scored. Of a repeated id, the text with the least hash is learned. Labels, language, source and doc_id are no inputs of a score.

Defined results: null text is scored like an empty one. A document that is labelled twice counts once for each label row.
With labels of one class only, or none, the model is the class rate (1.0 where there is none, so nothing is rejected).
A null id is scored and held out. Extra columns are ignored by `scores` and kept by `keep_good`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import DigestCache, ship, spare_names

WORDS, RANK, MAX_ROWS = 1024, 6, 8192
THRESHOLD = 0.7
_PLAIN = frozenset(b".,;:?)\"'")

#: What one word adds to the statistics.
_WORD = np.dtype([("bucket", "<u2"), ("length", "<u2"), ("flags", "u1"), ("id", "<u4")])
_SYMBOL, _LONE, _UPPER, _DIGIT, _STOP = 1, 2, 4, 8, 16
STATS = 18


def _describe(word: bytes) -> bytes:
    text = word.decode("utf-8", "replace")
    letters = [c for c in text if c.isalpha()]
    tail = text[-1:]
    flags = _SYMBOL * (bool(tail) and not tail.isalnum() and ord(tail) not in _PLAIN)
    flags |= _LONE * (not letters and not any(c.isdigit() for c in text))
    flags |= _UPPER * (len(letters) > 1 and all(c.isupper() for c in letters))
    flags |= _DIGIT * any(c.isdigit() for c in text)
    flags |= _STOP * (tail in ".!?")
    h = xxhash.xxh64_intdigest(word, 7)
    return np.array([(h % WORDS, min(len(text), 65535), flags, h >> 32)], _WORD).tobytes()


_words = DigestCache(_describe)


def features(text: str | None) -> np.ndarray:
    """WORDS shares of hashed words, then STATS statistics, all near [0, 1]."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    out = np.zeros(WORDS + STATS, np.float32)
    n = len(words)
    if not n:
        out[WORDS] = 1
        return out
    w = np.frombuffer(b"".join(map(_words.__getitem__, words)), _WORD)
    counts = np.bincount(w["bucket"], minlength=WORDS)
    norm = np.sqrt(np.square(counts, dtype=np.float64).sum())
    out[:WORDS] = counts / norm
    ids, flags, length = w["id"], w["flags"], w["length"].astype(np.float64)
    distinct, times = np.unique(ids, return_counts=True)
    pairs = ids[1:].astype(np.uint64) << np.uint64(32) | ids[:-1]
    lines = text.split("\n")
    share = [float(np.count_nonzero(flags & f)) / n for f in (_SYMBOL, _LONE, _UPPER, _DIGIT, _STOP)]
    out[WORDS + 1 :] = [
        *share,
        len(distinct) / n,
        times.max() / n if n > 3 else 0,
        len(np.unique(pairs)) / max(1, n - 1),
        float(np.count_nonzero(ids[1:] == ids[:-1])) / max(1, n - 1),
        min(1.0, length.mean() / 12),
        min(1.0, length.std() / 8),
        min(1.0, np.log1p(n) / 10),
        min(1.0, np.log1p(len(text)) / 12),
        min(1.0, len(lines) / n),
        len(set(lines)) / len(lines),
        min(1.0, len({x[-8:] for x in lines if x}) / len(lines)),
        float(n < 5),
    ]
    return out


class FactorisationMachine:
    """Binary classification, second order; fitted with Adam on dense rows."""

    def __init__(self, width: int, rank: int = RANK, seed: int = 11):
        self.bias, self.w = 0.0, np.zeros(width)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (width, rank))

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * (np.square(s) - np.square(x) @ np.square(self.v)).sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.02, decay: float = 1e-5) -> FactorisationMachine:
        rng = np.random.default_rng(5)
        params = [np.array([self.bias]), self.w, self.v]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5  # classes half way to balance
        step = 0
        for epoch in range(epochs):
            order, lr = rng.permutation(len(y)), rate * (1 - epoch / epochs)
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                xb = x[i].astype(np.float64)
                g = (self.predict(xb) - y[i]) * weight[i] / len(i)
                sums = xb @ self.v
                grads = [np.array([g.sum()]), xb.T @ g + decay * self.w, xb.T @ (g[:, None] * sums) - (np.square(xb).T @ g)[:, None] * self.v + decay * self.v]
                step += 1
                for k, (p, d) in enumerate(zip(params, grads, strict=True)):
                    m[k] += 0.1 * (d - m[k])
                    s[k] += 0.001 * (d * d - s[k])
                    p -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                self.bias = float(params[0][0])
        return self


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [features(t.as_py()).astype("<f4").tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorisationMachine | float:
    """Fit on at most max_rows labelled rows that are not held out; a float is the rate of a single class."""
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    sample = F.broadcast(sample)  # at most max_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id", "left_semi")
    # of a repeated id, the text with the least hash
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("doc_id", F.col("least.text").alias("text"))
    rows = texts.join(sample, "doc_id").mapInArrow(_featurise, "doc_id long, quality int, x binary").collect()  # at most max_rows
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], zlib.crc32(r["x"])))
    y = np.array([r["quality"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 1.0
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in rows])
    return FactorisationMachine(x.shape[1]).fit(x, y)


def scorer(model: FactorisationMachine | float):
    """A pandas UDF text -> score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series(np.full(len(texts), model))
        out = [np.empty(0)]
        for at in range(0, len(texts), 256):
            out.append(model.predict(np.stack([features(t) for t in texts.iloc[at : at + 256]]).astype(np.float64)))
        return pd.Series(np.concatenate(out))

    return score


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score >= 0.7)."""
    score = scorer(train(docs, labels, max_rows))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs whose score reaches the threshold; columns unchanged."""
    score = scorer(train(docs, labels, max_rows))
    (name,) = spare_names(docs, "_score")
    return docs.withColumn(name, score("text")).filter(F.col(name) >= THRESHOLD).drop(name)
