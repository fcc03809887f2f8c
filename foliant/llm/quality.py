"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import cut, ship

#: Rows that training takes at most: trusted positives and unlabelled texts, the first by a hash of id and text.
POSITIVES, UNLABELLED = 8_000, 16_000
FOLDS, THRESHOLD = 5, 0.3

# Kinds of bytes: 0 blank, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 full stop, 6 comma,
# 7 other sentence marks, 8 brackets and quotes, 9 | and other separators, 10 symbols, 11 beyond ASCII.
_KIND = np.full(256, 11, np.int64)
_KIND[:128] = 10
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[10] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
for _k, _chars in ((5, "."), (6, ","), (7, "!?;:"), (8, "()[]{}\"'<>"), (9, "|/\\_-=")):
    _KIND[[ord(c) for c in _chars]] = _k
_KINDS, MEASURES = 12, 10
#: Places over which words and pairs of neighbouring words are hashed.
WORD_PLACES = 256
WIDTH = _KINDS * _KINDS + WORD_PLACES + MEASURES
#: Decay of each weight: that of words is strong, as they are many and would learn single texts by heart.
DECAY = np.full(WIDTH, 1e-3)
DECAY[_KINDS * _KINDS : -MEASURES] = 1.0


def features(text: str | None) -> np.ndarray:
    """Of one whole text: roots of the shares of pairs of byte kinds and of hashed words and word pairs, and ten measures of length and repetition. Null counts as empty."""
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    kinds = _KIND[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=_KINDS * _KINDS)
    out[: _KINDS * _KINDS] = np.sqrt(pairs / max(1, len(raw) - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    grams = np.concatenate((hashed, hashed[:-1] * np.uint32(31) + hashed[1:] * np.uint32(2654435761))) >> np.uint32(7)
    out[_KINDS * _KINDS : -MEASURES] = np.sqrt(np.bincount(grams % WORD_PLACES, minlength=WORD_PLACES) / max(1, len(grams)))
    out[-MEASURES:] = (
        np.log1p(n), np.log1p(len(raw) / max(1, n)), len(set(words)) / max(1, n), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(len(w) <= 3 for w in words) / max(1, n), sum(w[-1:] in b".,;:!?" for w in words) / max(1, n), max(map(len, words), default=0) ** 0.25,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n), sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in words) / max(1, n),
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    """A logistic score of standardised features; ``prior`` is the estimated share of positives."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: np.ndarray | float = 1e-3) -> QualityModel:
    """Minimise the non-negative unbiased risk  prior * E+[l(z)] + max(0, Eu[l(-z)] - prior * E+[l(-z)])  of the logistic loss l by Adam.

    Where the second part falls below zero its own gradient is climbed instead, so that the model
    can't win by calling unlabelled positives negative. Features stand at the mean and spread of
    the unlabelled rows. Without rows of one kind the score is the prior throughout.
    """
    width = positive.shape[1]
    prior = min(max(prior, 0.01), 0.99)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), float(np.log(prior / (1 - prior))), np.zeros(width), np.ones(width), prior)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3

    def standing(x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), width + 1), np.float32)
        np.clip(np.divide(np.subtract(x, mean, out=out[:, :width], casting="unsafe"), scale, out=out[:, :width], casting="unsafe"), -8, 8, out=out[:, :width])
        return out

    p, u = standing(positive), standing(unlabelled)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w.astype(np.float32), u @ w.astype(np.float32)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = su @ u / len(u) - prior * (sp @ p) / len(p)
        grad = -grad_negative if negative_risk < 0 else grad_negative - prior * ((1 - sp) @ p) / len(p)
        grad = grad + np.append(decay * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return QualityModel(w[:-1], float(w[-1]), mean.astype(np.float64), scale.astype(np.float64), prior)


def held_out(id_col: str | Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves no remainder. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()).tobytes() for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["kind", "h", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """Fit on trusted positives and unlabelled texts outside the held-out fold.

    At most ``positives`` and ``unlabelled`` rows are taken, the first by a hash of id and text, whatever ids
    repeat; their features (a few dozen MB) come to the driver. A count of rows of each kind gives the share
    of hashes to look at, so that hardly more rows than those are read as texts, compared or sorted. Rows equal in id and
    text count once. Labels 0 serve for one number only, the class prior: the share of label 1 among all
    labels outside the held-out fold. Documents with a training label are not unlabelled; an id with both
    labels is trusted. Null labels and ids don't take part; labels without a document neither. Without
    positives or unlabelled texts the score is the prior throughout.
    """
    ship(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    prior = marked.agg(F.avg(F.when(F.col("y") == 1, 1.0).otherwise(0.0))).first()[0]
    sure = marked.groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("sure"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    kind = F.coalesce("sure", F.lit(-1)).alias("kind")  # 1 trusted, 0 labelled but not so, -1 unlabelled
    counts = {r["kind"]: r["n"] for r in rows.select("id").join(sure, "id", "left").groupBy(kind).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {1: positives, -1: unlabelled}
    # A third more than is asked for, and 200, so that rows which repeat and the spread of hashes hardly leave too few.
    reach = {k: min(1.0, (n * 4 / 3 + 200) / max(1, counts.get(k, 0))) for k, n in most.items()}
    below = {k: 2**63 - 1 if r == 1 else int(r * 2**53) * 2**11 - 2**63 for k, r in reach.items()}
    looked = rows.where(F.col("h") <= max(below.values())).join(sure, "id", "left").select(kind, "h", "text")
    looked = looked.where(F.col("h") <= F.when(F.col("kind") == 1, below[1]).when(F.col("kind") == -1, below[-1]))
    made = looked.mapInArrow(_featured, "kind int, h long, x binary").groupBy("kind", "h").agg(F.first("x").alias("x"))
    made = cut(made)  # features of a bounded number of rows, made once for both kinds
    one, other = (_matrix(made.where(F.col("kind") == k).orderBy("h").limit(n).select("x").toArrow()) for k, n in most.items())
    return fit_nnpu(one, other, 0.5 if prior is None else prior, decay=DECAY)


def _matrix(rows: pa.Table) -> np.ndarray:
    """The features of rows, read out of Arrow's own buffers."""
    out = np.empty((len(rows), WIDTH), np.float32)
    at = 0
    for chunk in rows.column(0).chunks:
        values = chunk.cast(pa.binary(4 * WIDTH))
        out[at : at + len(chunk)] = np.frombuffer(values.buffers()[1], np.float32, len(chunk) * WIDTH, values.offset * 4 * WIDTH).reshape(-1, WIDTH)
        at += len(chunk)
    return out


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with a column score: the model's probability that the whole text is of quality. Null counts as empty; a column of that name is replaced."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.stack([features(t) for t in texts])) if len(texts) else np.zeros(0))

    return docs.withColumn("score", score(F.col(text_col)))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at ``threshold`` or more, with all their columns, whatever their names.

    Decided by the text alone, so rows that repeat stay or go together; null counts as empty. The model is that of
    fit_quality over the same rows. No rows give no rows.
    """
    model = fit_quality(docs, labels, id_col, text_col)
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score_quality(held, model).where(F.col("score") >= threshold).select("row.*")
