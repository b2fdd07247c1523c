"""Language identification by mixtures of n-gram models.

Training sums hashed byte trigrams of all labelled texts by language. A text is then explained as a mixture of languages:
expectation-maximisation estimates the proportions, and the set of languages is grown, largest share first, as long as
the likelihood gains more than its penalty. The largest share of the chosen set is the prediction.

Null texts and texts without letters are ``und`` with score 0, and so is everything if nothing could be learned.
Null languages teach nothing. Repeated rows count as often as they occur; an empty table gives an empty result. Of languages with equal
shares the first by name is taken. A text is read in pieces of 4 MB, so a very long one needs little more than its own size.
The model is one array of 2**15 numbers (256 KB) for each language, on the driver and in each task, which bounds the number of
languages: beyond ``MOST_LANGUAGES`` (256 MB) fitting raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_as_text_crc

FEATURES = 1 << 15
MULTIPLIER = np.uint32(0x9E3779B1)
#: Letters a-z and bytes beyond ASCII stay, all else separates.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are looked at together.
CHUNK = 1 << 22
UNKNOWN = "und"
MOST_LANGUAGES = 1000


def counts(text: str) -> np.ndarray:
    """How often each feature occurs in ``text``: byte trigrams of its lower-case letters, single spaces between words."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" "
    out = np.zeros(FEATURES, np.int64)
    for i in range(0, max(1, len(data) - 2), CHUNK):
        b = np.frombuffer(data[i : i + CHUNK + 2], np.uint8).astype(np.uint32)
        if len(b) >= 3:
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            out += np.bincount((code * MULTIPLIER) >> np.uint32(32 - 15), minlength=FEATURES)
    return out


@dataclass
class Model:
    languages: list[str]
    #: Probability of each feature by language, shape (languages, features).
    likelihood: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Sums of features over all rows of ``docs`` with a text and a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for t, name in zip(frame["text"], frame["lang"], strict=True):
                sums[name] = sums.get(name, 0) + counts(t)
        for name, x in sums.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"lang": name, "feature": at.astype(np.int32), "n": x[at]})

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(FEATURES, np.int64)
        whole[frame["feature"].to_numpy()] = frame["n"].to_numpy()
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "x": [whole.tobytes()]})

    summed = rows.mapInPandas(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    by_language = summed.groupBy("lang").applyInPandas(packed, "lang string, x binary").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(by_language) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.array([np.frombuffer(row["x"], np.int64) for row in by_language], float).reshape(len(by_language), FEATURES) + smoothing
    return Model([row["lang"] for row in by_language], table / table.sum(axis=1, keepdims=True))


def mixture(x: np.ndarray, p: np.ndarray, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` (feature probabilities) in the counts ``x``, and the log-likelihood, by EM until no share
    moves by as much as the tolerance. Each round raises the likelihood, so it ends."""
    share = np.full(len(p), 1 / len(p))
    n = x.sum()
    while True:
        new = share * (p @ (x / (share @ p))) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < tolerance:
            return share, float(x @ np.log(share @ p))


def identify(text: str | None, model: Model, penalty: float = 1.5, least: float = 0.02) -> tuple[str, float, str]:
    """(language, its share among all languages, the chosen set of languages, largest share first)."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, ""
    x = counts(text)
    at = np.flatnonzero(x)
    if not len(at):
        return UNKNOWN, 0.0, ""
    x, p = x[at].astype(float), model.likelihood[:, at]
    whole, _ = mixture(x, p)
    order = np.argsort(-whole, kind="stable")
    chosen, share, best = order[:1], np.ones(1), float(x @ np.log(p[order[0]]))
    cost = penalty * math.log(max(2.0, x.sum()))
    for k in range(2, len(order) + 1):
        if whole[order[k - 1]] < least:
            break
        shares, value = mixture(x, p[order[:k]])
        if value - best <= cost:
            break
        chosen, share, best = order[:k], shares, value
    ranked = chosen[np.argsort(-share, kind="stable")]
    return model.languages[ranked[0]], float(min(1.0, whole[ranked[0]])), ",".join(model.languages[i] for i in ranked)


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with ``out``: lang_pred, score and languages; an input column of that name is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood))

    @F.pandas_udf("lang_pred string, score double, languages string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(*shipped.value)
        for series in texts:
            yield pd.DataFrame([identify(t, known) for t in series], columns=["lang_pred", "score", "languages"])

    return docs.withColumn(out, run(F.col(text)))


def report(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages; what is learned comes from the documents that are not held out."""
    rows = docs.select("doc_id", "text", "lang", F.coalesce(id_as_text_crc(F.col("doc_id")) % folds == held_out, F.lit(False)).alias("held_out"))
    model = fit(rows.where("NOT held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "found.*")
