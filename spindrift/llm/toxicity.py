"""Toxicity by compression distance: two zstandard dictionaries, window by window.

Training. From a sample of labelled texts, bounded in rows and bytes of whole texts, the words of toxic texts
that are much more frequent there than in ordinary ones are what the toxic dictionary is trained on, the words
of ordinary texts for which the reverse holds train the ordinary one, and phrases of both train a background
dictionary that stands behind both, so that the two compressors differ only in what tells the classes apart.
All three are trained by zstandard. (Trained on the whole windows of both classes instead, the two dictionaries
hold the same frequent phrases; README has the figures.)

Scoring. A text is cut into windows of about ``WINDOW`` bytes at spaces; for each the compressed length
with the ordinary dictionary less that with the toxic one is its distance. The mean distance, the share
of windows above each of a few thresholds and the mean of the two largest distances go through logistic
regression, fitted on texts seen through dictionaries that other parts of the sample trained and corrected for
the share of toxic labels among all that may be learnt from; that calibrates the score as the probability of label 1.

Only texts and labels are used. Null and empty texts get the score of a text without windows. Texts are
scored whole. Repeated rows get equal scores, an empty table an empty result, a column that has the name of the
score is replaced. With no toxic or no ordinary label to learn from, every
score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small_batches, text_or_empty

#: Bounds of the training sample, for each class: whole texts, chosen by hash, and bytes of them all.
SAMPLE, SAMPLE_BYTES = 2500, 24_000_000
#: Parts of the sample that are calibrated on in turn, with dictionaries trained on the others.
FOLDS = 3
WINDOW = 64
#: Bytes of the class dictionaries and of the shared background.
CLASS_BYTES, BACKGROUND_BYTES, LEVEL = 1280, 12_288, 9
#: Segment lengths of zstandard's dictionary trainer: words for the classes, phrases for the background.
CLASS_SEGMENT, BACKGROUND_SEGMENT = 20, 64
#: Words of a class stand in at least one text of this many, and are so many times as frequent as in the other.
ONE_IN, LIFT = 100, 30
THRESHOLDS = (2, 3, 5)


def windows(text: str) -> list[bytes]:
    """Whole text, lower-cased, cut at the last space before every WINDOW bytes."""
    b = text.lower().encode("utf-8", "surrogatepass")
    out, i, n = [], 0, len(b)
    while i < n:
        j = i + WINDOW
        if j < n:
            k = b.rfind(b" ", i + 1, j)
            j = k if k > 0 else j
        out.append(b[i:j])
        i = j
    return out


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    constant: float | None = None

    def compressors(self):
        import zstandard as z

        out = []
        for raw in (self.ordinary, self.toxic):
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        ordinary, toxic = self.compressors()
        out = np.zeros((len(texts), len(THRESHOLDS) + 3))
        for i, t in enumerate(texts):
            ws = windows(t)
            if ws:
                d = np.array([len(ordinary(w)) - len(toxic(w)) for w in ws])
                top = np.sort(d)[-2:]
                out[i] = [1, np.clip(d.mean(), -4, 4), np.clip(top.mean(), -8, 16) / 4, *(2 * np.sqrt((d >= k).mean()) for k in THRESHOLDS)]
            else:
                out[i, 0] = 1
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def telling(one: list[str], other: list[str]) -> list[bytes]:
    """Per text of ``one``, its words that are over LIFT times as frequent there as in ``other`` and not rare."""
    a, b = (Counter(w for t in ts for w in set(t.lower().split())) for ts in (one, other))
    least = max(3, len(one) // ONE_IN)
    keep = {w for w, n in a.items() if n >= least and n / len(one) > LIFT * (b[w] + 0.5) / max(1, len(other))}
    out = [" ".join(w for w in t.lower().split() if w in keep) for t in one]
    return [f" {x} ".encode("utf-8", "surrogatepass") for x in out if x]


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    """A model without weights: the class dictionaries, each in front of the shared background."""
    both = ordinary + toxic[: max(1, len(ordinary) // 4)]
    phrases = [w for t in both for ws in (windows(t),) for i in range(0, len(ws), 4) if (w := b"".join(ws[i : i + 4]))]
    background = trained(BACKGROUND_BYTES, phrases, BACKGROUND_SEGMENT)
    own = [trained(CLASS_BYTES, telling(a, b), CLASS_SEGMENT) for a, b in ((toxic, ordinary), (ordinary, toxic))]
    return Model(own[0] + background, own[1] + background, np.zeros(0))


def train(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
    """``share`` of toxic labels among all: calibration starts from it if the sample has another share.

    Calibration looks at whole texts only through dictionaries that other texts trained (FOLDS parts in turn).
    """
    n = len(toxic) + len(ordinary)
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros(0), len(toxic) / n if n else 0.0)
    x, y = [], []
    for fold in range(FOLDS):
        (test_t, rest_t), (test_o, rest_o) = [[[t for i, t in enumerate(ts) if (i % FOLDS == fold) is part] for part in (True, False)] for ts in (toxic, ordinary)]
        x.append(dictionaries(rest_t, rest_o).features(test_t + test_o))
        y += [1.0] * len(test_t) + [0.0] * len(test_o)
    model = dictionaries(toxic, ordinary)
    model.weights = logistic(np.vstack(x), np.array(y))
    if share and share < 1:
        model.weights[0] += np.log(share / (1 - share)) - np.log(len(toxic) / len(ordinary))
    return model


def held_out(doc_id) -> object:
    """Whether a row is kept from training: crc32 of doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sizes: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """The training sample: of each label at most ``sizes`` whole texts, the first by a hash of doc_id, and of these
    the first that together have at most ``most`` bytes; texts of over a tenth of that come last, and one that is longer than
    ``most`` is passed over. A text with several labels counts once for each distinct one.
    """
    known = labels.select("doc_id", "toxic").filter("toxic in (0, 1)").distinct().filter(~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")]
    # choose ids before touching texts: only the chosen rows' texts are moved
    out = []
    for k in (1, 0):
        ids = F.broadcast(known.filter(F.col("toxic") == k).select("doc_id").orderBy(order[0], "doc_id").limit(sizes))  # at most `sizes` numbers
        rows = docs.select("doc_id", "text").filter("text is not null").join(ids, "doc_id").distinct().orderBy(*order).limit(sizes)
        size = F.octet_length("text")
        fits = rows.filter(size <= most)
        held = fits.withColumn("upto", F.sum(size).over(W.partitionBy(F.lit(k)).orderBy(10 * size > most, *order).rowsBetween(W.unboundedPreceding, 0)))
        out.append([r.text for r in held.filter(F.col("upto") <= most).select("text").collect()])
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, sizes: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    toxic, ordinary = sample(docs, labels, sizes, most)
    share = labels.filter("toxic in (0, 1)").filter(~held_out("doc_id")).agg(F.avg("toxic")).first()[0]
    mix = random.Random(7)
    mix.shuffle(toxic)
    mix.shuffle(ordinary)
    return train(toxic, ordinary, share)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the calibrated probability that a whole text is toxic. Other columns pass through."""
    small_batches(df.sparkSession)

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(model.scores(batch.tolist()))

    return df.withColumn(out, run(text_or_empty(text)))
