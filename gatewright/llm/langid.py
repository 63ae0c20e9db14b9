"""Language identification by error-correcting output codes.

Every language has a codeword; a binary linear classifier on hashed byte n-grams predicts each bit. Decoding adds up, per language,
the losses of its bits, weighted by how reliable each bit's classifier is for that language, and takes the smallest sum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.llm.common import bounded_batches, set_aside, slices

BUCKETS = 1 << 12
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray:
    """Relative frequencies of the hashed byte n-grams (2 to 4) of the whole lower-cased text; runs of non-letters are one space."""
    data = (" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "replace")
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.float32)
    h = b
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x9E3779B1) + b[n - 1 :]
        if len(h):
            counts += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1))


@dataclass
class Model:
    """Languages, their codewords (+1/-1), the bits' weights and the reliability of each bit for each language."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the language's index, its share (0 to 1) of the decoding mass, and the lead over the second."""
        bits = np.tanh(x @ self.weights[:-1] + self.weights[-1])
        loss = np.stack([(self.trust[k] * (1 - self.code[k] * bits) / 2).sum(1) for k in range(len(self.langs))], 1)
        mass = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        mass /= mass.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(loss, 1)
        lead = ranked[:, 1] - ranked[:, 0] if len(self.langs) > 1 else np.ones(len(x))
        return best, mass[np.arange(len(x)), best], lead


#: Columns that identify() adds.
OWN = ["lang_pred", "score", "ambiguous"]


def codewords(n: int, bits: int, seed: int = 7) -> np.ndarray:
    """n distinct codewords: the seeded random code of the largest smallest distance; every bit separates some languages.

    Codewords have `bits` bits, and at least four for each time that n doubles, so that many languages stay apart too.
    """
    if n == 1:
        return np.ones((1, 1))
    bits = max(bits, 4 * math.ceil(math.log2(n)))
    rng, best, far = np.random.default_rng(seed), None, 0
    while best is None:
        for _ in range(300 if n <= 64 else 20):
            code = rng.choice([-1.0, 1.0], (n, bits))
            flat = np.abs(code.sum(0)) == n
            code[0, flat] *= -1
            apart = int(((bits - code @ code.T) / 2)[~np.eye(n, dtype=bool)].min())
            if apart > far:
                best, far = code, apart
        bits += 1
    return best


def train(x: np.ndarray, y: list[str], bits: int = 15, rounds: int = 100) -> Model:
    """Logistic bit classifiers by full-batch gradient steps with momentum; languages weigh alike. Deterministic."""
    langs = sorted(set(y))
    k = np.array([langs.index(v) for v in y])
    code = codewords(len(langs), bits)
    target = (code[k] + 1) / 2
    weight = (1 / np.bincount(k))[k, None]
    weight /= weight.sum()
    xs = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((xs.shape[1], code.shape[1]), np.float32)
    step, m, v = 0.3, np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(xs @ w)))
        g = xs.T @ ((p - target) * weight).astype(np.float32) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    right = np.sign(xs @ w) == code[k]
    trust = np.array([right[k == i].mean(0) for i in range(len(langs))]) + 1e-3
    return Model(langs, code, w, trust / trust.sum(1, keepdims=True))


def fit(docs: DataFrame, per_lang: int = 600, bits: int = 15, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the labelled rows among docs; None if there are none.

    `per_lang` bounds the sample: of each language about so many documents take part, those of the smallest seeded hashes of the id.
    Every labelled document is counted for the rates; only features of the sample reach the driver.
    """
    bounded_batches(docs.sparkSession)
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rates = [(r[0], min(1.0, per_lang / r[1])) for r in named.groupBy(lang).count().collect()]  # one row per language
    if not rates:
        return None
    unit = F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.element_at(F.create_map(*[F.lit(z) for pair in rates for z in pair]), F.col(lang))
    picked = named.where(unit < rate).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pairs = [(z, t) for z, t in zip(b["lang"].to_pylist(), b["text"].to_pylist()) if _LETTER.search(t)]
            yield pa.RecordBatch.from_pydict({"lang": [z for z, _ in pairs], "x": pa.array([features(t).astype(np.float16).tobytes() for _, t in pairs], pa.binary())})

    got = picked.mapInArrow(rows, "lang string, x binary").orderBy("lang", "x").collect()
    if not got:
        return None
    return train(np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32), [r["lang"] for r in got], bits)


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter; all columns."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            yield b.filter(pa.array([bool(t and _LETTER.search(t)) for t in b[text].to_pylist()], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def identify(docs: DataFrame, model: Model | None, text: str = "text", ambiguous_lead: float = 0.05) -> DataFrame:
    """All rows and columns with `lang_pred`, `score` (0 to 1) and `ambiguous` (the two nearest codewords are about as near).

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows give repeated results; clashing
    input columns get the suffix _input.
    """
    own = OWN
    bounded_batches(docs.sparkSession)
    docs = set_aside(docs, own)
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = b[text].to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            pred, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if known:
                best, share, lead = model.decode(np.stack([features(texts[i]) for i in known]))
                for i, z, s, d in zip(known, best, share, lead):
                    pred[i], score[i], unsure[i] = model.langs[z], float(s), bool(d < ambiguous_lead)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*names, *own])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(rows, schema)
