"""Language identification with a blended-spectrum string kernel.

A text's features are the distinct n-grams, of 1 to 4 characters, of its lower-cased words of letters
with a space at either end. The kernel of two texts counts the n-grams that both hold, over the
geometric mean of how many each holds. Landmarks, a bounded sample of training texts, give the Nystroem
map: kernels with the landmarks times the inverse root of the landmarks' own kernel. One-versus-rest
ridge regression in that space yields a score per language. Scoring is a product of a batch's n-gram
presence with the landmarks' presence, then with the regression weights; as both are linear, the two
fixed factors are multiplied once, when the model is made, and a batch of texts is one matrix product.

Bounds (documented parameters): `landmarks` landmark texts and `train` training texts at most, dealt equally
to the languages and chosen by a hash of id and text, so that rows which share an id, or have none, are drawn
one by one; rows that repeat both count once. Of more languages than such a sample has texts, the most
frequent ones are learned. Every text is scored whole.

Letters are the characters of Unicode's category L; digits of any kind, such as superscripts, are none.

Texts that are null or have no letter are `und` with score 0. Rows with a null language or text teach
nothing. If nothing can be learned, all texts are `und`. Repeated rows get equal results. An empty table
gives an empty result; columns beside id, text and language are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
#: Characters that count as parts of words in patterns and are neither letters nor decimal digits: taken for spaces.
OTHERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LONGEST = 4
#: Texts whose presence makes one matrix.
BATCH = 64
UNKNOWN = "und"
#: How many draws a sample's hashes are taken to.
SPAN = 1 << 52


def ngrams(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct n-grams."""
    joined = " ".join(set(LETTERS.findall(text.lower()))) if text else ""
    if not joined.isascii() and not OTHERS.isdisjoint(joined):
        joined = " ".join(set("".join(" " if c in OTHERS else c for c in joined).split()))
    if not joined:
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {joined} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = c == 32
    out, h, inner = [], np.zeros(len(c), np.uint64), np.zeros(len(c), bool)
    for p in range(LONGEST):
        n = len(c) - p
        h = (h[:n] + c[p:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        inner = inner[:n] | space[p - 1 : p - 1 + n] if p > 1 else inner[:n]  # a space inside joins two words
        out.append(h[~inner & ~space] if p == 0 else h[~inner])
    return np.unique(np.concatenate(out))


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # sorted hashes of the landmarks' n-grams
    weights: np.ndarray  # n-grams x languages: landmark presence times regression weights
    bias: np.ndarray

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        """texts x languages: regression values, a product of presence and weights per batch."""
        if not len(self.vocabulary):
            return np.tile(self.bias, (len(features), 1))
        out = np.empty((len(features), len(self.bias)))
        seen = np.zeros((min(len(features), BATCH), len(self.vocabulary)), np.float32)
        for lo in range(0, len(features), BATCH):
            part = features[lo : lo + BATCH]
            at = present(part, self.vocabulary)
            seen[at] = 1
            out[lo : lo + BATCH] = seen[: len(part)] @ self.weights
            seen[at] = 0
        sizes = np.array([max(1, len(f)) for f in features])
        return out / np.sqrt(sizes)[:, None] + self.bias


def present(features: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) numbers of the entries of a presence matrix that are 1."""
    text = np.repeat(np.arange(len(features)), [len(f) for f in features])
    f = np.concatenate(features) if features else np.empty(0, np.uint64)
    at = np.minimum(np.searchsorted(vocabulary, f), max(0, len(vocabulary) - 1))
    hit = vocabulary[at] == f
    return text[hit], at[hit]


def kernel(features: list[np.ndarray], vocabulary: np.ndarray, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """texts x landmarks: n-grams shared, over the root of the product of both counts."""
    x = np.zeros((len(features), len(vocabulary)), np.float32)
    x[present(features, vocabulary)] = 1
    shared = (x @ presence.astype(np.float32)).astype(np.float64)
    return shared / np.sqrt(np.maximum(1, np.array([len(f) for f in features]))[:, None] * sizes[None, :])


def sample(df: DataFrame, count: int, salt: str) -> DataFrame:
    """At most count distinct rows of (id, text, lang), as many for each language, those that a hash of id and text puts first; at most `count` languages, the most frequent.

    A pass over the hashes under twice the rate wanted finds where each language's share ends; a language whose
    rows repeat so often that too few differ there is looked at again under four times the rate. So the
    driver gets a few times `count` numbers, whatever repeats.
    """
    sizes = {r.lang: r.n for r in df.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(count).collect()}
    each = max(1, count // max(1, len(sizes)))
    drawn = df.select("id", "text", "lang", F.pmod(F.xxhash64(F.lit(salt), "id", "text"), F.lit(SPAN)).alias("draw"))

    def under(ends: dict[str, int]) -> DataFrame:
        shares = df.sparkSession.createDataFrame(list(ends.items()), "lang string, end bigint")
        return drawn.join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("end"))

    ends, looked = {}, {lang: min(SPAN, 2 * each * SPAN // n + 1) for lang, n in sizes.items()}
    while looked:
        found: dict[str, list[int]] = {lang: [] for lang in looked}
        for lang, draw in under(looked).select("lang", "draw").distinct().collect():
            found[lang].append(draw)
        ends |= {lang: sorted(found[lang])[:each][-1] + 1 for lang, end in looked.items() if len(found[lang]) >= each or end == SPAN}
        looked = {lang: min(SPAN, 4 * end) for lang, end in looked.items() if lang not in ends}
    return under(ends).dropDuplicates(["lang", "draw"]).select("id", "text", "lang")


def fit(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = 128, train: int = 3000, ridge: float = 1e-3) -> Model:
    """A model learned from the rows of df for which `usable` holds."""
    known = df.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.int64()))], names=["lang", "f"])

    # the features of `landmarks` texts, then a kernel row for each of `train` texts, come to the driver
    marks = [(r.lang, np.array(r.f, np.int64).view(np.uint64)) for r in sample(known, landmarks, "landmark").mapInArrow(features, "lang string, f array<bigint>").collect()]
    marks = sorted(((lang, f) for lang, f in marks if len(f)), key=lambda x: (x[0], x[1].tobytes()))  # in an order that doesn't depend on tasks
    if not marks:
        return Model([], np.empty(0, np.uint64), np.empty((0, 0), np.float32), np.empty(0))
    vocabulary = np.unique(np.concatenate([f for _, f in marks]))
    presence = np.zeros((len(vocabulary), len(marks)), np.uint8)
    for j, (_, f) in enumerate(marks):
        presence[np.searchsorted(vocabulary, f), j] = 1
    sizes = presence.sum(0, dtype=np.float64)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, presence, sizes))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [ngrams(t) for t in part.column(1).to_pylist()]
                k = kernel(found, *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(list(k), pa.list_(pa.float64()))], names=["lang", "k"])

    taught = [(r.lang, r.k) for r in sample(known, train, "train").mapInArrow(rows, "lang string, k array<double>").collect() if any(r.k)]
    taught = sorted(taught) or [(lang, list(row)) for (lang, _), row in zip(marks, kernel([f for _, f in marks], vocabulary, presence, sizes), strict=True)]
    languages = sorted({lang for lang, _ in taught})
    k = np.array([row for _, row in taught])
    own = kernel([f for _, f in marks], vocabulary, presence, sizes)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # landmarks' kernel to the power -1/2
    phi = np.concatenate([k @ root, np.ones((len(k), 1))], 1)
    answer = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in taught])
    weight = 1 / np.array([sum(lang == x for x, _ in taught) for lang, _ in taught])  # each language counts alike
    left = (phi * weight[:, None]).T @ phi + ridge * np.diag([1.0] * (phi.shape[1] - 1) + [1e-9])
    solved = np.linalg.solve(left, (phi * weight[:, None]).T @ answer)
    per_mark = root @ solved[:-1] / np.sqrt(sizes)[:, None]
    return Model(languages, vocabulary, (presence @ per_mark).astype(np.float32), solved[-1])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of df; the score is the winner's regression value, -1 to 1 taken to 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [ngrams(t) for t in part.column(1).to_pylist()]
                values = m.score(found) if m.languages else np.zeros((len(found), 0))
                langs, scores = [], []
                for f, v in zip(found, values, strict=True):
                    best = int(v.argmax()) if len(f) and len(v) else -1
                    langs.append(m.languages[best] if best >= 0 else UNKNOWN)
                    scores.append((min(1.0, max(-1.0, float(v[best]))) + 1) / 2 if best >= 0 else 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Model, margin: float = 0.1, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text speaks for its language: the winner's value is above that of a text that shares nothing with the landmarks by a margin. With a single language to learn, any text with letters stays."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(texts):
        import pandas as pd

        m, out = shared.value, []
        for at in range(0, len(texts), 256):
            found = [ngrams(t) for t in texts.iloc[at : at + 256]]
            values = m.score(found)
            out += [bool(len(f) and len(v) and (len(v) == 1 or v.max() - m.bias[v.argmax()] >= margin)) for f, v in zip(found, values, strict=True)]
        return pd.Series(out, dtype=bool)

    return df.where(fine(text_col))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
