"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (proximal, per-coordinate rates) with elastic-net penalties on a bounded
sample of labelled rows, then calibrated by one temperature on a part of that sample which training did not see.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
BITS = 15
PIECE = 4 << 20
#: Characters of a text that are looked at at once.
CHUNK = 1 << 20
UND = "und"


def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), dtype=bool, count=0x110000)


class Features:
    """Counts of hashed character 1-, 2- and 3-grams of the lower-cased letters; runs of anything else are one blank."""

    def __init__(self) -> None:
        self.letter = _letters()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(buckets, 1 + ln count) of a text; None if it has no letter. Long texts go through in chunks."""
        counts, last, any_letter = np.zeros(1 << BITS, np.int64), np.array([32], np.uint32), False
        for at in range(0, len(text), CHUNK):
            c = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            is_letter = self.letter[c]
            any_letter |= bool(is_letter.any())
            c = np.where(is_letter, c, np.uint32(32))
            # Of a run of others the first stays, as the blank; `last` holds the two before, and always one.
            c = c[is_letter | np.append(last[-1] != 32, is_letter[:-1])]
            last = self._count(counts, last, c)
        if not any_letter:
            return None
        if last[-1] != 32:
            self._count(counts, last, np.array([32], np.uint32))
        at = np.flatnonzero(counts)
        return at.astype(np.int32), 1.0 + np.log(counts[at])

    @staticmethod
    def _count(counts: np.ndarray, last: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Count the n-grams that end in `new`, which follows `last`; the last two of both."""
        k, c = np.uint32(2654435761), np.concatenate((last, new))
        two = ((c[:-1] * k) ^ (c[1:] * np.uint32(40503))) * k + np.uint32(1)
        three = (two[:-1] ^ (c[2:] * np.uint32(2246822519))) * k + np.uint32(2)
        grams = np.concatenate((new * k, two[len(last) - 1 :], three[max(0, len(last) - 2) :]))
        counts += np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
        return c[-2:]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x langs, mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return x / (np.sqrt(x @ x) or 1.0) @ self.weights[at] + self.bias

    def predict(self, at: np.ndarray, tf: np.ndarray) -> tuple[str, float]:
        z = self.logits(at, tf) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best] / p.sum()))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], passes: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 11, frequencies: tuple[int, np.ndarray] | None = None) -> Model:
    """FTRL-proximal over shuffled rows (lang, buckets, tf); every fifth row is kept for the temperature.

    frequencies: how many texts there are, and in how many each bucket is; by default those of the rows.
    """
    langs = sorted({r[0] for r in rows})
    if frequencies is None:
        frequencies = len(rows), np.bincount(np.concatenate([at for _, at, _ in rows] or [np.zeros(0, np.int32)]), minlength=1 << BITS)
    idf = np.log((1 + frequencies[0]) / (1 + frequencies[1])) + 1.0
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[::5], np.array([i for k, i in enumerate(order) if k % 5]) if len(order) > 5 else order
    z, n = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs)))
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))

    def solved(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    model = Model(langs, idf, np.zeros_like(z), zb)
    if len(langs) < 2:
        return model
    for k in range(passes):
        for i in np.random.default_rng(seed + k).permutation(used):
            lang, at, tf = rows[i]
            x = tf * idf[at]
            x /= np.sqrt(x @ x)
            w, b = solved(z[at], n[at], l1), solved(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            g = p / p.sum()
            g[langs.index(lang)] -= 1.0
            for zs, ns, grad, ws, where in ((z, n, x[:, None] * g, w, at), (zb, nb, g, b, slice(None))):
                more = grad * grad
                zs[where] += grad - (np.sqrt(ns[where] + more) - np.sqrt(ns[where])) / alpha * ws
                ns[where] += more
    model.weights, model.bias = solved(z, n, l1), solved(zb, nb, 0.0)
    scores = np.array([model.logits(*rows[i][1:]) for i in held])
    truth = np.array([langs.index(rows[i][0]) for i in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]))

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
    model.temperature = float(np.exp((lo + hi) / 2))
    return model


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts (column text) have a letter, and in how many each bucket is. A fixed array comes from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, d = Features(), np.zeros((1 << BITS) + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                for text in batch.column(0).to_pylist():
                    if f := features(text):
                        d[f[0]] += 1
                        d[-1] += 1
        at = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(d[at])], names=["bucket", "n"])

    d = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        d[r["bucket"]] = r["n"]
    return int(d[-1]), d[:-1]


def train(docs: DataFrame, sample_per_lang: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about `sample_per_lang` labelled rows of each language that are not held out.

    The sample is the documented bound: each language's rows pass with probability sample_per_lang / its row count, by
    a hash of id and text, so reruns draw the same rows and identical rows count once. The per-language counts and the
    document frequencies of TF-IDF cover all rows. Only hashed features of sampled rows come to the driver.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter((F.crc32("id") % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample_per_lang / n))))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "text", F.lit("lang sample")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [(hash_, lang, f) for hash_, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))) if (f := features(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), *(pa.array([np.asarray(x[2][k], dtype=t).tobytes() for x in found], pa.binary()) for k, t in ((0, np.int32), (1, np.float32)))],
                names=["hash", "lang", "at", "tf"],
            )

    got = drawn.select(F.xxhash64("id", "text").alias("hash"), "lang", "text").mapInArrow(run, "hash long, lang string, at binary, tf binary").collect()
    unique = {(r["lang"], r["hash"]): r for r in got}
    return fit([(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["tf"], np.float32).astype(float)) for _, r in sorted(unique.items(), key=lambda x: x[0])], frequencies=document_frequencies(rows))


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """Language and calibrated probability of every whole text.

    `und` with score 0: a null text, a text without a letter, or no labelled row to learn from. A null id is not held
    out and not learned from. Repeated rows pass through, a row each; an empty table gives an empty result; other
    columns are not read. Ties between languages go to the first by code point. The model is a few MB, sent with the job.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **training)
    weights = model.weights.astype(np.float32).astype(float)
    small = Model(model.langs, model.idf, weights, model.bias, model.temperature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                found = [f and small.langs and small.predict(*f) or (UND, 0.0) for f in (features(t) if t else None for t in batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model | None = None, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known with `min_score` or more. No shuffle.

    Null, empty and letterless texts, and all rows where there is no label to learn from, are not known. Null ids and
    repeated rows are judged like others; a tie between languages changes nothing; an empty table gives an empty result.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **training)
    small = Model(model.langs, model.idf, model.weights.astype(np.float32).astype(float), model.bias, model.temperature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for batch in slices(whole, text_col, PIECE):
                known = (t and small.langs and features(t) for t in batch.column(text_col).to_pylist())
                yield batch.filter(pa.array([bool(f) and small.predict(*f)[1] >= min_score for f in known], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
