"""Language identification by multilingual mixtures."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import text_or_empty

BUCKETS = 1 << 15  # of hashed character trigrams
UNDETERMINED = "und"
_SCALE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of a lower-cased text, in which each stretch without letters is one space.

    Empty if the text has no letter.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, points, np.uint32(32))[keep]
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)


def learn_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n: trigram counts of each language over the given documents."""

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = trigrams(text)
                if len(found):
                    seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    seen[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    return docs.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram likelihoods of each language, and the mixture that explains a text best."""

    def __init__(self, counts: pd.DataFrame, smoothing: float = 0.5):
        self.langs = sorted(counts["lang"].unique())
        n = np.zeros((len(self.langs), BUCKETS))
        if len(self.langs):
            n[pd.Categorical(counts["lang"], self.langs).codes, counts["bucket"].to_numpy()] = counts["n"].to_numpy()
        self.p = ((n + smoothing) / (n.sum(axis=1, keepdims=True) + smoothing * BUCKETS)).astype(np.float32)

    @staticmethod
    def fit(g: np.ndarray, c: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
        """Expectation-maximisation: shares of the rows of g (likelihoods) over columns seen c times, and log-likelihood."""
        share, total = np.full(len(g), 1 / len(g), np.float32), float(c.sum())
        for _ in range(steps):
            new = share * (g @ (c / (share @ g))) / total
            new /= new.sum()
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(c @ np.log(share @ g))

    def languages(self, text: str, penalty: float, least: float) -> tuple[str, float, list[str], list[float]]:
        """Best language of the selected set, its share there, and the set with shares.

        Languages with less than `least` of the mixture are left out; of the sets of the largest remaining ones, the
        one wins whose log-likelihood, less `penalty` times ln(1 + trigrams) for each language, is highest.
        """
        found = trigrams(text) if self.langs else ()
        if not len(found):
            return UNDETERMINED, 0.0, [], []
        if len(found) > BUCKETS // 8:
            n = np.bincount(found, minlength=BUCKETS)
            found = np.flatnonzero(n)
            c = n[found].astype(np.float32)
        else:
            c = np.ones(len(found), np.float32)
        g = self.p[:, found]
        share, _ = self.fit(g, c)
        order = np.argsort(-share, kind="stable")
        sets = [order[: k + 1] for k in range(int((share >= least).sum()) or 1)]
        if len(sets) == 1:
            chosen, part = [int(order[0])], share[order[:1]]
        else:
            cost = penalty * np.log1p(c.sum())
            fits = [self.fit(g[s], c) for s in sets]
            k = int(np.argmax([ll - cost * len(s) for s, (_, ll) in zip(sets, fits)]))
            chosen, part = sets[k], fits[k][0]
        best = int(np.argmax(part))
        return self.langs[chosen[best]], min(1.0, float(part[best])), [self.langs[i] for i in chosen], [float(x) for x in part]


def train(docs: DataFrame, per_language: int = 4000, languages: int = 1000) -> Mixture:
    """Fit a Mixture on rows of `docs` (doc_id, lang, text) with a language and a letter in the text.

    per_language bounds (in expectation) the documents taken of a language, chosen by a hash of doc_id and read whole.
    All languages are learnt; more than `languages` are refused, since the model, of languages x BUCKETS numbers, goes
    through the driver to all tasks.
    """
    docs = docs.filter(F.col("lang").isNotNull())
    sizes = docs.groupBy("lang").count()
    if (found := sizes.count()) > languages:
        raise ValueError(f"{found} languages exceed the bound of {languages}")
    take = F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < F.ceil(F.lit(_SCALE) * F.least(F.lit(1.0), F.lit(per_language) / F.col("count")))
    sample = docs.join(F.broadcast(sizes), "lang").filter(take).select("lang", text_or_empty().alias("text"))
    return Mixture(learn_counts(sample).toPandas())


def identify(docs: DataFrame, model: Mixture, penalty: float = 2.0, least: float = 0.02) -> DataFrame:
    """`docs` with lang_pred (`und` if the text is null or has no letter), score (0 to 1), languages and shares."""
    return docs.withColumn("_lang", _predictor(docs, model, penalty, least)(text_or_empty())).select(*docs.columns, "_lang.*")


def _predictor(docs: DataFrame, model: Mixture, penalty: float = 2.0, least: float = 0.02):
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, languages array<string>, shares array<double>")
    def predict(texts: pa.Array) -> pa.Array:
        rows = (spread.value.languages(x.as_py(), penalty, least) for x in texts)
        kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang_pred", "score", "languages", "shares"])

    return predict


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares: one row per row of `docs`.

    The model learns from documents whose crc32(doc_id) mod 3 is not 1 (a null doc_id is neither learnt from nor held
    out). Without any document to learn from, everything is `und`. Columns beside doc_id, text and lang are ignored.
    """
    model = train(docs.filter(fold(3) != 1).select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "shares")


def keep_known_languages(docs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with a determined language (one of `allowed`, if given), with their columns unchanged."""
    model = train(docs.filter(fold(3) != 1).select("doc_id", "lang", "text"))
    name = max(docs.columns, key=len) + "_"  # of no column
    found = docs.withColumn(name, _predictor(docs, model)(text_or_empty())["lang_pred"])
    lang = F.col(f"`{name}`")
    return found.filter(lang != UNDETERMINED if allowed is None else lang.isin(allowed)).drop(lang)
