"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of orders 0 to 3: counts of the byte that follows each context.  The code
length of a byte starts at the longest context the tree knows and pays an escape for every order it has
to step down.  The counts are frozen after training, so a code length depends on four bytes only, and
whole texts are scored by table lookups.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample
from .frames import map_rows

ORDER = 3
SAMPLE_PER_LANGUAGE = 512
UNDETERMINED = "und"
CHUNK = 1 << 20
SLOT_BITS = 20
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text holds a letter of Unicode (general category L); fractions, circled digits and such are none."""
    return any(unicodedata.category(m[0])[0] == "L" for m in WORDLIKE.finditer(text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The byte and its three predecessors at every byte, as one 32-bit number; start of each text."""
    parts = [b"\0\0\0" + t.encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    gram = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
    real = np.ones(len(gram), bool)
    for back in (1, 2, 3):  # grams that end in the padding of the next text
        real[starts[1:-1] - back] = False
    sizes = np.diff(starts) - ORDER
    return gram[real], np.concatenate([[0], np.cumsum(sizes)])


class ContextTree:
    """Frozen byte counts of one language."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.orders = []
        for order in range(ORDER, -1, -1):
            key = gram.astype(np.uint64) & np.uint64(256 ** (order + 1) - 1)
            keys, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, weights=count).astype(np.int64)
            contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, weights=n).astype(np.int64)
            distinct = np.bincount(at)
            self.orders.append((keys, n, contexts, total, distinct))

    @staticmethod
    def find(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_keys, wanted).clip(max=len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == wanted, values[at], 0)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the three before it."""
        out = np.zeros(len(gram))
        open_ = np.ones(len(gram), bool)
        for order, (keys, n, contexts, total, distinct) in zip(range(ORDER, -1, -1), self.orders):
            key = gram.astype(np.uint64) & np.uint64(256 ** (order + 1) - 1)
            seen = self.find(keys, n, key)
            all_, kinds = (self.find(contexts, v, key >> np.uint64(8)) for v in (total, distinct))
            known = open_ & (all_ > 0)
            hit = known & (seen > 0)
            out[hit] += np.log2((all_ + kinds)[hit] / seen[hit])
            escape = known & ~hit
            out[escape] += np.log2((all_ + kinds)[escape] / kinds[escape])
            open_ &= ~hit
        out[open_] += 8.0
        return out


@dataclass
class Model:
    """Trees of all languages and the code lengths of all grams they have seen."""

    languages: list[str]
    trees: list[ContextTree]
    known: np.ndarray
    bits: np.ndarray
    slots: np.ndarray

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> Model:
        """``counts``: columns lang, gram, n."""
        languages = sorted(counts["lang"].unique())
        trees = [
            ContextTree(part["gram"].to_numpy(np.uint32), part["n"].to_numpy(float))
            for part in (counts[counts["lang"] == lang] for lang in languages)
        ]
        total = counts.groupby("gram")["n"].sum().sort_values(kind="stable")
        known = total.index.to_numpy(np.uint32)
        bits = np.stack([t.bits(known) for t in trees], axis=1).astype(np.float32) if trees else np.zeros((0, 0))
        slots = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        slots[cls.slot(known)] = np.arange(len(known))  # the most frequent gram of a slot stays
        return cls(languages, trees, known, bits, slots)

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits per position and language."""
        row = self.slots[self.slot(gram)]
        out = self.bits[row]
        other = np.flatnonzero((row < 0) | (self.known[row] != gram))
        if len(other):
            rare, where = np.unique(gram[other], return_inverse=True)
            out[other] = np.stack([t.bits(rare) for t in self.trees], axis=1)[where]
        return out

    def totals(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text in each language."""
        gram, starts = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        step = max(1, CHUNK * 4 // len(self.languages))
        for lo in range(0, len(gram), step):
            hi = min(lo + step, len(gram))
            first = np.searchsorted(starts, lo, "right") - 1
            last = np.searchsorted(starts, hi, "left")
            inside = np.flatnonzero(np.diff(starts[first : last + 1])) + first
            cuts = np.maximum(starts[inside], lo) - lo
            out[inside] += np.add.reduceat(self.code_lengths(gram[lo:hi]), cuts, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of the shortest code (first in order on ties) and its share of the likelihood."""
        names = [UNDETERMINED] * len(texts)
        scores = np.zeros(len(texts))
        lettered = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not lettered or not self.languages:
            return names, scores
        total = self.totals([texts[i] for i in lettered])
        best = total.argmin(axis=1)
        gap = total - total.min(axis=1, keepdims=True)
        share = 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1)
        for i, b, s in zip(lettered, best, share):
            names[i] = self.languages[b]
            scores[i] = s
        return names, scores


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The fold that training never sees; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Context trees from at most ``per_language`` labelled documents of each language.

    ``docs`` holds the rows to learn from.  Per language and hash bucket of the id the row of smallest hash
    is taken, so the sample is spread over the table and the same in every run; its texts are
    counted whole, on the executors.  Rows without lang, text or id teach nothing.
    """
    usable = docs.select("doc_id", "text", "lang").dropna()
    ids = hash_sample(usable.select("doc_id", "lang"), per_language, ["lang"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                gram, n = np.unique(grams(part["text"].tolist())[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    sample = usable.filter(F.col("doc_id").isin(ids)) if ids else usable.limit(0)
    counted = sample.select("text", "lang").mapInPandas(count, "lang string, gram long, n long")
    return Model.fit(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to each row, from its text alone.

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing could be learned.
    Ties go to the first language in order.  Repeated rows get equal answers.  Columns of ``docs`` named
    lang_pred or score are replaced; all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            texts = [None if t is None else str(t) for t in batch["text"]]
            for lo in range(0, len(texts), 1024):
                n, s = shared.value.predict(texts[lo : lo + 1024])
                names += n
                scores.extend(s)
            yield batch.assign(lang_pred=names, score=np.array(scores, dtype=float))

    return map_rows(base, run, "lang_pred string, score double", reads=["text"])
