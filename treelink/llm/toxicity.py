"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding homoglyphs and digit substitutions.

The lexicon and its weights are learned from labelled rows: terms are whole words and word beginnings whose document frequency is
much higher among toxic rows. Hits inside an exception phrase don't count. A score is a logistic function of the summed weight and
of that weight per word.

Defined results: null and empty texts have no hits and get the score of a text without hits; a null doc_id is kept, and is never
held out; repeated rows are scored one by one; an empty table gives no rows; without labels the lexicon is empty and every score
is below 0.5. Other columns of the input never reach a score.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name

# Letters of other scripts and signs that look like Latin letters, and digits that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which a listed word is meant plainly.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "circus clown", "clown fish", "pond scum")

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {0x200B: None, 0x200C: None, 0x200D: None, 0x00AD: None, 0xFEFF: None}
_FOLD |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B) if chr(c - 0xFEE0).isalpha()}
_ENDS = re.compile(r"(?<![^\s])[!|@$]+|[!|]+(?![^\s])")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """Words of a text, lower case, with look-alike letters and digits replaced. Marks at the ends of words stay marks."""
    if not text:
        return []
    text = text.lower()
    if "!" in text or "|" in text or "@" in text or "$" in text:
        text = _ENDS.sub(" ", text)
    return _WORDS.findall(text.translate(_FOLD))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _terms(words: list[str]) -> set[str]:
    """Whole words, ended by a blank, and beginnings of four to six letters of longer words."""
    out = set()
    for w in set(words):
        if 3 <= len(w) <= 24:
            out.add(w + " ")
        for n in (4, 5, 6):
            if len(w) > n:
                out.add(w[:n])
    return out


class Lexicon:
    """weights: of terms, which end with a blank if whole words are meant; coef: of the constant, the summed weight and the density."""

    def __init__(self, weights: dict[str, float], coef: tuple[float, float, float] = (-2.0, 0.0, 0.0), exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.coef, self.exceptions = dict(weights), tuple(coef), tuple(exceptions)
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.coef, self.exceptions

    def __setstate__(self, state):
        self.weights, self.coef, self.exceptions = state
        self._automaton = None

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "coef": self.coef, "exceptions": self.exceptions}, ensure_ascii=False, sort_keys=True)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(" " + term, (len(term.rstrip(" ")), w, term.endswith(" ")))
            for phrase in self.exceptions:
                folded = " ".join(fold(phrase))
                if folded:
                    a.add_word(f" {folded} ", (len(folded), -1.0, True))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, words: list[str]) -> float:
        """Summed weight; of the terms that begin one word, the heaviest counts."""
        a = self.automaton()
        if not words or not len(a):
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w, whole) in a.iter(f" {' '.join(words)} "):
            start = end - n - (1 if whole else 0) + 1
            if w < 0:
                spared.append((start, start + n))
            elif w > best.get(start, 0.0):
                best[start] = w
        return sum(w for s, w in best.items() if not any(x <= s < y for x, y in spared)) if best else 0.0

    def features(self, text: str | None) -> tuple[float, float]:
        words = fold(text)
        total = self.hits(words)
        return (math.log1p(total), math.log1p(100.0 * total / len(words))) if total else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton's steps; classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    sample = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (sample * (p - y)) + ridge * 1e-1 * w * [0, 1, 1]
        h = (x * (sample * p * (1 - p))[:, None]).T @ x + ridge * 1e-1 * np.diag([1e-6, 1, 1])
        step = np.linalg.solve(h + 1e-9 * np.eye(3), g)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 5_000, min_docs: int = 5, min_ratio: float = 6.0) -> Lexicon:
    """Learn terms, weights and coefficients from labelled rows that are not held out.

    Bound: at most about max_rows labelled rows are read, picked by a hash of doc_id; the lexicon holds at most max_terms terms, the
    heaviest first. Every other row is scored with it but never used to learn.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    share = max_rows / max(1, marked.count())
    if share < 1:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")  # at most about max_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                both[y].update(_terms(fold(text.as_py())))
                both[y][""] += 1
        for y, counted in enumerate(both):
            for i in range(0, len(items := list(counted.items())), 50_000):
                part = items[i : i + 50_000]
                yield pa.record_batch({"term": pa.array([t for t, _ in part], pa.string()), "y": pa.array([y] * len(part), pa.int32()), "n": pa.array([n for _, n in part], pa.int64())})

    pairs = train.select("y", "text").mapInArrow(count, "term string, y int, n long")
    by_term = pairs.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    total = by_term.filter(F.col("term") == "").first()
    if total is None or not total["toxic"]:
        return Lexicon({})
    nt, nc = total["toxic"], max(1, total["clean"])
    weight = F.log(((F.col("toxic") + 0.5) / (nt + 1.0)) / ((F.col("clean") + 0.5) / (nc + 1.0)))
    rows = by_term.filter((F.col("term") != "") & (F.col("toxic") >= min_docs)).withColumn("w", weight).filter(F.col("w") >= math.log(min_ratio)).orderBy(F.desc("w"), "term").limit(max_terms).collect()
    weights = {r["term"]: round(r["w"], 6) for r in rows}
    lexicon = Lexicon(weights)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch({"y": batch.column("y"), "a": pa.array([a for a, _ in found], pa.float64()), "b": pa.array([b for _, b in found], pa.float64())})

    seen = train.select("y", "text").mapInArrow(features, "y int, a double, b double")
    grouped = seen.groupBy("y", F.round("a", 2).alias("a"), F.round("b", 2).alias("b")).agg(F.count("*").alias("n")).orderBy("y", "a", "b").collect()  # at most max_rows rows
    x = np.repeat([[r["a"], r["b"]] for r in grouped], [r["n"] for r in grouped], axis=0)
    lexicon.coef = _fit(x, np.repeat([r["y"] for r in grouped], [r["n"] for r in grouped]).astype(float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs with score and predicted; every whole text is scored. Columns of these names in docs are replaced.

    keep: the columns of docs to return, all by default.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("score", DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.score(t.as_py()) for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*kept, "score"])

    return docs.select(*kept, F.col("text").cast("string").alias(free_name(docs, "text"))).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with just their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
