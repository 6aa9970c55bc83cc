"""Toxicity of documents by multiple-instance learning.

Labels are known for documents only, yet a few sentences decide them. Each sentence s gets a
logistic score from the features of its words, and a document is toxic if any of its
sentences is: P = 1 - prod(1 - p_s), the noisy-or. The weights are fitted to document labels
through that formula, so the gradient goes to the sentences that explain a label; afterwards
the same sentence scores point out the offending ones.

A feature is a word, or its first three to six or last four characters, so inflected forms
share evidence. The score of a sentence is a bias plus the sum over its words, hence a word's
sum is computed once per task and looked up afterwards.

The model is fitted on the driver, on ``sample_docs`` labelled documents at most (half of
each label where there are enough, drawn by a hash of the id, weighted back to the true
proportions); it keeps ``max_features`` weights at most, which is what the tasks are sent.
Scoring reads every document where it lies and shuffles nothing.

Null and empty texts have one empty sentence and get the score of the bias. Rows without an
id are scored and never learned from. Ids labelled more than once count as toxic if any label
says so; null labels are ignored. Without labels of both kinds every score is the share of
toxic labels (0 if there are none). Equal texts get equal scores. An empty table gives an
empty table. Ids, languages, sources and labels are never features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playcohort.llm.common import add_columns, fresh, text_of

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W_]+")
#: Sums of words that a task remembers at most.
MEMO_WORDS = 500_000


def features(word: str) -> list[str]:
    """The word, its beginnings and its ending, marked apart."""
    found = [word]
    found += [f"{word[:n]}-" for n in range(3, 7) if n < len(word)]
    if len(word) > 4:
        found.append(f"-{word[-4:]}")
    return found


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences: up to closing marks or the end of a line."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        value = self.memo.get(word)
        if value is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            value = self.memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence."""
        return [(a, b, logistic(self.logit(text[a:b]))) for a, b in sentences(text)]

    def logit(self, sentence: str) -> float:
        return self.bias + sum(map(self.word, WORD.findall(sentence.lower())))

    def score(self, text: str) -> float:
        log_clean = sum(softplus(self.logit(text[a:b])) for a, b in sentences(text))
        return -math.expm1(-log_clean)


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def fit(
    texts: list[str],
    labels: list[int],
    weights: list[float],
    max_features: int,
    min_docs: int = 4,
    min_evidence: float = 5.0,
    rounds: int = 300,
    ridge: float = 2e-4,
) -> Model:
    """Noisy-or likelihood by full-batch Adam over word features.

    Features take part when they are in ``min_docs`` documents of the sample and their share
    of toxic ones is ``min_evidence`` standard deviations off: rare words that happen to be in
    a few toxic documents would otherwise explain their labels.
    """
    y, importance = np.asarray(labels, dtype=bool), np.asarray(weights)
    rate = float(importance[y].sum() / importance.sum()) if len(y) else 0.0
    if not y.any() or y.all():
        rate = min(max(rate, 1e-9), 1 - 1e-9)
        return Model(bias=math.log(rate / (1 - rate)))
    # Tokens of all sentences in a row; words and features are numbered.
    words: dict[str, int] = {}
    tokens, lengths, per_doc = [], [], []
    doc_counts: Counter = Counter()
    positive_counts: Counter = Counter()
    for text, toxic in zip(texts, labels):
        spans = sentences(text)
        per_doc.append(len(spans))
        seen: set[str] = set()
        for a, b in spans:
            found = WORD.findall(text[a:b].lower())
            lengths.append(len(found))
            tokens += [words.setdefault(w, len(words)) for w in found]
            seen.update(found)
        of_doc = {f for w in seen for f in features(w)}
        doc_counts.update(of_doc)
        if toxic:
            positive_counts.update(of_doc)
    positives, total = int(y.sum()), len(y)

    def evidence(feature: str) -> float:
        """How far the toxic documents among those with the feature are from their share, in deviations."""
        n, share = doc_counts[feature], positives / total
        return abs(positive_counts[feature] - n * share) / math.sqrt(n * share * (1 - share))

    kept = [f for f, n in doc_counts.items() if n >= min_docs and evidence(f) >= min_evidence]
    kept.sort(key=lambda f: (-evidence(f), f))
    number = {f: i for i, f in enumerate(kept[:max_features])}
    rows, columns = [], []
    for word, i in words.items():
        for f in features(word):
            if f in number:
                rows.append(i)
                columns.append(number[f])
    rows, columns, tokens = (np.asarray(x, dtype=np.int64) for x in (rows, columns, tokens))
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    doc = np.repeat(np.arange(total), per_doc)
    size = len(number)
    theta = np.zeros(size + 1)
    theta[-1] = math.log(rate / (1 - rate)) - math.log(max(1.0, len(doc) / total))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        of_word = np.bincount(rows, theta[columns], len(words))
        z = theta[-1] + np.bincount(sentence, of_word[tokens], len(lengths))
        z = np.clip(z, -60, 60)
        clean = np.bincount(doc, np.logaddexp(0, z), total)
        # d loss / d z_s is p_s for a clean document and -p_s exp(-A) / (1 - exp(-A)) for a toxic one.
        pull = np.where(y, -1 / np.expm1(np.maximum(clean, 1e-12)), 1.0) * importance / importance.sum()
        dz = pull[doc] / (1 + np.exp(-z))
        by_word = np.bincount(tokens, dz[sentence], len(words))
        slope = np.append(np.bincount(columns, by_word[rows], size), dz.sum())
        slope[:-1] += ridge / total * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    strong = {f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-3}
    return Model(bias=float(theta[-1]), weights=strong)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    usable: Column | None = None,
    sample_docs: int = 4000,
    max_features: int = 20_000,
    seed: int = 0,
) -> Model:
    """Fit a model on the labelled rows of ``docs``; ``usable`` is a condition on the labels' id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    counts = {row["_y"]: row["n"] for row in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    # The ids are few by parameter, so they go to the documents.
    draw = F.xxhash64(F.lit(seed), "_id")
    picked = [known.where(F.col("_y") == k).orderBy(draw, "_id").limit(sample_docs // 2) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = (
        docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text"))
        .join(ids, F.col("_doc") == F.col("_id"))
        .orderBy(F.xxhash64(F.lit(seed), "_doc", "_text"))
        .limit(sample_docs)
        .select("_text", "_y")
        .collect()
    )
    drawn = Counter(row["_y"] for row in rows)
    weights = [counts[row["_y"]] / drawn[row["_y"]] for row in rows]
    return fit([row["_text"] for row in rows], [row["_y"] for row in rows], weights, max_features)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the noisy-or score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: list) -> dict[str, list]:
        return {name: [shared.value.score(text or "") for text in texts]}

    return add_columns(docs, [text_col], scores, T.StructType().add(name, "double"))


def locate(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5, name: str = "offending") -> DataFrame:
    """``docs`` with the sentences that score at least ``least``: start, end (code points), score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType().add("start", "long").add("end", "long").add("score", "double")

    def found(texts: list) -> dict[str, list]:
        return {
            name: [
                [{"start": a, "end": b, "score": p} for a, b, p in shared.value.sentence_scores(text or "") if p >= least]
                for text in texts
            ]
        }

    return add_columns(docs, [text_col], found, T.StructType().add(name, T.ArrayType(span)))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with their columns."""
    name = fresh(docs, "_score")
    return score(docs, model, text_col, name).where(F.col(name) < limit).drop(name)
