"""Text quality learnt from trusted positives and unlabelled web text.

The classifier minimises the non-negative unbiased risk of positive-unlabelled learning:
    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))
with the sigmoid loss, where R_p(+) and R_p(-) are the losses of trusted positives taken
as positive and as negative, and R_u(-) that of unlabelled texts taken as negative. A step
that would push the second part below zero goes back instead. The class prior is estimated
from positives and unlabelled texts alone: a first classifier tells the two apart, and the
prior is the least ratio of the unlabelled to the positive share above any score (best bin
estimation, on texts held back from that classifier). Texts labelled as bad are not used.

Inputs are properties of the text itself: character and punctuation shares, word and line
lengths, repetition. They are standardised on the sample and go through a small network.
Both samples are bounded (`POSITIVES`, `UNLABELLED`); every whole text is scored where it
lies, without a shuffle.

Defined cases: a null text counts as empty; an empty text has zero for every property and
is scored like any other; repeated rows are scored each by itself; without positives or
unlabelled texts every score is 0.5; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import blocks, lists, texts
from noticeworks.llm.labelled import at_most, fold, label_rows

#: Trusted positives and unlabelled texts at most that the model is fitted on.
POSITIVES = 8_000
UNLABELLED = 16_000
FOLDS, HELD_OUT = 3, 1
SIGNS = b"#*$%&|<>!?.,;:-_=+/\\@~^'\"()[]{}"
HIDDEN = 24

_KINDS = np.zeros(256, np.int64)  # 0 other signs, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 beyond ASCII
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[[9, 11, 12, 13, 32]] = 4
_KINDS[10] = 5
_KINDS[128:] = 6


def properties(text: bytes) -> list[float]:
    """What is measured on one text."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, weights=histogram, minlength=7) / size
    shares = histogram[histogram > 0] / size
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = Counter(zip(words, words[1:]))
    triples = Counter(zip(words, words[2:], words[4:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    signs = [min(5.0, histogram[sign] / n) for sign in SIGNS]
    return [
        *signs,
        *kinds,
        float(-(shares * np.log(shares)).sum()),
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(lengths.max()),
        len(counts) / n,
        np.log(max(len(counts), 1)) / np.log(n + 1),
        (max(counts.values()) if counts else 0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        sum(c for c in triples.values() if c > 1) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(lines)),
        np.log1p(len(words) / max(len(lines), 1)),
    ]


WIDTH = len(properties(b""))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float


def _margin(x: np.ndarray, layers) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    return hidden @ layers[2] + layers[3], hidden


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _train(positive: np.ndarray, unlabelled: np.ndarray, slopes, seed: int, rounds: int) -> list[np.ndarray]:
    """Adam over mini-batches; `slopes` gives the derivatives of the risk by the margins."""
    dice = np.random.default_rng(seed)
    layers = [dice.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), dice.normal(0, 0.2, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    for _ in range(rounds):
        for chosen in np.array_split(dice.permutation(len(unlabelled)), max(1, len(unlabelled) // 1024)):
            own = dice.integers(0, len(positive), max(1, min(len(positive), len(chosen))))
            x = np.concatenate([positive[own], unlabelled[chosen]])
            margin, hidden = _margin(x, layers)
            slope = np.concatenate(slopes(margin[: len(own)], margin[len(own) :]))
            back = np.outer(slope, layers[2]) * (hidden > 0)
            grads = [x.T @ back, back.sum(0), hidden.T @ slope, slope.sum(keepdims=True)]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + 1e-4 * layers[k] * (k in (0, 2))
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                layers[k] = layers[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 12) -> float:
    """Best bin estimation: the least ratio of unlabelled to positive shares above a score."""

    def apart(p, u):
        return (_sigmoid(p) - 1) / len(p), _sigmoid(u) / len(u)

    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    layers = _train(positive[:half_p], unlabelled[:half_u], apart, 5, rounds)
    p = np.sort(_margin(positive[half_p:], layers)[0])
    u = np.sort(_margin(unlabelled[half_u:], layers)[0])
    share_p = 1 - np.arange(len(p)) / len(p)
    share_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    # Standard bound on the error of a share found on n rows.
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    upper = (share_u + slack) / share_p
    best = int(np.argmin(upper))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.98))


def risk_slopes(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by the margins of positives and unlabelled of the non-negative risk with sigmoid losses.

    Where the estimated risk of negatives falls below zero, only that part is driven up again.
    """
    loss_p, loss_u = _sigmoid(p), _sigmoid(u)  # losses of the margins taken as negative
    curve_p, curve_u = loss_p * (1 - loss_p) / len(p), loss_u * (1 - loss_u) / len(u)
    if loss_u.mean() - prior * loss_p.mean() >= 0:
        return -2 * prior * curve_p, curve_u
    return prior * curve_p, -curve_u


def learn(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 40, prior: float | None = None) -> Model:
    """Fits the network by the non-negative risk; estimates the prior unless it is given."""
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(0), both.std(0) + 1e-3
    positive, unlabelled = np.clip((positive - centre) / scale, -8, 8), np.clip((unlabelled - centre) / scale, -8, 8)
    prior = estimate_prior(positive, unlabelled) if prior is None else prior

    def slopes(p, u):
        return risk_slopes(p, u, prior)

    return Model(centre, scale, _train(positive, unlabelled, slopes, 11, rounds), prior)


def measured(documents: DataFrame, *keys: str) -> DataFrame:
    """The properties of every text, with the columns named in `keys`."""

    def run(batches):
        for block in blocks(batches, "text"):
            rows = np.array([properties(text) for text in texts(block.column(block.num_columns - 1))])
            yield pa.record_batch(
                [*block.columns[:-1], lists(rows.ravel(), [WIDTH] * block.num_rows)],
                names=[*block.schema.names[:-1], "properties"],
            )

    rows = documents.select(*keys, "text")
    kept = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, properties array<double>")


def _matrix(rows: DataFrame) -> np.ndarray:
    """The properties of a bounded sample as rows of a matrix, in the order of the ids."""
    found = measured(rows, "doc_id").toArrow().combine_chunks().sort_by("doc_id")
    values = found.column("properties").combine_chunks().flatten().to_numpy()
    return values.reshape(-1, WIDTH)


def fit(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learns from bounded samples of trusted positives and of documents that carry no label to learn from."""
    known = label_rows(labels, "quality", FOLDS, HELD_OUT)
    trusted = at_most(known.where("label = 1").select("doc_id"), positives, seed=4)
    rest = at_most(documents.select("doc_id").join(known, "doc_id", "left_anti").distinct(), unlabelled, seed=5)
    found = [_matrix(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")) for ids in (trusted, rest)]
    if min(map(len, found)) < 4:
        return None
    # The halves that the prior is estimated on must be alike: shuffled once, repeatably.
    return learn(*(rows[np.random.default_rng(7).permutation(len(rows))] for rows in found))


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batches):
        for block in blocks(batches, "text"):
            scores = np.full(block.num_rows, 0.5)
            if model is not None:
                rows = np.array([properties(text) for text in texts(block.column(1))])
                scores = _sigmoid(_margin(np.clip((rows - model.centre) / model.scale, -8, 8), model.layers)[0])
            yield pa.record_batch([block.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return rows.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
