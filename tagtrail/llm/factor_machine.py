"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a score are the words of the whole text (hashed to 2**BITS columns, damped counts of unit length), statistics
of its structure, and the metadata column ``n_chars`` where the table has it. Labels, language, source and ids are no
inputs. A score takes time linear in the words, as the sum of pair products of a factor is half of (square of the sum
minus sum of the squares). The machine is fitted on the driver on a bounded sample of labelled rows.

Null or empty text: all word columns are empty and the statistics decide; every row gets a score. Repeated rows score
alike. Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.llm.texts import flat_rows, hash_words, labelled_sample, map_texts, offsets_of, segment_sums, split_words

BITS = 14
RANK = 8
SAMPLE_ROWS = 4000
STATISTICS = 12
METADATA = "_stated_chars"


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    known: bool = True


def statistics(text: str, words: list[bytes], n_chars: float | None) -> list[float]:
    """Shares and damped sizes between 0 and about 2; the last is 1 for an empty text."""
    n = len(words)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    upper, lower, leads = counts[65:91].sum(), counts[97:123].sum(), counts[192:].sum()
    of = lambda chars: counts[list(chars.encode())].sum()
    lines = text.split("\n")
    return [
        (upper + lower + leads) / max(1, len(text)),
        upper / max(1, upper + lower),
        counts[48:58].sum() / max(1, len(text)),
        of("#*$%&|<>{}[]\\^~=+_@") / max(1, n),
        of("!?") / max(1, n),
        of(".,;:") / max(1, n),
        len(set(words)) / max(1, n),
        sum(map(len, words)) / max(1, n) / 10,
        np.log1p(n) / 8,
        len(set(lines)) / len(lines),
        np.log1p(max(0.0, n_chars or 0.0)) / 10,
        float(n == 0),
    ]


def inputs(texts: list[str], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and values of all texts in a row, and where each text begins."""
    at, value, sizes = [], [], []
    for text, chars in zip(texts, n_chars):
        words = split_words(text)
        columns, counts = np.unique(hash_words(words) % np.uint64(1 << BITS), return_counts=True)
        damped = np.log1p(counts)
        own = statistics(text, words, chars)
        at += [columns.astype(np.int64), np.arange(1 << BITS, (1 << BITS) + len(own))]
        value += [damped / max(1e-9, np.sqrt((damped * damped).sum())), np.array(own)]
        sizes.append(len(columns) + len(own))
    return np.concatenate(at), np.concatenate(value), offsets_of(sizes)


def margins(at: np.ndarray, value: np.ndarray, offsets: np.ndarray, m: Machine) -> np.ndarray:
    products = m.factors[at] * value[:, None]
    sums, squares = segment_sums(products, offsets), segment_sums(products * products, offsets)
    return m.bias + segment_sums(m.linear[at] * value, offsets) + 0.5 * (sums * sums - squares).sum(axis=1)


def _metadata(documents: DataFrame) -> DataFrame:
    """``documents`` with the number of characters it states for itself, null where it states none."""
    stated = F.col("n_chars").try_cast("double") if "n_chars" in documents.columns else F.lit(None).cast("double")
    return documents.withColumn(METADATA, stated)


def _chars(part: pa.RecordBatch) -> list:
    return part.column(METADATA).to_pylist()


def fit(documents: DataFrame, labels: DataFrame, where: Column | None = None, rows: int = SAMPLE_ROWS, epochs: int = 12) -> Machine:
    """Fit on at most ``rows`` labelled rows among those that ``where`` (on doc_id) allows."""
    documents = _metadata(documents)
    sample = labelled_sample(documents, labels, "quality", rows, where)

    def run(texts: list[str], part: pa.RecordBatch) -> dict:
        at, value, offsets = inputs(texts, _chars(part))
        cut = offsets[1:-1]
        return {"at": np.split(at.astype(np.int32), cut), "value": np.split(value.astype(np.float32), cut)}

    got = map_texts(sample, run, "at array<int>, value array<float>", carry=["doc_id", "label", METADATA]).toArrow().sort_by("doc_id")
    at, value, offsets = flat_rows(got)
    return fit_rows(np.split(at, offsets[1:-1]), np.split(value, offsets[1:-1]), np.array(got["label"], dtype=float), epochs)


def fit_rows(at: list, value: list, label: np.ndarray, epochs: int, batch: int = 64) -> Machine:
    size = (1 << BITS) + STATISTICS
    rng = np.random.default_rng(11)
    linear, factors, bias = np.zeros(size), rng.normal(0, 0.05, (size, RANK)), 0.0
    if len(set(label.tolist())) < 2:
        return Machine(0.0, linear, factors * 0, known=False)
    rows = [(np.asarray(a, dtype=np.int64), np.asarray(v, dtype=np.float64)) for a, v in zip(at, value)]
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for chosen in np.array_split(order, max(1, len(order) // batch)):
            a, v = np.concatenate([rows[k][0] for k in chosen]), np.concatenate([rows[k][1] for k in chosen])
            offsets = offsets_of([len(rows[k][0]) for k in chosen])
            z = margins(a, v, offsets, Machine(bias, linear, factors))
            pull = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[chosen]) / len(chosen)
            each = np.repeat(pull, np.diff(offsets))
            own = factors[a]
            sums = np.repeat(segment_sums(own * v[:, None], offsets), np.diff(offsets), axis=0)
            slope = each[:, None] * v[:, None] * (sums - own * v[:, None])
            columns, back = np.unique(a, return_inverse=True)
            g = np.bincount(back, each * v, minlength=len(columns)) + 1e-6 * linear[columns]
            gf = np.stack([np.bincount(back, slope[:, k], minlength=len(columns)) for k in range(RANK)], axis=1) + 1e-5 * factors[columns]
            seen_linear[columns] += g * g
            seen_factors[columns] += gf * gf
            seen_bias += pull.sum() ** 2
            linear[columns] -= 0.1 * g / np.sqrt(seen_linear[columns])
            factors[columns] -= 0.05 * gf / np.sqrt(seen_factors[columns])
            bias -= 0.1 * pull.sum() / np.sqrt(seen_bias)
    return Machine(float(bias), linear, factors)


def score(documents: DataFrame, machine: Machine, carry=("doc_id",)) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (1 from 0.5) of every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(texts: list[str], part: pa.RecordBatch) -> dict:
        own = shared.value
        if not own.known:
            return {"score": [0.5] * len(texts), "predicted": [1] * len(texts)}
        z = margins(*inputs(texts, _chars(part)), own)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    carry = [c for c in carry if c not in ("score", "predicted")]
    got = map_texts(_metadata(documents), run, "score double, predicted int", carry=[*dict.fromkeys([*carry, METADATA])])
    return got.drop(METADATA)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
