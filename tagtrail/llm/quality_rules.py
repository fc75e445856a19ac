"""Quality rules: fixed base rules and a calibrated logistic regression on hashed word and character n-grams.

The text of a document is seen as bags: words, word pairs, and windows of code points of WINDOWS sizes (where the text ends,
line ends follow), each hashed to its own range of weights and averaged, so that the length of a text does not matter. The regression is fitted in one
task on a bounded sample of labelled rows (``rows``), calibrated on the tenth parts that the fit has not seen, and sent to
the tasks as one array of fixed size. Scoring runs in Arrow batches and each document's score depends on it alone.

Null or empty text: no words, the base rules reject it. Repeated rows are judged alike. Without labels of both kinds
there is nothing to learn and only the base rules decide. Very long texts are judged whole, an empty table gives an empty
one. Columns to carry that are named like a new one give way to it; the pipeline renames them for the way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagtrail.llm.texts import flat_rows, hash_words, labelled_sample, map_texts, offsets_of, segment_sums, split_words

BITS = 15
WINDOWS = (3, 5)
BAGS = 2 + len(WINDOWS)
MIN_WORDS = 50
KEEP_AT = 0.5
SAMPLE_ROWS = 2000
#: Entries of texts that a step of the fit multiplies at once.
FIT_ENTRIES = 1 << 18
SYMBOLS = "#*$%&|<>"
#: Weight of a bag's average; averages over hundreds of entries are small numbers.
SCALE = 30.0

_BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    known: bool = True


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeats += bool(line.strip(" \t\x0b\x0c\r"))
        else:
            seen.add(line)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), repeats, repeated_window_words(words)


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    often = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(often)] |= often
    return int(covered.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def bags(texts: list[str], words: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per bag the hashed positions of all texts in a row, and where each text begins."""
    mask = np.uint64((1 << BITS) - 1)
    flat = hash_words([w for ws in words for w in ws])
    starts = offsets_of([len(ws) for ws in words])
    spread = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)) & mask
    out = [(spread(flat), starts)]
    pairs = (flat[:-1] * np.uint64(1_000_003) + flat[1:]) if len(flat) else flat
    inside = np.ones(len(pairs), dtype=bool)
    edges = starts[1:-1] - 1
    inside[edges[(edges >= 0) & (edges < len(pairs))]] = False
    out.append((spread(pairs[inside]), offsets_of([max(0, len(ws) - 1) for ws in words])))
    gap = "\n" * (max(WINDOWS) - 1)
    data = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    begins = offsets_of([len(t) for t in texts])
    own = np.ones(len(data), dtype=bool)  # windows that begin in a gap may reach into the next text
    own[(begins[1:] + len(gap) * np.arange(len(texts)))[:, None] + np.arange(len(gap))] = False
    for n in WINDOWS:
        h = np.zeros(len(data), dtype=np.uint64)
        for k in range(n):
            h[: len(data) - k] = h[: len(data) - k] * np.uint64(1_000_003) + data[k:]
        out.append((spread(h[own]), begins))
    return [((p + np.uint64(k << BITS)).astype(np.int64), o) for k, (p, o) in enumerate(out)]


def margins(texts: list[str], words: list[list[bytes]], model: Model) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    for at, offsets in bags(texts, words):
        total += SCALE * segment_sums(model.weights[at], offsets) / np.maximum(1, np.diff(offsets))
    return total


def probabilities(texts: list[str], words: list[list[bytes]], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margins(texts, words, model) + model.shift, -40, 40)))


def sparse_rows(texts: list[str], part) -> dict:
    """The averaged bags of each text as (position, value) lists, for the fit."""
    found = bags(texts, [split_words(t) for t in texts])
    at, value = [], []
    for k in range(len(texts)):
        own = [(p[o[k] : o[k + 1]], o[k + 1] - o[k]) for p, o in found]
        parts = [np.unique(p, return_counts=True) + (n,) for p, n in own]
        at.append(np.concatenate([p for p, _, _ in parts]).astype(np.int32))
        value.append(np.concatenate([c * (SCALE / max(1, n)) for _, c, n in parts]).astype(np.float32))
    return {"at": at, "value": value}


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, rounds: int = 120) -> Model:
    """Fit on at most ``rows`` labelled rows; tenths 8 and 9 of them only calibrate.

    The bags of the sample meet in one task, which fits there; the driver sees the weights only.
    """
    sample = labelled_sample(documents, labels, "quality", rows)
    entries = map_texts(sample, sparse_rows, "at array<int>, value array<float>", carry=["doc_id", "label", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        got = pa.Table.from_batches(held).sort_by("doc_id")
        del held
        label, part, flat = np.array(got["label"], dtype=float), np.array(got["part"]), flat_rows(got)
        del got
        model = fit_rows(*flat, label, part, rounds)
        weights = pa.array([model.weights.tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([weights, *(pa.array([x]) for x in (model.bias, model.slope, model.shift, model.known))], names=["weights", "bias", "slope", "shift", "known"])

    fitted = entries.repartition(1).mapInArrow(run, "weights binary, bias double, slope double, shift double, known boolean").first()
    if fitted is None:
        return no_model()
    return Model(np.frombuffer(fitted["weights"], dtype=np.float32), fitted["bias"], fitted["slope"], fitted["shift"], fitted["known"])


def no_model() -> Model:
    return Model(np.zeros(BAGS << BITS, dtype=np.float32), 0.0, 1.0, 0.0, known=False)


def fit_rows(column: np.ndarray, entry: np.ndarray, offsets: np.ndarray, label: np.ndarray, part: np.ndarray, rounds: int) -> Model:
    rows = len(label)
    size = BAGS << BITS
    if len(set(label.tolist())) < 2:
        return no_model()
    # So many texts at a time that the products of their entries stay small beside the entries.
    cuts = np.unique([0, *np.searchsorted(offsets[:-1], np.arange(FIT_ENTRIES, offsets[-1], FIT_ENTRIES)), rows]).tolist()
    parts = [(a, b, slice(offsets[a], offsets[b])) for a, b in zip(cuts[:-1], cuts[1:])]
    row = lambda a, b: np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))

    def sums(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row(a, b), entry[own] * w[column[own]], minlength=b - a) for a, b, own in parts])

    learn = part < 8
    if len(set(label[learn].tolist())) < 2 or len(set(label[~learn].tolist())) < 2:
        learn = np.ones(len(label), dtype=bool)
    weight = np.where(learn, 1.0, 0.0) / learn.sum()
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        pull = weight * (1 / (1 + np.exp(-np.clip(sums(w) + b, -40, 40))) - label)
        pulls = np.zeros(size)
        for first_row, last_row, own in parts:
            np.add.at(pulls, column[own], entry[own] * pull[first_row:last_row][row(first_row, last_row)])
        grad = np.append(pulls + 1e-5 * w, pull.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = sums(w) + b
    held = ~learn if not learn.all() else learn
    slope, shift = calibrate(z[held], label[held])
    return Model(w.astype(np.float32), float(b), slope, shift)


def calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve through held-out margins, with targets drawn in from 0 and 1 by the size of each class."""
    ones, zeros = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * z).sum(), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-9 or not math.isfinite(slope):
            break
    return (float(slope), float(shift)) if math.isfinite(slope) and slope > 0 else (1.0, 0.0)


def judge(documents: DataFrame, model: Model, keep_at: float = KEEP_AT, carry=("doc_id",), only_kept: bool = False) -> DataFrame:
    """The base counts, ``probability`` and ``kept`` of every row of ``documents``; with ``only_kept`` the kept rows."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str], part) -> dict:
        own = shared.value
        words = [split_words(t) for t in texts]
        counts = [base_counts(t, w) for t, w in zip(texts, words)]
        failed = [base_failed(c[0], c[4]) for c in counts]
        p = probabilities(texts, words, own) if own.known else np.ones(len(texts))
        columns = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zip(*counts)))
        kept = [not f and bool(x >= keep_at) for f, x in zip(failed, p)]
        return columns | {"base_failed": failed, "probability": p, "kept": kept}

    return map_texts(documents, run, f"{_BASE}, probability double, kept boolean", carry=carry, keep="kept" if only_kept else None)
