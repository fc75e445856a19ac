"""Fill-in-the-middle transformation with content-defined chunks that are counted once.

A text is cut into chunks where a rolling hash of its last WINDOW bytes has its low bits zero, so that equal passages
give equal chunks wherever they stand. Of each chunk a summary is kept: how many code points begin in it, whether a
marker lies in it, and the bytes at its two edges that a code point or a marker across the seam would need. Summaries
are cached in each worker under the chunk's bytes themselves, so that a hit is verified by content; the cache holds
CACHE_BYTES and forgets the chunks that were not used for longest. Adding the counts of the chunks in a row tells which
chunk a cut falls into, and only that chunk is looked into again.

The split of a text of n code points is drawn from sha256 of ``1:`` and the decimal id, its first four groups of eight
hexadecimal digits being h1 to h4: the prefix ends after min(h1 % (n + 1), h2 % (n + 1)) code points, the middle after
the larger. A text that is empty, holds a marker, or has h3 % 100 >= RATE stays plain; of the others those with
h4 % 100 < SPM_RATE put the suffix first (spm), the rest the prefix (psm).

Null text is empty and stays plain. A null id is drawn as from ``1:`` alone. Rows of equal id and text are split alike.
Very long texts are handled one at a time. An empty table gives an empty table. Extra columns are kept; one that has the
name of a new column gives way to it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from tagtrail.llm.texts import map_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 90, 20
#: Bytes that the rolling hash sees, bits of it that must be zero, and the shortest and longest chunk.
WINDOW, CUT_BITS, MIN_CHUNK, MAX_CHUNK = 32, 9, 128, 4096
CACHE_BYTES = 16 << 20

_MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_EDGE = max(map(len, _MARKERS)) - 1
_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % k).digest()[:8] for k in range(256)), dtype="<u8")


class Summary(NamedTuple):
    """What is known of a stretch of bytes: code points that begin in it, a marker inside it, its first and last bytes."""

    units: int
    marked: bool
    head: bytes
    tail: bytes

    def then(self, other: Summary) -> Summary:
        """The summary of both stretches in a row; a marker across the seam lies within the bytes at the edges."""
        marked = self.marked or other.marked or _holds_marker(self.tail + other.head)
        return Summary(self.units + other.units, marked, (self.head + other.head)[:_EDGE], (self.tail + other.tail)[-_EDGE:])


EMPTY = Summary(0, False, b"", b"")


def _holds_marker(data: bytes) -> bool:
    return any(m in data for m in _MARKERS)


def _begins(chunk: bytes) -> np.ndarray:
    """Where in the bytes a code point begins: all bytes but those of the form 10xxxxxx."""
    return (np.frombuffer(chunk, dtype=np.uint8) & 0xC0) != 0x80


def summary_of(chunk: bytes) -> Summary:
    return Summary(int(np.count_nonzero(_begins(chunk))), _holds_marker(chunk), chunk[:_EDGE], chunk[-_EDGE:])


def cut_points(data: bytes) -> np.ndarray:
    """Ends of the chunks of a text. The hash at a byte is a sum over the WINDOW bytes up to it, doubled at each step."""
    if len(data) <= MIN_CHUNK:
        return np.array([len(data)] if data else [], dtype=np.int64)
    rolling = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:  # the sum over 2w bytes is that over the last w and, shifted, that over the w before
        grown = rolling.copy()
        grown[width:] += rolling[:-width] << np.uint64(width)
        rolling, width = grown, 2 * width
    low = np.uint64((1 << CUT_BITS) - 1)
    wanted = (np.flatnonzero((rolling >> np.uint64(WINDOW - CUT_BITS)) & low == 0) + 1).tolist()
    ends, last = [], 0
    for end in [*wanted, len(data)]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if end - last >= MIN_CHUNK or end == len(data) > last:
            ends.append(end)
            last = end
    return np.array(ends, dtype=np.int64)


class ChunkCache:
    """Summaries by the content of the chunk, least recently used ones leaving first."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.known = limit, 0, OrderedDict()
        self.hits = self.misses = 0

    def __call__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return found
        self.misses += 1
        found = self.known[chunk] = summary_of(chunk)
        self.held += len(chunk)
        while self.held > self.limit:
            self.held -= len(self.known.popitem(last=False)[0])
        return found


class Chunked(NamedTuple):
    """A text as bytes with the ends of its chunks, the code points up to each end, and the summary of the whole."""

    data: bytes
    ends: np.ndarray
    upto: np.ndarray
    whole: Summary

    def byte_of(self, unit: int) -> int:
        """The byte at which code point number ``unit`` begins, or the end of the text."""
        if unit >= self.whole.units:
            return len(self.data)
        at = int(np.searchsorted(self.upto, unit, side="right"))
        start = int(self.ends[at - 1]) if at else 0
        inside = unit - (int(self.upto[at - 1]) if at else 0)
        return start + int(np.flatnonzero(_begins(self.data[start : int(self.ends[at])]))[inside])


def chunked(text: str, cache: ChunkCache) -> Chunked:
    data = text.encode("utf-8", "surrogatepass")
    ends = cut_points(data)
    whole, upto, start = EMPTY, [], 0
    for end in ends.tolist():
        whole = whole.then(cache(data[start:end]))
        upto.append(whole.units)
        start = end
    return Chunked(data, ends, np.array(upto, dtype=np.int64), whole)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def split(text: str, doc_id: int | None, cache: ChunkCache, rate: int = RATE, spm_rate: int = SPM_RATE) -> dict:
    """The form, the output, and the lengths of a text in code points."""
    known = chunked(text, cache)
    n = known.whole.units
    h1, h2, h3, h4 = draws(doc_id)
    if not n or known.whole.marked or h3 % 100 >= rate:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = known.byte_of(first), known.byte_of(second)
    prefix, middle, suffix = (p.decode("utf-8", "surrogatepass") for p in (known.data[:a], known.data[a:b], known.data[b:]))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    ahead = f"{SUFFIX}{suffix}{PREFIX}{prefix}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}"
    return {"n": n, "form": form, "prefix_chars": first, "middle_chars": second - first, "output": f"{ahead}{MIDDLE}{middle}"}


def rebuilt(output: str, form: str) -> str:
    """The text that an output was made of. Its parts hold no marker, so the first one found of each kind is the seam."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def transform(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE, carry: Sequence[str] | None = None
) -> DataFrame:
    """Each row with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; ``carry`` names the columns to keep."""
    kept = list(documents.columns if carry is None else carry)
    # The id is read from a column of its own, so that one named like a new column still serves.
    source = documents.select(*dict.fromkeys([*kept, text]), documents[doc_id].alias("_fim_id"))
    caches: list[ChunkCache] = []

    def run(texts: list[str], part) -> dict:
        if not caches:
            caches.append(ChunkCache())
        rows = [split(t, i, caches[0], rate, spm_rate) for t, i in zip(texts, part.column("_fim_id").to_pylist())]
        return {k: [r[k] for r in rows] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}

    fields = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_texts(source, run, fields, text, [*kept, "_fim_id"]).drop("_fim_id")


def restore(transformed: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``transformed`` with ``restored``, the text rebuilt from output and form alone."""

    def run(outputs: list[str], part) -> dict:
        return {"restored": [rebuilt(o, f) for o, f in zip(outputs, part.column(form).to_pylist())]}

    return map_texts(transformed, run, "restored string", output, transformed.columns)
