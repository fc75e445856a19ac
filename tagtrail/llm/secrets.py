"""Secret scans: base patterns, and structures that are reported only after they have been decoded and parsed.

Base kinds, per kind leftmost and non-overlapping, in whole texts: ``assign``, ``access``, ``hex``. The structural pass
takes base64 and hex candidates, decodes them and reports ``key`` for a DER key (nested lengths must add up and the
fields must be those of a PKCS#1, PKCS#8, SEC1 or public key) or an OpenSSH private key (length-prefixed fields), and
``jwt`` for a signed token whose first part is a JSON header with ``alg`` and whose second is a JSON object.

A base64 key may begin wherever a run of base64 letters, a line or the body of a PEM block does. Its own outermost
lengths tell how many letters it has; it must end where a line or the PEM body ends. Its lines may be indented and their
ends written as backslash and letter; between PEM marks anything but base64 letters may stand between lines.

Of a candidate only the headers are decoded, where their lengths say they stand, until one does not fit; runs of letters
are looked up once per text, whatever number of candidates begin in them. So a very long text, or one made of openings
of keys, takes time in proportion to its length.

Spans are kind:start:end in code points, end exclusive, by start and then by kind as listed in KINDS. Null or empty
text: no spans. A secret that occurs twice is two spans; repeated rows are scanned alike.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from tagtrail.llm.texts import map_texts

KINDS = ("assign", "access", "hex", "key", "jwt")

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: Runs of the class are maximal, so that the shortest length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{6,})\.(eyJ[A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
#: What may stand between two lines of a key: a line end, plain or escaped, with blanks; in PEM bodies all but letters.
_LINE_END = re.compile(r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*")
_PEM_GAP = re.compile(r"(?:\\+[nrt]|[^A-Za-z0-9+/_=-])*")
_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
#: A sequence or the opening of OpenSSH fixes the first letters; they follow no other letter but that of an escape.
_KEY_START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-P][A-Za-z0-9+/_-]{6}|b3BlbnNz)")
_KEY_BYTES = 24  # no key is shorter
#: Items that a key, or a field of it, may hold; no key has as many.
MOST_FIELDS, MOST_ITEMS = 16, 64
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_OPENSSH = b"openssh-key-v1\x00"
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 2, 3, 4, 6, 0x30


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


#: A way to read some bytes of what may be a key: from, to; fewer come back where it ends.
Read = Callable[[int, int], bytes]


def may_be_key(tags: list[int]) -> bool:
    """Whether the fields of a key can begin with these tags."""
    n = len(tags)
    forms = ([_INTEGER, _SEQUENCE, _OCTETS], [_INTEGER, _OCTETS])
    return any(tags[: len(f)] == f[:n] for f in forms) or tags == [_SEQUENCE, _BITS][:n] or tags == [_INTEGER] * n and n <= 9


def der_items(read: Read, start: int, stop: int, most: int = MOST_ITEMS, fits: Callable[[list[int]], bool] | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the contents of the items that fill the bytes from ``start`` to ``stop``.

    None where a length does not fit, there are more than ``most`` of them, or their tags do not fit. Only their headers
    are read.
    """
    items, at = [], start
    while at < stop:
        head = read(at, min(at + 6, stop))
        if len(head) < 2 or len(items) == most:
            return None
        size, digits = head[1], 0
        if size & 0x80:
            digits = size & 0x7F
            if not 1 <= digits <= 4 or 2 + digits > len(head):
                return None
            size = int.from_bytes(head[2 : 2 + digits])
        at += 2 + digits
        if at + size > stop:
            return None
        items.append((head[0], at, at + size))
        if fits and not fits([t for t, _, _ in items]):
            return None
        at += size
    return items


def der_key(read: Read, size: int) -> bool:
    """One sequence over all bytes whose fields are those of a private or public key."""
    outer = der_items(read, 0, size, 1)
    if not outer or outer[0][0] != _SEQUENCE:
        return False
    fields = der_items(read, *outer[0][1:], MOST_FIELDS, may_be_key)
    if not fields:
        return False
    tags, long = [f[0] for f in fields], [f[2] - f[1] for f in fields]
    inside = lambda k: der_items(read, *fields[k][1:])
    algorithm = lambda k: (inside(k) or [(0, 0, 0)])[0][0] == _OID
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:  # PKCS#8
        return algorithm(1) and bool(inside(2))
    if tags[:2] == [_INTEGER, _OCTETS] and long[0] == 1 and read(*fields[0][1:]) == b"\x01":  # SEC1
        return long[1] >= 16
    if tags == [_SEQUENCE, _BITS]:  # public key with its algorithm
        return algorithm(0)
    return tags == [_INTEGER] * 9 and long[1] >= 32  # PKCS#1


def openssh_size(read: Read, stop: int) -> int:
    """Bytes of the fixed opening, then cipher, key derivation, its options, a count, as many public parts and the private
    one, all with lengths that end before ``stop``; 0 if the bytes do not begin with these. Only lengths are read."""
    if read(0, len(_OPENSSH)) != _OPENSSH:
        return 0
    at = len(_OPENSSH)

    def part() -> int | None:
        nonlocal at
        size = int.from_bytes(read(at, at + 4))
        if at + 4 + size > stop:
            return None
        at += 4 + size
        return size

    if any(part() is None for _ in range(3)) or at + 4 > stop:
        return 0
    count, at = int.from_bytes(read(at, at + 4)), at + 4
    return at if 1 <= count <= 16 and all(part() for _ in range(count)) and part() else 0


def is_der_key(data: bytes) -> bool:
    return der_key(lambda a, b: data[a:b], len(data))


def is_openssh_key(data: bytes) -> bool:
    return openssh_size(lambda a, b: data[a:b], len(data)) > 0


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padding given or not."""
    body = re.sub(r"[\r\n=]", "", run).replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def json_object(run: str) -> dict | None:
    try:
        value = json.loads(decoded(run) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


class Chain(NamedTuple):
    """Runs of base64 letters that follow each other over line ends; where the last leads on to a known one, ``tail`` says."""

    starts: list[int]
    ends: list[int]
    upto: list[int]
    tail: tuple[Chain, int] | None

    def letters(self, place: int) -> int:
        """Letters behind run number ``place``."""
        own = self.upto[-1] - self.upto[place]
        return own if self.tail is None else own + self.tail[0].starts_at(self.tail[1]) + self.tail[0].letters(self.tail[1])

    def starts_at(self, place: int) -> int:
        return self.upto[place] - (self.upto[place - 1] if place else 0)


class Letters:
    """The base64 letters of a text up to ``stop``, by their number from any start, each run of them looked up once."""

    def __init__(self, text: str, stop: int, gap: re.Pattern):
        self.text, self.stop, self.gap = text, stop, gap
        self.known: dict[int, tuple[Chain, int]] = {}  # by where a run ends

    def _place(self, end: int) -> tuple[Chain, int]:
        """The chain of what follows the run that ends at ``end``, and the place of that run in it."""
        if end not in self.known:
            starts, ends, upto, tail = [end], [end], [0], None
            own = Chain(starts, ends, upto, None)
            while True:
                self.known[ends[-1]] = (own, len(ends) - 1)
                over = self.gap.match(self.text, ends[-1], self.stop)
                m = over and over.end() > ends[-1] and _LETTERS.match(self.text, over.end(), self.stop)
                if not m:
                    break
                starts.append(m.start())
                ends.append(m.end())
                upto.append(upto[-1] + len(m[0]))
                if m.end() in self.known:  # from here on it is a chain that is known
                    tail = self.known[m.end()]
                    break
            if tail is not None:
                own = Chain(starts, ends, upto, tail)
                for n, e in enumerate(ends[:-1]):
                    self.known[e] = (own, n)
        return self.known[end]

    def pieces(self, at: int, first: int, count: int) -> list[tuple[int, int]]:
        """Where in the text the letters ``first`` to ``first + count`` from ``at`` on stand; fewer if there are no more."""
        m = _LETTERS.match(self.text, at, self.stop)
        if not m:
            return []
        out, own = [], m.end() - at
        if first < own:
            out.append((at + first, min(m.end(), at + first + count)))
            count -= out[-1][1] - out[-1][0]
        skip = max(0, first - own)
        chain, place = self._place(m.end())
        while count > 0:
            k = bisect_right(chain.upto, chain.upto[place] + skip, place + 1)
            while k < len(chain.upto) and count > 0:
                a = chain.starts[k] + max(0, chain.upto[place] + skip - chain.upto[k - 1])
                out.append((a, min(chain.ends[k], a + count)))
                count -= out[-1][1] - a
                k += 1
            if count <= 0 or chain.tail is None:
                break
            # The last run of this chain is the run at the tail's place: go on behind it.
            skip = max(0, skip - (chain.upto[-1] - chain.upto[place]))
            chain, place = chain.tail
        return out

    def take(self, at: int, first: int, count: int) -> str:
        return "".join(self.text[a:b] for a, b in self.pieces(at, first, count))

    def reader(self, at: int) -> Read:
        """Bytes of the key whose letters begin at ``at``; only the letters of the bytes that are asked for are decoded."""

        def read(a: int, b: int) -> bytes:
            group = a // 3
            run = self.take(at, 4 * group, 4 * (-(-b // 3) - group))
            return _longest(run)[a - 3 * group : b - 3 * group]

        return read

    def has(self, at: int, count: int) -> bool:
        return count <= self.stop - at and bool(self.pieces(at, count - 1, 1))


def key_end(letters: Letters, at: int) -> int:
    """Where the base64 key ends that begins at ``at``, or 0 if none does."""
    text, stop, read = letters.text, letters.stop, letters.reader(at)
    ssh = text[at] == "b"
    if ssh:
        size = openssh_size(read, stop - at)
    else:
        head = read(0, 6)
        digits = head[1] & 0x7F if len(head) == 6 and head[1] & 0x80 else 0
        size = 0 if len(head) < 6 or digits > 4 else 2 + digits + (int.from_bytes(head[2 : 2 + digits]) if digits else head[1])
    count = -(-4 * size // 3)
    if size < _KEY_BYTES or not letters.has(at, count):
        return 0
    if not ssh and not der_key(read, size):
        return 0
    end = letters.pieces(at, count - 1, 1)[0][1]
    if end < stop and _LETTERS.match(text, end, stop) and not text.startswith("-----", end):
        return 0
    pads = -count % 4
    return end + pads if pads and text.startswith("=" * pads, end) else end


def _longest(run: str) -> bytes:
    return decoded(run[: len(run) - (len(run) % 4 == 1)]) or b""


def _bodies(text: str) -> list[tuple[int, int]]:
    """Where the letters of PEM blocks begin, and where the blocks end."""
    out, at, stop = [], 0, 0
    while m := _PEM_BEGIN.search(text, at):
        if stop < m.end():
            stop = text.find("-----END", m.end())
            stop = len(text) if stop < 0 else stop
        at = m.end()
        again = text.find("-----BEGIN", m.end(), stop)  # a block that is cut off does not reach into the next
        if again < 0:
            out.append((_PEM_GAP.match(text, m.end(), stop).end(), stop))
            at = stop
        else:
            at = again
    return out


def key_spans(text: str) -> list[tuple[str, int, int]]:
    """Base64 keys, leftmost first: in PEM bodies on their own, and wherever else a key can begin."""
    found = []
    for start, stop in _bodies(text):
        if start < stop and text[start] in "Mb" and (end := key_end(Letters(text, stop, _PEM_GAP), start)):
            found.append(("key", start, end))
    begins, ends = [a for _, a, _ in found], [b for _, _, b in found]
    letters, at = Letters(text, len(text), _LINE_END), 0
    while m := _KEY_START.search(text, at):
        k = bisect_left(begins, m.start())
        if k < len(begins) and begins[k] == m.start():
            at = ends[k]
            continue
        end = key_end(letters, m.start())
        # Of the PEM keys, which lie apart in order, only the one before and the one after can overlap.
        if end and not (k and ends[k - 1] > m.start() or k < len(begins) and begins[k] < end):
            found.append(("key", m.start(), end))
        at = end or m.start() + 1
    return found


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    found = key_spans(text)
    for m in _LONG_HEX.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and is_key(bytes.fromhex(m[0])):
            found.append(("key", *m.span()))
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            header = json_object(m[1])
            if header and isinstance(header.get("alg"), str) and json_object(m[2]) is not None:
                if bool(m[3]) == (header["alg"].lower() != "none"):
                    found.append(("jwt", *m.span()))
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(documents: DataFrame, text: str = "text", carry=("doc_id",)) -> DataFrame:
    """``secrets``, an array of (kind, start, end) of every row, base and structural."""

    def run(texts: list[str], part) -> dict:
        found = [sorted(base_spans(t) + structural_spans(t), key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for t in texts]
        return {"secrets": [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]}

    return map_texts(documents, run, "secrets array<struct<kind string, start bigint, end bigint>>", text=text, carry=carry)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
