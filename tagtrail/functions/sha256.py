"""SHA-256 that one task leaves off and another takes up.

The objects of ``hashlib`` cannot be pickled. The state of OpenSSL's own SHA-256 functions is a plain block of bytes, so it
can travel; they are those of the library that ``hashlib`` is built on.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from functools import cache

import _hashlib

#: Fixed value: more than the 112 bytes of SHA256_CTX.
STATE_BYTES = 128


@cache
def _openssl() -> ctypes.CDLL:
    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        library = ctypes.CDLL(name)
        if hasattr(library, "SHA256_Update"):
            library.SHA256_Init.argtypes = [ctypes.c_char_p]
            library.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_void_p, ctypes.c_size_t]
            library.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
            return library
    raise RuntimeError("this Python's OpenSSL has no SHA256_Update")


class Sha256:
    """A hash whose ``state`` makes another one that goes on from there."""

    def __init__(self, state: bytes | None = None):
        self._held = ctypes.create_string_buffer(state or b"", STATE_BYTES)
        if state is None:
            _openssl().SHA256_Init(self._held)

    @property
    def state(self) -> bytes:
        return self._held.raw

    def update(self, address: int, size: int) -> None:
        """Takes the bytes at an address of memory, such as that of an Arrow buffer."""
        _openssl().SHA256_Update(self._held, address, size)

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _openssl().SHA256_Final(out, ctypes.create_string_buffer(self.state, STATE_BYTES))
        return out.raw.hex()
