"""SHA-256 that one task can leave off and another go on with."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache


class _Context(ctypes.Structure):
    """SHA256_CTX of OpenSSL's public header."""

    _fields_ = [(n, ctypes.c_uint32 * k if k else ctypes.c_uint32) for n, k in (("h", 8), ("low", 0), ("high", 0), ("data", 16), ("num", 0), ("length", 0))]


@cache
def _crypto() -> ctypes.CDLL | None:
    """The library that hashlib itself uses, as its own objects can't be stored. None if it can't be reached or doesn't give
    hashlib's results."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for f, args in (("Init", (ctypes.c_void_p,)), ("Update", (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)), ("Final", (ctypes.c_char_p, ctypes.c_void_p))):
            getattr(lib, f"SHA256_{f}").argtypes = args
        first = Sha256(lib)
        first.update(b"a" * 100)
        then = Sha256(lib, first.state())
        then.update(b"b" * 100)
        return lib if then.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest() else None
    except (ImportError, AttributeError, OSError, ValueError):
        return None


def resumable() -> bool:
    return _crypto() is not None


class Sha256:
    """Like hashlib's, with a state as bytes from which another one begins."""

    def __init__(self, lib: ctypes.CDLL, state: bytes = b"") -> None:
        self.lib, self.context = lib, _Context()
        if state:
            self.context = _Context.from_buffer_copy(state)
        else:
            lib.SHA256_Init(ctypes.byref(self.context))

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(ctypes.byref(self.context), data, len(data))

    def state(self) -> bytes:
        return bytes(self.context)

    def hexdigest(self) -> str:
        out, context = ctypes.create_string_buffer(32), _Context.from_buffer_copy(self.context)
        self.lib.SHA256_Final(out, ctypes.byref(context))
        return out.raw.hex()


def sha256(state: bytes = b""):
    """A hash that goes on from a state; hashlib's where states can't be had."""
    return Sha256(lib, state) if (lib := _crypto()) else hashlib.sha256()
