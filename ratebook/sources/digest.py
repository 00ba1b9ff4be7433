"""SHA-256 that can be left and taken up again, so that tasks one after another digest the ranges of a large file.

A digest so far is a row value: its eight words, the number of bytes behind it, and the bytes of a block not yet full.
``hashlib`` cannot hand out its state, so whole blocks go through the C function below it (``SHA256_Update`` of the OpenSSL
library that Python is linked with).
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import struct
from collections.abc import Callable
from functools import cache
from math import isqrt

import numpy as np

BLOCK = 64
_WORDS = struct.Struct(">8I")
_HEAD = struct.Struct(">8IQ")


def start() -> bytes:
    """The digest of no bytes so far."""
    return _HEAD.pack(*(isqrt(p << 64) & 2**32 - 1 for p in (2, 3, 5, 7, 11, 13, 17, 19)), 0)


def n_bytes(state: bytes) -> int:
    return _HEAD.unpack_from(state)[8]


def update(state: bytes, content: bytes | memoryview) -> bytes:
    """The digest so far with ``content`` behind it."""
    *words, size = _HEAD.unpack_from(state)
    pending, content, compress = state[_HEAD.size :], memoryview(content), _compress()
    if compress is None:
        raise RuntimeError("SHA256_Update of OpenSSL was found by the driver, but not by this worker")
    size += len(content)
    if pending:
        fill = BLOCK - len(pending)
        pending, content = pending + bytes(content[:fill]), content[fill:]
        if len(pending) < BLOCK:
            return _HEAD.pack(*words, size) + pending
        words = compress(words, memoryview(pending))
    whole = len(content) // BLOCK * BLOCK
    if whole:
        words = compress(words, content[:whole])
    return _HEAD.pack(*words, size) + bytes(content[whole:])


def finish(state: bytes) -> str:
    """The digest as hexadecimal text."""
    size = n_bytes(state)
    padding = b"\x80" + bytes((BLOCK - 9 - size) % BLOCK) + struct.pack(">Q", 8 * size)
    return _WORDS.pack(*_HEAD.unpack_from(update(state, padding))[:8]).hex()


class _Context(ctypes.Structure):
    """``SHA256_CTX`` of ``openssl/sha.h``."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8),
        ("n", ctypes.c_uint32 * 2),
        ("data", ctypes.c_uint32 * 16),
        ("num", ctypes.c_uint),
        ("md_len", ctypes.c_uint),
    ]


@cache
def _compress() -> Callable[[list[int], memoryview], list[int]] | None:
    """The function that takes words over whole blocks; none where no library has it or it does not do what ``hashlib`` does."""
    block = bytes(range(BLOCK - 9)) + b"\x80" + struct.pack(">Q", 8 * (BLOCK - 9))  # a block with its padding
    for name in _libraries():
        try:
            compress = _from_library(ctypes.CDLL(name))
        except (OSError, AttributeError):
            continue
        words = compress(list(_HEAD.unpack(start())[:8]), memoryview(block))
        if _WORDS.pack(*words) == hashlib.sha256(block[: BLOCK - 9]).digest():
            return compress
    return None


def available() -> bool:
    return _compress() is not None


def _libraries() -> list[str]:
    try:
        import _hashlib

        ours = getattr(_hashlib, "__file__", None)  # symbols of the library that it is linked with are found through it
    except ImportError:
        ours = None
    return [name for name in (ours, ctypes.util.find_library("crypto")) if name]


def _from_library(library: ctypes.CDLL) -> Callable[[list[int], memoryview], list[int]]:
    add = library.SHA256_Update
    add.argtypes, add.restype = [ctypes.POINTER(_Context), ctypes.c_void_p, ctypes.c_size_t], ctypes.c_int

    def compress(words, blocks):
        context = _Context(h=(ctypes.c_uint32 * 8)(*words), md_len=32)
        add(context, np.frombuffer(blocks, np.uint8).ctypes.data, len(blocks))
        return list(context.h)

    return compress
