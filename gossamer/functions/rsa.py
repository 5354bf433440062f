"""RSA keys and signatures as texts, with Python's integers.

A key's text is its numbers (exponent, modulus and, of a key pair, private exponent and the two primes) in decimal with
an empty line between them, in base 64, quoted-printable, between line ends; a signature's is its number, coded alike. A
hash is signed as the number that its bytes are: that is what stored signatures were made of, and no padding that one
would want for new ones.
"""

from __future__ import annotations

import base64
import quopri
import secrets
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPONENT = 65537


@dataclass(frozen=True)
class Key:
    e: int
    n: int
    d: int | None = None
    p: int | None = None
    q: int | None = None

    def text(self) -> str:
        numbers = [self.e, self.n] + ([self.d, self.p, self.q] if self.d is not None else [])
        return coded("\n\n".join(map(str, numbers)))

    @classmethod
    def read(cls, text: str) -> Key:
        return cls(*map(int, decoded(text).split("\n\n")))

    @property
    def public(self) -> Key:
        return Key(self.e, self.n)


def coded(text: str) -> str:
    return "\n" + quopri.encodestring(base64.encodebytes(text.encode())).decode().strip() + "\n"


def decoded(text: str) -> str:
    return base64.decodebytes(quopri.decodestring(text.strip().encode())).decode()


def number_of(digest: str) -> int:
    return int.from_bytes(digest.encode("ascii"), "big")


def signed(digest: str, key: Key) -> str:
    if key.d is None:
        raise ValueError("a public key does not sign")
    return coded(str(pow(number_of(digest), key.d, key.n)))


def verified(key: Key, digest: str, signature: str) -> bool:
    return pow(int(decoded(signature)), key.e, key.n) == number_of(digest) % key.n


def prime(bits: int, draw: Callable[[int], int]) -> int:
    """A prime of so many bits, the top two of them set."""
    while True:
        x = draw(bits) | 3 << bits - 2 | 1
        if all(x % s for s in (3, 5, 7, 11, 13, 17, 19, 23)) and _passes(x, draw) and (x - 1) % EXPONENT:
            return x


def _passes(x: int, draw: Callable[[int], int], rounds: int = 32) -> bool:
    """Miller and Rabin's test."""
    odd, twos = x - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for _ in range(rounds):
        y = pow(draw(x.bit_length()) % (x - 3) + 2, odd, x)
        if y in (1, x - 1):
            continue
        for _ in range(twos - 1):
            y = y * y % x
            if y == x - 1:
                break
        else:
            return False
    return True


def generated(bits: int, draw: Callable[[int], int] = secrets.randbits) -> Key:
    """A new key pair; draw gives a number of so many random bits."""
    half = bits // 2
    while True:
        p, q = prime(half, draw), prime(bits - half, draw)
        if p != q:
            return Key(EXPONENT, p * q, pow(EXPONENT, -1, (p - 1) * (q - 1)), p, q)


def _over(kind: T.DataType, f: Callable):
    """A function of texts as a vectorised one; what cannot be read gives null."""

    def one(*values):
        if any(v is None for v in values):
            return None
        try:
            return f(*values)
        except (ValueError, TypeError):
            return None

    if f.__code__.co_argcount == 1:
        return F.pandas_udf(lambda a: a.map(one), kind)
    if f.__code__.co_argcount == 2:
        return F.pandas_udf(lambda a, b: pd.Series([one(*v) for v in zip(a, b)]), kind)
    return F.pandas_udf(lambda a, b, c: pd.Series([one(*v) for v in zip(a, b, c)]), kind)


key_length = _over(T.StringType(), lambda key: str(Key.read(key).n.bit_length()))
sign = _over(T.StringType(), lambda digest, key: signed(digest, Key.read(key)))
verify = _over(T.BooleanType(), lambda key, digest, signature: verified(Key.read(key), digest, signature))
#: A new key pair of a length of 128 bits or more. Another each time that it is computed: write the rows down before use.
new_key = _over(T.StringType(), lambda bits: generated(int(bits)).text() if int(bits) >= 128 else None).asNondeterministic()
public_key = _over(T.StringType(), lambda key: Key.read(key).public.text())
