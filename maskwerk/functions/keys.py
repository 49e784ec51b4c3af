"""Keys of a profile, derived on the driver; executors get only what an expression needs."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
from dataclasses import dataclass

ITERATIONS = 256_000
CHECK = b"maskwerk profile"


@dataclass(frozen=True)
class Keys:
    """Sub-keys for encryption at rest, keyed digests, and permutation."""

    cipher: bytes
    digest: bytes
    permute: bytes

    @classmethod
    def from_password(cls, password: str, salt: bytes, iterations: int = ITERATIONS) -> Keys:
        """PBKDF2 with SHA-512; 96 bytes make three sub-keys."""
        raw = hashlib.pbkdf2_hmac("sha512", password.encode(), salt, iterations, 96)
        return cls(raw[:32], raw[32:64], raw[64:])

    @classmethod
    def from_secret(cls, secret: bytes) -> Keys:
        """HKDF with SHA-256 from a stored random secret."""
        root = hmac.new(b"\0" * 32, secret, hashlib.sha256).digest()
        out, last = b"", b""
        for i in (1, 2, 3):
            last = hmac.new(root, last + b"maskwerk" + bytes([i]), hashlib.sha256).digest()
            out += last
        return cls(out[:32], out[32:64], out[64:])

    def token(self) -> str:
        """What is stored to tell a wrong password on opening."""
        return base64.b64encode(hmac.new(self.digest, CHECK, hashlib.sha256).digest()).decode()

    def opens(self, token: str) -> bool:
        return hmac.compare_digest(self.token(), token)


def new_salt() -> bytes:
    return secrets.token_bytes(16)
