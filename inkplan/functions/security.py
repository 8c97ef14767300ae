"""SEC2: AES-256-GCM with a key derived from a password: salt, nonce, ciphertext and tag in one binary value. SEC3: passwords and tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

SALT, NONCE, ROUNDS = 16, 12, 600_000


def derived_key(password: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    """PBKDF2 on the driver, once for each key in use; never for each row."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(content: Column, key: bytes, salt: bytes, nonce: bytes | None = None) -> Column:
    """salt | nonce | ciphertext | tag. Without a nonce Spark draws one for each row."""
    args = [F.lit("GCM"), F.lit("DEFAULT")] + ([F.lit(nonce)] if nonce else [])
    return F.concat(F.lit(salt), F.aes_encrypt(content, F.lit(key), *args))


def decrypted(content: Column, key: bytes) -> Column:
    """Null where the value was tampered with or the key is wrong."""
    return F.try_aes_decrypt(F.substring(content, F.lit(SALT + 1), F.length(content)), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


PASSWORD_ROUNDS = 310_000


def password_hash(password: str, salt: bytes | None = None) -> str:
    """SEC3: a digest that carries its salt and rounds."""
    salt = salt or os.urandom(SALT)
    return f"pbkdf2_sha256${PASSWORD_ROUNDS}$" + "$".join(base64.b64encode(x).decode() for x in (salt, derived_key(password, salt, PASSWORD_ROUNDS)))


def password_ok(password: str, digest: str) -> bool:
    """SEC3: false for digests of any other form."""
    try:
        scheme, rounds, salt, want = digest.split("$")
        got = derived_key(password, base64.b64decode(salt), int(rounds))
        return scheme == "pbkdf2_sha256" and hmac.compare_digest(got, base64.b64decode(want))
    except ValueError:
        return False


def _encoded(x: bytes) -> str:
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def _decoded(x: str) -> bytes:
    return base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))


def token(secret: str, subject: str, issuer: str, audience: str, minutes: int = 480, now: float | None = None, **claims) -> str:
    """SEC3: a JSON Web Token signed with HMAC-SHA256."""
    at = int(time.time() if now is None else now)
    body = {"sub": subject, "iss": issuer, "aud": audience, "iat": at, "nbf": at, "exp": at + 60 * minutes, **claims}
    head = ".".join(_encoded(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, body))
    return f"{head}.{_encoded(hmac.digest(secret.encode(), head.encode(), 'sha256'))}"


def claims_of(secret: str, signed: str, issuer: str, audience: str, now: float | None = None) -> dict:
    """SEC3: the claims of a token; ValueError if its form, signature, issuer, audience or time is wrong."""
    head, _, sign = signed.rpartition(".")
    at = time.time() if now is None else now
    if not hmac.compare_digest(_decoded(sign), hmac.digest(secret.encode(), head.encode(), "sha256")):
        raise ValueError("wrong signature")
    kind, body = (json.loads(_decoded(x)) for x in head.split("."))
    if kind.get("alg") != "HS256" or body.get("iss") != issuer or body.get("aud") != audience or not body.get("nbf", 0) <= at < body.get("exp", 0):
        raise ValueError("a token for another time, issuer or audience")
    return body
