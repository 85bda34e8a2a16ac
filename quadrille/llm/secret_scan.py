"""Secret scans: credentials in texts, checked by the checksums that they carry.

An Aho-Corasick automaton finds the keywords that every secret of a kind starts with
or follows, another, over the text in lower case, those of kinds that ignore case; a
kind's regular expression is tried only there, anchored at the keyword. What it matches is decoded and its checksum or inner structure
computed anew, so that look-alikes are told from secrets.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.cluster import batches, slim

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Least entropy of a generic secret, in bits a character.
ENTROPY = 2.5


def crc_62(value: str) -> str:
    """The CRC-32 of a token's random part in base 62, six characters."""
    n, out = zlib.crc32(value.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(6, "0")


def _crc(secret: str) -> bool:
    body = secret.split("_", 1)[1]
    return crc_62(body[:-6]) == body[-6:]


def _account(secret: str) -> bool:
    """An access key holds a 12-digit account number in base 32."""
    try:
        raw = base64.b32decode(secret[4:20])
    except binascii.Error:
        return False
    return (int.from_bytes(raw[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12


def _padded(value: str) -> bytes:
    return base64.urlsafe_b64decode(value + "=" * (-len(value) % 4))


def _jwt(secret: str) -> bool:
    """Header and claims are JSON objects, and the header names an algorithm."""
    try:
        head, claims = (json.loads(_padded(x)) for x in secret.split(".")[:2])
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def _der(secret: str) -> bool:
    """The body is one DER sequence of just its length, or a key file of its own format."""
    body = "".join(x for x in secret.split("\n")[1:-1] if ":" not in x)
    try:
        raw = base64.b64decode(re.sub(r"\s", "", body), validate=True)
    except (ValueError, binascii.Error):
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == raw[1] + 2
    n = raw[1] & 0x7F
    return len(raw) == int.from_bytes(raw[2 : 2 + n], "big") + 2 + n


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _random(secret: str) -> bool:
    return entropy(secret) >= ENTROPY


class Kind:
    """keywords: what every secret of the kind has, in lower case if the pattern ignores their case; pattern: anchored there, the secret its last group; check: None if it carries no checksum."""

    def __init__(self, name: str, keywords: list[str], pattern: str, check: Callable[[str], bool] | None, inside: str = "A-Za-z0-9", folded: bool = False):
        self.name, self.keywords, self.check, self.folded = name, keywords, check, folded
        self.pattern = re.compile(rf"(?<![{inside}]){pattern}(?![{inside}])" if inside else pattern, re.ASCII)


_VALUE = r"""["']?[ \t]{0,3}(?:=|:|=>|:=)[ \t]{0,3}["']?([A-Za-z0-9+/_.\-!@#$%^&*~]{8,}={0,2})"""
#: A key's lines, up to the next header or end, which are looked at once however many headers there are.
_LINE = r"(?:[A-Za-z0-9+/=\s:,]|-(?!----(?:BEGIN|END) ))"
_KEY = rf"(-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----\r?\n(?={_LINE}{{17}}){_LINE.replace('s:,]', 's:,]++')}*+(?<=\n)-----END \2PRIVATE KEY-----)"
_NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key"]

KINDS = [
    Kind("aws_access_key", ["AKIA", "ASIA", "ABIA", "ACCA"], r"((?:AKIA|ASIA|ABIA|ACCA)[A-Z2-7]{16})", _account),
    Kind("github_token", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"(gh[pousr]_[A-Za-z0-9]{36})", _crc),
    Kind("npm_token", ["npm_"], r"(npm_[A-Za-z0-9]{36})", _crc),
    Kind("json_web_token", ["eyJ"], r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)", _jwt, "A-Za-z0-9_-"),
    Kind("private_key", ["-----BEGIN "], _KEY, _der, ""),
    Kind("slack_token", ["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], r"(xox[bpars]-[A-Za-z0-9-]{10,})", None, "A-Za-z0-9-"),
    Kind("stripe_key", ["sk_live_", "rk_live_"], r"((?:sk|rk)_live_[A-Za-z0-9]{16,})", None),
    Kind("google_api_key", ["AIza"], r"(AIza[A-Za-z0-9_-]{35})", None, "A-Za-z0-9_-"),
    Kind("gitlab_token", ["glpat-"], r"(glpat-[A-Za-z0-9_-]{20})", None, "A-Za-z0-9_-"),
    Kind("assigned_secret", _NAMES, rf"(?i:{'|'.join(sorted(_NAMES, key=len, reverse=True))}){_VALUE}", _random, "", folded=True),
]


def automaton() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """One for texts as they are and one for texts in lower case."""
    out = (ahocorasick.Automaton(), ahocorasick.Automaton())
    for own, folded in zip(out, (False, True)):
        by: dict[str, list[int]] = {}
        for i, kind in enumerate(KINDS):
            if kind.folded is folded:
                for word in kind.keywords:
                    by.setdefault(word, []).append(i)
        for word, kinds in by.items():
            own.add_word(word, (len(word), kinds))
        own.make_automaton()
    return out


def lower(text: str) -> str:
    """ASCII letters in lower case, so that every character stays in its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(found: tuple[ahocorasick.Automaton, ahocorasick.Automaton], text: str) -> list[tuple[str, int, int, str, bool | None]]:
    """(kind, start, end, secret, valid) of the secrets of a text, in their order; of those of a kind that overlap, the first."""
    out, upto = [], [0] * len(KINDS)
    for last, (size, kinds) in chain(found[0].iter(text), found[1].iter(lower(text))):
        start = last + 1 - size
        for i in kinds:
            kind = KINDS[i]
            if start >= upto[i] and (m := kind.pattern.match(text, start)):
                upto[i] = m.end()
                out.append((kind.name, m.start(1), m.end(1), m[1], kind.check(m[1]) if kind.check else None))
    return sorted(out, key=lambda x: x[:3])


def _scanned(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = automaton()
    for batch in batches_:
        row: list[int] = []
        rest: list[tuple] = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if text:
                for kind, start, end, secret, valid in scan(found, text):
                    row.append(i)
                    rest.append((kind, start, end, hashlib.sha256(secret.encode()).hexdigest(), valid))
        if row:
            columns = [pa.array(c, t) for c, t in zip(zip(*rest), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *columns], ["doc_id", "kind", "start_char", "end_char", "sha256", "valid"])


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each secret: (doc_id, kind, start_char, end_char, sha256, valid).

    The secret is text[start_char:end_char]; the result has its hash and not itself. valid: whether its
    checksum, structure or, for assigned values, entropy is right; null for kinds that carry nothing to check.
    Null and empty texts have none. Null ids stay null, repeated rows give repeated rows, an empty table none.
    Other columns are not read. Secrets of different kinds may overlap, and each is reported; equal ones in one text
    are rows of their own. Secrets and texts may be of any length, and time follows that of the text.
    """
    batches(df.sparkSession)
    return slim(df, id_col, text_col).mapInArrow(_scanned, "doc_id long, kind string, start_char long, end_char long, sha256 string, valid boolean")
