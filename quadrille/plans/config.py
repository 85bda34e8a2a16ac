"""Configurations: a subset of HOCON, and typed access to it.

Understood are objects with or without braces around the whole, dotted keys, lists, quoted and bare values, both kinds
of comments, and ${name} for environment variables or earlier keys, with ? if they may be missing.
"""

from __future__ import annotations

import os
import re
from typing import Any

_TOKEN = re.compile(r'\s*(?:(?:#|//)[^\n]*\n?|("""(?:.|\n)*?""")|("(?:[^"\\\n]|\\.)*")|(\$\{\??[^}]*\})|([{}\[\],:=\n])|((?:(?!//)[^\s{}\[\],:="#$])(?:(?!//)[^\n{}\[\],:="#$])*))', re.A)
_SPACE = re.compile(r"[ \t\r]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class ConfigError(ValueError):
    """A configuration that lacks something or has it wrong."""


def _unquoted(text: str) -> str:
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), text[1:-1])


def _tokens(text: str) -> list[tuple[str, str]]:
    """Kinds and values: s quoted, w bare, v variable, n newline, or the mark itself."""
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        at = _SPACE.match(text, at).end()
        if at >= len(text):
            break
        if text[at] == "\n":
            out.append(("n", "\n"))
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise ConfigError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        if m[1]:
            out.append(("s", m[1][3:-3]))
        elif m[2]:
            out.append(("s", _unquoted(m[2])))
        elif m[3]:
            out.append(("v", m[3][2:-1].strip()))
        elif m[4]:
            out.append((m[4], m[4]))
        elif m[5]:
            out.append(("w", m[5].strip()))
        else:
            out.append(("n", "\n"))
    return out


def _value(word: str) -> Any:
    if word in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[word]
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


def merged(first: dict, second: dict) -> dict:
    """Both, key by key; where both have a value that is no object, the first's."""
    out = dict(second)
    for k, v in first.items():
        out[k] = merged(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class _Parser:
    def __init__(self, text: str, environment: dict[str, str]):
        self.tokens, self.at, self.environment, self.root = _tokens(text), 0, environment, {}

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def skip(self, kinds: str) -> None:
        while self.peek()[0] in kinds and self.peek()[0] != "end":
            self.at += 1

    def whole(self) -> dict:
        self.skip("n")
        braces = self.peek()[0] == "{"
        self.at += braces
        self.object(self.root, "}" if braces else "end")
        return self.root

    def object(self, into: dict, end: str) -> None:
        while True:
            self.skip("n,")
            kind, word = self.peek()
            self.at += 1
            if kind == end:
                return
            if kind not in "sw" or kind == "end":
                raise ConfigError(f"a key should be where {word!r} is")
            path = [word] if kind == "s" else [p.strip().strip('"') for p in word.split(".")]
            while kind == "s" and self.peek()[0] == "w" and self.peek()[1].startswith("."):
                path += self.peek()[1][1:].split(".")
                self.at += 1
            for key in path[:-1]:
                into_ = into if key == path[0] else into_  # noqa: F821
                if not isinstance(into_.get(key), dict):
                    into_[key] = {}
                into_ = into_[key]
            owner = into_ if len(path) > 1 else into
            self.skip("n")
            if self.peek()[0] in (":", "="):
                self.at += 1
                self.skip("n")
            elif self.peek()[0] != "{":
                raise ConfigError(f"{word} has no value")
            if self.peek()[0] == "{":
                self.at += 1
                if not isinstance(owner.get(path[-1]), dict):
                    owner[path[-1]] = {}
                self.object(owner[path[-1]], "}")
            else:
                found = self.value()
                if found is not _ABSENT:
                    owner[path[-1]] = found

    def value(self) -> Any:
        if self.peek()[0] == "[":
            self.at += 1
            out = []
            while True:
                self.skip("n,")
                if self.peek()[0] == "]":
                    self.at += 1
                    return out
                if self.peek()[0] == "end":
                    raise ConfigError("a list does not end")
                out.append(self.value())
        if self.peek()[0] == "{":
            self.at += 1
            made: dict = {}
            self.object(made, "}")
            return made
        parts: list[Any] = []
        while self.peek()[0] in ("s", "w", "v", ":", "="):
            kind, word = self.peek()
            self.at += 1
            parts.append(self.variable(word) if kind == "v" else _value(word) if kind == "w" else word)
        parts = [p for p in parts if p is not _ABSENT] or ([_ABSENT] if parts else [])
        if not parts:
            raise ConfigError("a value is missing")
        return parts[0] if len(parts) == 1 else "".join(str(p) for p in parts)

    def variable(self, name: str) -> Any:
        optional, name = name.startswith("?"), name.lstrip("?")
        found: Any = self.root
        for key in name.split("."):
            found = found.get(key, _ABSENT) if isinstance(found, dict) else _ABSENT
        if found is _ABSENT:
            found = self.environment.get(name, _ABSENT)
        if found is _ABSENT and not optional:
            raise ConfigError(f"there is no {name}")
        return found


_ABSENT = object()


def parse(text: str, environment: dict[str, str] | None = None) -> dict[str, Any]:
    return _Parser(text, dict(os.environ) if environment is None else environment).whole()


def load(*paths: str, environment: dict[str, str] | None = None) -> dict[str, Any]:
    """Several files as one; the environment comes first, then earlier files."""
    environment = dict(os.environ) if environment is None else environment
    out: dict[str, Any] = {}
    for path in paths:
        with open(path) as f:
            out = merged(out, parse(f.read(), environment))
    return merged(nested({k: v for k, v in environment.items() if k.split(".")[0] in out}), out)


def nested(flat: dict[str, Any]) -> dict[str, Any]:
    """Dotted keys as objects."""
    out: dict[str, Any] = {}
    for path, value in flat.items():
        *way, last = path.split(".")
        into = out
        for key in way:
            into = into.setdefault(key, {})
            if not isinstance(into, dict):
                raise ConfigError(f"{path} goes through a value")
        into[last] = value
    return out


def flat(config: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Objects as dotted keys."""
    out: dict[str, Any] = {}
    for k, v in config.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


class Section:
    """An object with getters: of the first key that is there, or of the default; without one a missing key is an error."""

    def __init__(self, config: dict[str, Any], name: str = ""):
        self.config, self.name = config, name

    def section(self, key: str) -> Section:
        found = self.find(key)
        if not isinstance(found, dict):
            raise ConfigError(f"there is no section {self.name}{key}")
        return Section(found, f"{self.name}{key}.")

    def find(self, *keys: str) -> Any:
        for key in keys:
            at: Any = self.config
            for part in key.split("."):
                at = at.get(part) if isinstance(at, dict) else None
            if at is not None:
                return at
        return None

    def _get(self, kind, keys: tuple[str, ...], default: Any) -> Any:
        found = self.find(*keys)
        if found is None:
            if default is _ABSENT:
                raise ConfigError(f"there is no {self.name}{keys[0]}")
            return default
        try:
            return kind(found)
        except (TypeError, ValueError) as e:
            raise ConfigError(f"{self.name}{keys[0]} is {found!r}") from e

    def text(self, *keys: str, default: Any = _ABSENT) -> Any:
        return self._get(str, keys, default)

    def whole(self, *keys: str, default: Any = _ABSENT) -> Any:
        return self._get(int, keys, default)

    def real(self, *keys: str, default: Any = _ABSENT) -> Any:
        return self._get(float, keys, default)

    def truth(self, *keys: str, default: Any = _ABSENT) -> Any:
        def of(value: Any) -> bool:
            if isinstance(value, bool):
                return value
            return {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}[str(value).lower()]

        try:
            return self._get(of, keys, default)
        except KeyError as e:
            raise ConfigError(f"{self.name}{keys[0]} is no truth value") from e

    def many(self, kind, *keys: str, default: Any = _ABSENT) -> Any:
        return self._get(lambda v: [kind(x) for x in (v if isinstance(v, list) else str(v).split(","))], keys, default)
