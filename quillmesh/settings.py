"""Limits and lists of a deployment, from its environment, checked before anything runs."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def listed(value: str | None) -> tuple[str, ...]:
    """Parts between commas and line ends, trimmed, without blank ones."""
    return tuple(x for x in map(str.strip, (value or "").replace("\n", ",").split(",")) if x)


def whole(value: str) -> int:
    return int(value)


def finite(value: str) -> float:
    number = float(value)
    if not math.isfinite(number):
        raise ValueError
    return number


def truth(value: str) -> bool:
    word = value.strip().lower()
    if word not in TRUE | FALSE:
        raise ValueError
    return word in TRUE


READERS: dict[str, tuple[Callable, str]] = {"int": (whole, "an integer"), "float": (finite, "a finite number"), "bool": (truth, "a boolean"), "tuple": (listed, "a list"), "str": (str, "text")}


@dataclass(frozen=True)
class Settings:
    """ValueError, which names the setting, for a value of another type or out of its range."""

    repositories: tuple[str, ...] = ()
    max_files: int = 200
    max_file_bytes: int = 512_000
    web_seeds: tuple[str, ...] = ()
    max_pages: int = 50
    max_response_bytes: int = 1_048_576
    crawl_delay: float = 0.2
    synthesis: bool = False
    synthesis_timeout: float = 30.0
    max_evidence_chars: int = 1200
    token_variable: str = "GITHUB_TOKEN"

    def __post_init__(self) -> None:
        for f in fields(self):
            value, kind = getattr(self, f.name), type(f.default)
            if isinstance(value, bool) != (kind is bool) or not isinstance(value, (int, float) if kind is float else kind):
                raise ValueError(f"{f.name} must be {READERS[kind.__name__][1]}")
            if kind is int and value <= 0:
                raise ValueError(f"{f.name} must be positive")
            if kind is float and not (math.isfinite(value) and value >= 0):
                raise ValueError(f"{f.name} must be finite and not negative")
        if not re.fullmatch(r"[A-Z_][A-Z0-9_]*", self.token_variable):
            raise ValueError("token_variable must name an environment variable")

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ, prefix: str = "QUILLMESH_") -> Settings:
        """The settings that ``env`` names as PREFIX_NAME; the others keep their defaults."""
        given = {}
        for f in fields(cls):
            name = prefix + f.name.upper()
            if name in env:
                reader, what = READERS[type(f.default).__name__]
                try:
                    given[f.name] = reader(env[name])
                except ValueError:
                    raise ValueError(f"{name} must be {what}") from None
        return cls(**given)
