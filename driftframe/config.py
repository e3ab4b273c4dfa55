"""What to compare and how, as frozen dataclasses that read and write plain dicts, and JSON text or files.

Paths are dotted and use aliased names, from the root of the record; only the alias tables use raw names. Keys of a keyed
array are relative to its elements.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

Path = tuple[str, ...]


class ConfigError(ValueError):
    """The configuration, or its use on the given schemas, makes no sense."""


def to_path(dotted: str) -> Path:
    parts = tuple(dotted.split("."))
    if not all(parts):
        raise ConfigError(f"Empty name in path '{dotted}'")
    return parts


@dataclass(frozen=True)
class Tolerance:
    """``None`` inherits from the nearest ancestor; a number of 0 or less switches a tolerance off."""

    absolute: float | None = None
    relative: float | None = None
    satisfies: str | None = None

    def under(self, parent: Tolerance) -> Tolerance:
        pick = lambda own, other: other if own is None else own
        return Tolerance(pick(self.absolute, parent.absolute), pick(self.relative, parent.relative), pick(self.satisfies, parent.satisfies))

    @property
    def active_absolute(self) -> float | None:
        return self.absolute if self.absolute is not None and self.absolute > 0 else None

    @property
    def active_relative(self) -> float | None:
        return self.relative if self.relative is not None and self.relative > 0 else None

    @property
    def strict(self) -> bool:
        return self.active_absolute is None and self.active_relative is None

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> Tolerance:
        satisfies = raw.get("satisfies")
        if satisfies not in (None, "all", "any"):
            raise ConfigError(f"satisfies must be 'all' or 'any', not '{satisfies}'")
        number = lambda k: None if raw.get(k) is None else float(raw[k])
        return cls(number("absolute"), number("relative"), satisfies)

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k, v in (("absolute", self.absolute), ("relative", self.relative), ("satisfies", self.satisfies)) if v is not None}


@dataclass(frozen=True)
class KeyedArray:
    keys: tuple[Path, ...]
    omit_if_all_identical: bool = False


@dataclass(frozen=True)
class DiffConfig:
    keys: tuple[Path, ...]
    max_examples: int = 50
    ignored: frozenset[Path] = frozenset()
    ignore_left_only: bool = False
    ignore_right_only: bool = False
    left_aliases: Mapping[Path, str] = field(default_factory=dict)
    right_aliases: Mapping[Path, str] = field(default_factory=dict)
    omit_if_all_identical: bool = False
    keyed_arrays: Mapping[Path, KeyedArray] = field(default_factory=dict)
    default_tolerance: Tolerance = Tolerance(satisfies="all")
    tolerances: Mapping[Path, Tolerance] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.keys:
            raise ConfigError("At least one key is needed")
        if self.max_examples < 0:
            raise ConfigError("max-examples must not be negative")
        if both := set(self.keys) & self.ignored:
            raise ConfigError(f"Keys cannot be ignored: {sorted('.'.join(p) for p in both)}")
        for path, array in self.keyed_arrays.items():
            if not array.keys:
                raise ConfigError(f"Keyed array '{'.'.join(path)}' needs keys")

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> DiffConfig:
        if raw.get("version", 2) != 2:
            raise ConfigError(f"Unknown version {raw['version']}")
        if not raw.get("keys"):
            raise ConfigError("keys are missing")
        ignore = raw.get("ignore", {})
        omit = lambda r: bool(r.get("multiple-matches", {}).get("omit-if-all-identical", False))
        tolerances = {to_path(p): Tolerance.from_dict(t) for p, t in raw.get("tolerances", {}).items()}
        for p, t in tolerances.items():
            if t == Tolerance():
                raise ConfigError(f"Tolerance of '{'.'.join(p)}' sets nothing")
        return cls(
            keys=tuple(to_path(k) for k in raw["keys"]),
            max_examples=int(raw.get("max-examples", 50)),
            ignored=frozenset(to_path(p) for p in ignore.get("fields", ())),
            ignore_left_only=bool(ignore.get("left-only", False)),
            ignore_right_only=bool(ignore.get("right-only", False)),
            left_aliases={to_path(p): a for p, a in raw.get("left-aliases", {}).items()},
            right_aliases={to_path(p): a for p, a in raw.get("right-aliases", {}).items()},
            omit_if_all_identical=omit(raw),
            keyed_arrays={to_path(p): KeyedArray(tuple(to_path(k) for k in a.get("keys", ())), omit(a)) for p, a in raw.get("exploded-arrays", {}).items()},
            default_tolerance=Tolerance.from_dict(raw.get("default-tolerance", {})).under(Tolerance(satisfies="all")),
            tolerances=tolerances,
        )

    @classmethod
    def from_json(cls, text: str) -> DiffConfig:
        try:
            raw = json.loads(text)
        except json.JSONDecodeError as error:
            raise ConfigError(f"Not JSON: {error}") from error
        if not isinstance(raw, Mapping):
            raise ConfigError("A configuration is an object of named settings")
        return cls.from_dict(raw)

    @classmethod
    def from_file(cls, path: str) -> DiffConfig:
        """From a JSON file that the driver can open."""
        with open(path, encoding="utf-8") as file:
            return cls.from_json(file.read())

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def to_dict(self) -> dict[str, Any]:
        said = ".".join
        omit = lambda on: {"multiple-matches": {"omit-if-all-identical": on}}
        return {
            "version": 2,
            "keys": [said(k) for k in self.keys],
            "max-examples": self.max_examples,
            "ignore": {"fields": sorted(said(p) for p in self.ignored), "left-only": self.ignore_left_only, "right-only": self.ignore_right_only},
            "left-aliases": {said(p): a for p, a in self.left_aliases.items()},
            "right-aliases": {said(p): a for p, a in self.right_aliases.items()},
            **omit(self.omit_if_all_identical),
            "exploded-arrays": {said(p): {"keys": [said(k) for k in a.keys], **omit(a.omit_if_all_identical)} for p, a in self.keyed_arrays.items()},
            "default-tolerance": self.default_tolerance.to_dict(),
            "tolerances": {said(p): t.to_dict() for p, t in self.tolerances.items()},
        }
