"""The merge of two schemas into a tree of compared fields.

Fields meet by aliased name: in the left schema's order, then those that only the right one has. A field is common, left or
right; its shape is atomic, struct or array (of structs, matched by position or by key). A field whose types differ is
compared as two one-sided fields whose names carry the type. A container whose members are all ignored vanishes, and one
that keeps members on one side only is one-sided.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T

from driftframe.config import ConfigError, DiffConfig, Path, Tolerance

COMMON, LEFT, RIGHT = "common", "left", "right"
ATOMIC, STRUCT, ARRAY = "atomic", "struct", "array"


@dataclass
class Side:
    """A field on one side: its raw name and type."""

    name: str
    type: T.DataType


@dataclass
class Keyed:
    """How the elements of a keyed array match. ``scope`` names its results; ``keys`` are relative to the element."""

    scope: str
    keys: tuple[Path, ...]
    omit: bool


@dataclass
class Field:
    name: str  # the column, aliased
    full: str  # as reported, from the scope's root
    kind: str
    shape: str
    left: Side | None
    right: Side | None
    tolerance: Tolerance
    is_key: bool = False
    children: list[Field] = field(default_factory=list)
    keyed: Keyed | None = None

    def on(self, side: str) -> Side | None:
        return self.left if side == LEFT else self.right

    @property
    def element(self) -> str:
        """The reported name of a positional array's elements."""
        return f"{self.full} (struct)"

    def names_below(self) -> list[str]:
        """Reported names inside a one-sided container: of structs in structs, but not of what is inside arrays."""
        return [n for c in self.children for n in [c.full, *(c.names_below() if c.shape == STRUCT else [])]]


@dataclass
class Plan:
    fields: list[Field]
    keys: tuple[Path, ...]
    config: DiffConfig

    def read_schema(self, side: str) -> T.StructType:
        """The raw columns that the comparison reads, common ones first."""
        return _schema(self.fields, side, raw=True)

    def reported_schema(self, side: str) -> T.StructType:
        return _schema(self.fields, side, raw=False)


def ordered(fields: list[Field], side: str) -> Iterator[Field]:
    """The fields that one side has, each column once: common ones first, so that equal schemas come out equal."""
    seen: set[str] = set()
    for kind in (COMMON, side):
        for f in fields:
            if f.kind == kind and f.name not in seen:
                seen.add(f.name)
                yield f


def _schema(fields: list[Field], side: str, raw: bool) -> T.StructType:
    out = []
    for f in ordered(fields, side):
        own = f.on(side)
        kind = own.type
        if f.shape == STRUCT:
            kind = _schema(f.children, side, raw)
        elif f.shape == ARRAY:
            kind = T.ArrayType(_schema(f.children, side, raw), True)
        out.append(T.StructField(own.name if raw else f.name, kind, True))
    return T.StructType(out)


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Whether two types are equal but for nullability."""
    return a.simpleString() == b.simpleString()


def is_struct_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


class _Merge:
    def __init__(self, config: DiffConfig) -> None:
        self.config = config

    def named(self, schema: T.StructType | None, raw: Path, side: str) -> dict[str, T.StructField]:
        aliases = self.config.left_aliases if side == LEFT else self.config.right_aliases
        out: dict[str, T.StructField] = {}
        for f in schema.fields if schema else ():
            if "." in f.name:
                raise ConfigError(f"Column '{f.name}' has a dot in its name, which paths cannot address")
            name = aliases.get((*raw, f.name), f.name)
            if name in out:
                raise ConfigError(f"Two {side} fields are named '{name}' below '{'.'.join(raw)}'")
            out[name] = f
        return out

    def merge(self, path: Path, raws: tuple[Path, Path], schemas: tuple[T.StructType | None, T.StructType | None], tolerance: Tolerance, root: int, keys: set[Path], found: set[Path]) -> list[Field]:
        """``root``: how much of ``path`` belongs to the enclosing scope's root; ``found`` gets the scope's keys."""
        left, right = self.named(schemas[0], raws[0], LEFT), self.named(schemas[1], raws[1], RIGHT)
        out: list[Field] = []
        for name in [*left, *(n for n in right if n not in left)]:
            sides = [(left.get(name), raws[0]), (right.get(name), raws[1])]
            own = (*path, name)
            ignored = own in self.config.ignored or (sides[1][0] is None and self.config.ignore_left_only) or (sides[0][0] is None and self.config.ignore_right_only)
            if not ignored:
                out += self.field(own, name, [f for f, _ in sides], tuple((*r, f.name) if f else r for f, r in sides), tolerance, root, keys, found)
        return out

    def field(self, path: Path, name: str, sides: list[T.StructField | None], raws: tuple[Path, Path], above: Tolerance, root: int, keys: set[Path], found: set[Path]) -> list[Field]:
        relative, full = path[root:], ".".join(path[root:])
        tolerance = self.config.tolerances.get(path, Tolerance()).under(above)
        types = [f.dataType if f else None for f in sides]
        present = [t for t in types if t is not None]
        left, right = (Side(f.name, f.dataType) if f else None for f in sides)
        kind = COMMON if left and right else LEFT if left else RIGHT
        if relative in keys:
            if any(isinstance(t, (T.ArrayType, T.MapType, T.StructType)) for t in present):
                raise ConfigError(f"Key '{full}' is not a primitive field")
            if len(present) == 2 and not same_type(*present):
                raise ConfigError(f"Key '{full}' has two types: {present[0].simpleString()} and {present[1].simpleString()}")
            found.add(relative)
            return [Field(name, full, kind, ATOMIC, left, right, tolerance, is_key=True)]
        if all(isinstance(t, T.StructType) for t in present):
            below = self.merge(path, raws, tuple(types), tolerance, root, keys, found)
            return self.container(Field(name, full, kind, STRUCT, left, right, tolerance, children=below))
        if all(is_struct_array(t) for t in present):
            elements = tuple(t.elementType if t is not None else None for t in types)
            keyed = self.config.keyed_arrays.get(path)
            if keyed is None:
                beneath = self.merge(path, raws, elements, tolerance, root, set(), set())
                return self.container(Field(name, full, kind, ARRAY, left, right, tolerance, children=beneath))
            own: set[Path] = set()
            below = self.merge(path, raws, elements, tolerance, len(path), set(keyed.keys), own)
            if below and (missing := set(keyed.keys) - own):
                raise ConfigError(f"Keys of '{'.'.join(path)}' are missing or ignored: {sorted('.'.join(k) for k in missing)}")
            return self.container(Field(name, full, kind, ARRAY, left, right, tolerance, children=below, keyed=Keyed(".".join(path), keyed.keys, keyed.omit_if_all_identical)), keyed.keys)
        if len(present) == 2 and not same_type(*present):
            suffixed = [f"{full} ({t.simpleString()})" for t in present]
            return [Field(name, suffixed[0], LEFT, ATOMIC, left, None, tolerance), Field(name, suffixed[1], RIGHT, ATOMIC, None, right, tolerance)]
        return [Field(name, full, kind, ATOMIC, left, right, tolerance)]

    @staticmethod
    def container(f: Field, keys: tuple[Path, ...] = ()) -> list[Field]:
        kinds = {c.kind for c in f.children}
        if not kinds:
            return []
        if len(kinds) == 1 and COMMON not in kinds:
            f.kind = kinds.pop()
        elif keys and f.kind == COMMON and (odd := [k for k in keys if _at(f.children, k).kind != COMMON]):
            raise ConfigError(f"Keys of '{f.full}' are not on both sides: {sorted('.'.join(k) for k in odd)}")
        return [f]


def _at(fields: list[Field], path: Path) -> Field:
    for f in fields:
        if f.name == path[0] and (len(path) == 1 or f.shape == STRUCT):
            return f if len(path) == 1 else _at(f.children, path[1:])
    raise ConfigError(f"Key '{'.'.join(path)}' is not a field")


def build_plan(left: T.StructType, right: T.StructType, config: DiffConfig) -> Plan:
    found: set[Path] = set()
    fields = _Merge(config).merge((), ((), ()), (left, right), config.default_tolerance, 0, set(config.keys), found)
    if missing := set(config.keys) - found:
        raise ConfigError(f"Keys are missing: {sorted('.'.join(k) for k in missing)}")
    if odd := [k for k in config.keys if _at(fields, k).kind != COMMON]:
        raise ConfigError(f"Keys are not on both sides: {sorted('.'.join(k) for k in odd)}")
    return Plan(fields, tuple(sorted(config.keys)), config)
