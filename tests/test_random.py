"""Random small inputs against a slow comparison in plain Python."""

import random
from collections import Counter

import pytest
from helpers import ORDER, counted, rows

from driftframe.api import diff

ELEMENT = "struct<k:int,v:int,i:array<struct<k:int,w:int>>>"
SCHEMA = f"key int, a int, s struct<x:int,y:string>, p array<struct<k:int,v:int>>, e array<{ELEMENT}>"


def value(rng, none=0.25):
    return None if rng.random() < none else rng.randint(0, 2)


def array(rng, make):
    return None if rng.random() < 0.2 else [None if rng.random() < 0.2 else make() for _ in range(rng.randint(0, 3))]


def row(rng):
    inner = lambda: (value(rng), value(rng))
    return (
        value(rng, 0.1), value(rng), None if rng.random() < 0.2 else (value(rng), rng.choice("ab")), array(rng, inner),
        array(rng, lambda: (value(rng), value(rng), array(rng, inner))),
    )


class Slow:
    def __init__(self):
        self.n = {}

    def add(self, scope, field, kind, category, n=1):
        self.n.setdefault((scope, field, kind), Counter())[category] += n

    def leaf(self, scope, name, x, y):
        status = 1 if x == y else 8 if x is None else 4 if y is None else 2
        self.add(scope, name, "common", {1: "identical", 2: "different", 4: "left_only", 8: "right_only"}[status])
        return status

    def container(self, scope, name, x, y, inside):
        if x is None or y is None:
            return self.leaf(scope, name, None if x is None else 1, None if y is None else 1)
        flags = inside(x, y)
        self.add(scope, name, "common", "identical" if flags | 1 == 1 else "different")
        return flags

    def positional(self, scope, name, members):
        def inside(x, y):
            flags = 0
            for i in range(max(len(x), len(y))):
                a, b = (v[i] if i < len(v) else None for v in (x, y))
                if i < min(len(x), len(y)):
                    flags |= self.container(scope, f"{name} (struct)", a, b, members)
                elif a is None and b is None:
                    flags |= 2
                else:
                    flags |= self.leaf(scope, f"{name} (struct)", None if a is None else 1, None if b is None else 1)
            return flags

        return inside

    def keyed(self, scope, members):
        def inside(x, y):
            if x == y:
                for e in x:
                    if e is not None:
                        self.record(scope, [e], [e], members)
                return 1
            flags = 1 if x.count(None) == y.count(None) else 2
            for k in {e[0] for e in [*x, *y] if e is not None}:
                flags |= self.record(scope, *[[e for e in v if e is not None and e[0] == k] for v in (x, y)], members)
            return flags

        return inside

    def record(self, scope, xs, ys, members):
        if len(xs) > 1 or len(ys) > 1:
            self.add(scope, "", "record", "multiple_matches")
            return 16
        if not xs or not ys:
            self.add(scope, "", "record", "right_only" if not xs else "left_only")
            return 8 if not xs else 4
        flags = members(xs[0], ys[0])
        self.add(scope, "", "record", "identical" if flags | 1 == 1 else "different")
        own = flags & 14
        if flags | 1 != 1 and own:
            self.add(scope, "", "kind", "content" if own & 2 else {4: "left_only", 8: "right_only", 12: "left_and_right_only"}[own])
        return flags

    def innermost(self, x, y):
        self.leaf("e.i", "k", 1, 1)
        return self.leaf("e.i", "w", x[1], y[1])

    def element(self, x, y):
        self.leaf("e", "k", 1, 1)
        return self.leaf("e", "v", x[1], y[1]) | self.container("e", "i", x[2], y[2], self.keyed("e.i", self.innermost))

    def root(self, x, y):
        self.leaf("", "key", 1, 1)
        struct = lambda a, b: self.leaf("", "s.x", a[0], b[0]) | self.leaf("", "s.y", a[1], b[1])
        member = lambda a, b: self.leaf("", "p.k", a[0], b[0]) | self.leaf("", "p.v", a[1], b[1])
        return (
            self.leaf("", "a", x[1], y[1]) | self.container("", "s", x[2], y[2], struct)
            | self.container("", "p", x[3], y[3], self.positional("", "p", member)) | self.container("", "e", x[4], y[4], self.keyed("e", self.element))
        )


@pytest.mark.parametrize("seed", range(6))
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    left = [(k, *row(rng)[1:]) for k in [*range(40), None, 7]]
    right = [x if rng.random() < 0.3 else (x[0], *row(rng)[1:]) if rng.random() < 0.5 else tuple(x[i] if rng.random() < 0.7 else row(rng)[i] for i in range(5)) for x in left if rng.random() < 0.95]
    right = [(x[0] if x[0] in {y[0] for y in left} else 3, *x[1:]) for x in right]
    slow = Slow()
    for k in {r[0] for r in [*left, *right]}:
        slow.record("", *[[r for r in side if r[0] == k] for side in (left, right)], slow.root)
    want = {}
    for (scope, field, kind), c in slow.n.items():
        want.setdefault(scope, {})[field or kind] = tuple(c[x] for x in ORDER[kind])
    config = {"keys": ["key"], "exploded-arrays": {"e": {"keys": ["k"]}, "e.i": {"keys": ["k"]}}}
    got = counted(diff(rows(spark, SCHEMA, left), rows(spark, SCHEMA, right), config).counts())
    assert {s: {f: c for f, c in fields.items() if any(c)} for s, fields in got.items()} == {s: {f: c for f, c in fields.items() if any(c)} for s, fields in want.items()}
