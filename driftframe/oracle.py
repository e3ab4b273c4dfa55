"""Expected counts as SQL, written from a spec's fields and not from the engine: a plain full outer join of keys that have one
row a side (or only equal rows, where these may be left out), and a filtered count for every status."""

from __future__ import annotations

from driftframe.perturbed import F, Spec

_CATEGORIES = {"common": (("identical", 1), ("different", 2), ("left_only", 4), ("right_only", 8)), "left": (("nulls", 1), ("left_only", 4)), "right": (("nulls", 1), ("right_only", 8))}


def _on(side: str, expression: str) -> str:
    return expression.replace("x.", f"{side}.")


def _kind(f: F, spec: Spec) -> str:
    if f.left is None and f.right is None:  # named only: of the side that its container is on
        top = next(g for g in spec.fields if g.name == f.name.split(".")[0])
        return _kind(top, spec)
    return "common" if f.left and f.right else "left" if f.left else "right"


def _status(f: F, spec: Spec) -> str:
    guard = "c = 0"
    if f.parent:
        top = next(g for g in spec.fields if g.name == f.parent)
        guard += f" AND {_on('l', top.left)} IS NOT NULL AND {_on('r', top.right)} IS NOT NULL"
    kind = _kind(f, spec)
    if f.left is None and f.right is None:
        return "CAST(NULL AS INT)"
    if f.key:
        return f"CASE WHEN {guard} THEN 1 END"
    if kind != "common":
        value = _on("l", f.left) if f.left else _on("r", f.right)
        return f"CASE WHEN {guard} THEN CASE WHEN {value} IS NULL THEN 1 ELSE {4 if kind == 'left' else 8} END END"
    x, y = _on("l", f.left), _on("r", f.right)
    if f.struct:
        inner = " | ".join(f"coalesce({_status(g, spec)}, 0)" for g in spec.fields if g.parent == f.name)
        same = f"(({inner}) | 1) = 1"
    else:
        same = f.same or f"{x} = {y}"
    return f"CASE WHEN {guard} THEN CASE WHEN {x} IS NULL AND {y} IS NULL THEN 1 WHEN {x} IS NULL THEN 8 WHEN {y} IS NULL THEN 4 WHEN {same} THEN 1 ELSE 2 END END"


def _flags(f: F, spec: Spec, status: str) -> str:
    """What a field adds to its record's flags: a struct's members count themselves while both sides have it."""
    if not f.struct:
        return f"coalesce({status}, 0)"
    return f"CASE WHEN {_on('l', f.left)} IS NOT NULL AND {_on('r', f.right)} IS NOT NULL THEN 0 ELSE coalesce({status}, 0) END"


def write(spec: Spec) -> str:
    key_of = {side: [_on("s", getattr(next(f for f in spec.fields if f.name == k), side)) for k in spec.keys] for side in ("left", "right")}
    names = [f"key{i}" for i in range(len(spec.keys))]
    ctes = []
    for side, sql in (("left", spec.left), ("right", spec.right)):
        columns = ", ".join(f"{e} AS {n}" for e, n in zip(key_of[side], names))
        ctes.append(f"{side}_rows AS (SELECT s.*, {columns}, 1 AS here FROM ({sql}) s)")
        alike = "1" if spec.omit is None else f"CASE WHEN count(DISTINCT hash({', '.join(spec.omit)})) = 1 THEN 0 ELSE 1 END"
        ctes.append(f"{side}_keys AS (SELECT {', '.join(names)}, CASE WHEN count(*) > 1 THEN {alike} ELSE 0 END AS many FROM {side}_rows GROUP BY {', '.join(names)})")
        ctes.append(f"{side}_one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(names)}) AS nth FROM {side}_rows) q WHERE nth = 1)")
    on = lambda a, b: " AND ".join(f"{a}.{n} IS NOT DISTINCT FROM {b}.{n}" for n in names)
    ctes.append(f"keys AS (SELECT {', '.join(f'coalesce(a.{n}, b.{n}) AS {n}' for n in names)}, coalesce(a.many, 0) + coalesce(b.many, 0) > 0 AS many FROM left_keys a FULL OUTER JOIN right_keys b ON {on('a', 'b')})")
    statuses = [(f, f"f{i}", _status(f, spec)) for i, f in enumerate(spec.fields)]
    flags = " | ".join(_flags(f, spec, s) for f, _, s in statuses if not f.key) or "0"
    ctes.append(f"met AS (SELECT l, r, CASE WHEN k.many THEN 16 WHEN r.here IS NULL THEN 4 WHEN l.here IS NULL THEN 8 ELSE 0 END AS c FROM keys k LEFT JOIN left_one l ON {on('k', 'l')} LEFT JOIN right_one r ON {on('k', 'r')})")
    ctes.append(f"judged AS (SELECT c, CASE WHEN c = 0 THEN {flags} END AS flags, {', '.join(f'{s} AS {n}' for _, n, s in statuses)} FROM met)")
    rows = []
    add = lambda field, kind, category, test: rows.append(f"SELECT '' AS scope, '{field}' AS field, '{kind}' AS kind, '{category}' AS category, CAST(count(*) FILTER (WHERE {test}) AS BIGINT) AS n FROM judged")
    for category, test in (("identical", "c = 0 AND (flags | 1) = 1"), ("different", "c = 0 AND (flags | 1) <> 1"), ("left_only", "c = 4"), ("right_only", "c = 8"), ("multiple_matches", "c = 16")):
        add("", "record", category, test)
    for category, test in (("content", "(flags & 2) = 2"), ("left_only", "(flags & 14) = 4"), ("right_only", "(flags & 14) = 8"), ("left_and_right_only", "(flags & 14) = 12")):
        add("", "kind", category, test)
    for f, n, _ in statuses:
        for category, code in _CATEGORIES[_kind(f, spec)]:
            add(f.name, _kind(f, spec), category, f"{n} = {code}")
    sql = f"WITH {', '.join(ctes)} SELECT * FROM ({' UNION ALL '.join(rows)}) o" + (f" WHERE {spec.where}" if spec.where else "")
    for word, text in (("{string}", "VARCHAR"), ("{binary}", "BLOB"), ("{slice3}", "embedding[1:3]"), ("named_struct(", "struct_pack("), *((f"{{{t}}}", t) for t in spec.tables)):
        sql = sql.replace(word, text)
    for name in ("nation", "balance", "segment"):
        sql = sql.replace(f"'{name}', ", f"{name} := ")
    return sql
