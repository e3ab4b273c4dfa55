"""Expected results in the short form of the fixtures: counts in the order of the categories."""

from __future__ import annotations

from driftframe.api import diff

ORDER = {
    "record": ("identical", "different", "left_only", "right_only", "multiple_matches"),
    "kind": ("content", "left_only", "right_only", "left_and_right_only"),
    "common": ("identical", "different", "left_only", "right_only"),
    "left": ("nulls", "left_only"),
    "right": ("nulls", "right_only"),
}
_MIRROR = {"left_only": "right_only", "right_only": "left_only"}


def counted(frame) -> dict[str, dict[str, tuple[int, ...]]]:
    """``{scope: {field, or 'record' and 'kind': counts}}``."""
    cells: dict = {}
    for r in frame.collect():
        name = r["field"] or (r["kind"] if r["kind"] in ("record", "kind") else "record")
        cells.setdefault(r["scope"], {}).setdefault(name, (r["kind"], {}))[1][r["category"]] = r["n"]
    return {s: {f: tuple(c.get(x, 0) for x in ORDER[k] if x in c) for f, (k, c) in fields.items()} for s, fields in cells.items()}


def mirrored(frame) -> dict:
    return counted(frame.replace(_MIRROR, subset=["category"]).replace({"left": "right", "right": "left"}, subset=["kind"]))


def rows(spark, schema, data):
    return spark.createDataFrame([tuple(x) for x in data], schema)


def results(spark, left, right, config):
    """The counts, after checking that swapped sides give the mirrored ones."""
    got = counted(diff(left, right, config).counts())
    swap = dict(config)
    swap["left-aliases"], swap["right-aliases"] = config.get("right-aliases", {}), config.get("left-aliases", {})
    if "ignore" in config:
        ignore = config["ignore"]
        swap["ignore"] = ignore | {"left-only": ignore.get("right-only", False), "right-only": ignore.get("left-only", False)}
    assert mirrored(diff(right, left, swap).counts()) == got
    return got
