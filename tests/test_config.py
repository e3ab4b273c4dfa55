import pytest

from driftframe.config import ConfigError, DiffConfig, Tolerance

FULL = {
    "version": 2,
    "keys": ["k", "s.k"],
    "max-examples": 7,
    "ignore": {"fields": ["a.b"], "left-only": True, "right-only": False},
    "left-aliases": {"x": "k"},
    "right-aliases": {"s.y": "k"},
    "multiple-matches": {"omit-if-all-identical": True},
    "exploded-arrays": {"e": {"keys": ["id"], "multiple-matches": {"omit-if-all-identical": False}}},
    "default-tolerance": {"absolute": 0.5, "satisfies": "any"},
    "tolerances": {"e.v": {"relative": 0.1}},
}


def test_round_trip():
    config = DiffConfig.from_dict(FULL)
    assert config.to_dict() == FULL
    assert DiffConfig.from_dict(config.to_dict()) == config


def test_defaults():
    config = DiffConfig.from_dict({"keys": ["k"], "unknown": {"is": "ignored"}})
    assert config.max_examples == 50 and not config.omit_if_all_identical and config.default_tolerance == Tolerance(satisfies="all")


@pytest.mark.parametrize(
    "bad",
    [{}, {"keys": []}, {"keys": ["k"], "version": 3}, {"keys": ["k"], "ignore": {"fields": ["k"]}}, {"keys": ["k"], "exploded-arrays": {"e": {"keys": []}}},
     {"keys": ["k"], "tolerances": {"a": {}}}, {"keys": ["k"], "default-tolerance": {"satisfies": "most"}}, {"keys": ["a..b"]}, {"keys": ["k"], "max-examples": -1}],
)
def test_rejected(bad):
    with pytest.raises(ConfigError):
        DiffConfig.from_dict(bad)


def test_tolerances_inherit_one_by_one_and_zero_switches_off():
    top = Tolerance(1.0, 0.1, "all")
    assert Tolerance(satisfies="any").under(top) == Tolerance(1.0, 0.1, "any")
    off = Tolerance(absolute=0).under(top)
    assert off.active_absolute is None and off.active_relative == 0.1
    assert Tolerance(absolute=-1, relative=0).under(top).strict
