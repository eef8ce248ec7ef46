import dataclasses
import itertools

import pytest

from weft.model import Fingerprint, Model, frozendict, int64, skipped, uint64


def test_numbers_keep_their_range():
    assert int64(uint64((1 << 64) - 1)) == -1 and uint64(int64(-1)) == (1 << 64) - 1
    assert isinstance(int64(1) + 2, int64) and isinstance(3 - uint64(1), uint64) and isinstance(int64(5) // 2, int64)
    for wrong in (lambda: int64(1 << 63), lambda: uint64(-1), lambda: int64((1 << 63) - 1) + 1, lambda: uint64(0) - 1):
        with pytest.raises(ValueError, match="range"):
            wrong()


def test_combination():
    a, b, c = (Fingerprint.from_string(x) for x in "abc")
    assert len({x.combine(y, z) for x, y, z in itertools.permutations((a, b, c))}) == 1
    assert a.combine(a).is_identity and a.combine(Fingerprint.identity()) == a
    assert Fingerprint.from_string("ok") != Fingerprint.from_string("OK")
    # Where order or repetition matters, nothing cancels.
    assert Fingerprint.of(a, b) != Fingerprint.of(b, a) and Fingerprint.of(a, a) != Fingerprint.of(b, b)
    assert Fingerprint.of({"x": 1, "y": 2}) == Fingerprint.of({"y": 2, "x": 1})
    with pytest.raises(TypeError):
        Fingerprint.of(object())


@dataclasses.dataclass(frozen=True, kw_only=True)
class Thing(Model):
    x: int
    note: str = skipped(default="")


@dataclasses.dataclass(frozen=True, kw_only=True)
class Other(Model):
    x: int


def test_models():
    assert Thing(x=1, note="a").fingerprint == Thing(x=1).fingerprint != Thing(x=2).fingerprint
    assert Thing(x=1).fingerprint != Other(x=1).fingerprint
    with pytest.raises(dataclasses.FrozenInstanceError):
        Thing(x=1).x = 2
    assert Thing(x=1).with_(x=3) == Thing(x=3)


def test_frozendict():
    a = frozendict(x=1, y=2)
    assert hash(a) == hash(frozendict(y=2, x=1)) and a | {"z": 3} == {"x": 1, "y": 2, "z": 3} and isinstance({"z": 3} | a, frozendict)
    with pytest.raises(TypeError):
        a["x"] = 5
