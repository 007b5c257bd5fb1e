import time

import pytest

from tests.helpers import frame, values
from tidemark.operators import align, derived, windows
from tidemark.operators.derived import Derived


def plus(a, b):
    return align.combine(a.renamed("x"), b.renamed("x"), "Add")


def relations(f):
    return derived._relations(f.samples)


def test_a_long_chain_and_a_ladder_of_diamonds(spark):
    f = frame(spark, a=[(i, i) for i in range(20)])
    d = Derived()
    for k in range(30):
        d.define(f"c{k}", lambda x: x.map_value(lambda v: v + 1), "a" if not k else f"c{k - 1}")
    began = time.time()
    got, failed = d.recompute(f)
    assert not failed and values(got, "c29") == [i + 30 for i in range(20)] and time.time() - began < 60
    ladder = Derived()
    for k in range(8):
        ladder.define(f"d{k}", plus, *(["a", "a"] if not k else [f"d{k - 1}"] * 2))
    seven, _ = ladder.recompute(f)
    assert values(seven, "d7") == [256 * i for i in range(20)]
    sizes = []
    for n in (2, 4, 6):
        some = Derived({k: v for k, v in ladder.definitions.items() if int(k[1:]) < n}, ladder.results)
        sizes.append(relations(some.recompute(f)[0]))
        assert some.ran == []
    assert sizes[2] - sizes[1] == sizes[1] - sizes[0] <= 2 * derived.MOST_RELATIONS


def test_only_what_changed_runs_again(spark):
    f = frame(spark, a=[(0, 1), (1, 3), (2, 5)], b=[(0, 2), (1, 2), (2, 2)])
    d = Derived()
    d.define("c", lambda x: x.map_value(lambda v: v * 10), "a")
    d.define("e", plus, "c", "b")
    d.define("g", lambda x: windows.integral(x), "b")
    d.define("h", plus, "e", "g")
    d.recompute(f)
    assert d.ran == ["c", "e", "g", "h"]
    d.recompute(f)
    assert d.ran == []
    d.define("g", lambda x: x.map_value(lambda v: -v), "b")
    got, _ = d.recompute(f)
    assert d.ran == ["g", "h"] and values(got, "h") == [10, 30, 50]
    changed = frame(spark, a=[(0, 1), (1, 3), (2, 6)], b=[(0, 2), (1, 2), (2, 2)])
    got, _ = d.recompute(changed)
    assert d.ran == ["c", "e", "h"] and values(got, "h") == [10, 30, 60]
    d.rename("c", "see")
    d.rename("b", "bee")
    got, failed = d.recompute(frame(spark, a=[(0, 1), (1, 3), (2, 6)], bee=[(0, 2), (1, 2), (2, 2)]))
    assert d.ran == [] and not failed and values(got, "see") == [10, 30, 60] and values(got, "h") == [10, 30, 60]
    got, _ = d.recompute(frame(spark, a=[(0, 1), (1, 3), (2, 6)], bee=[(0, 2), (1, 2), (2, 2)]).with_meta(unit="V"))
    assert d.ran == ["see", "e", "g", "h"]  # meta data is an input too
    assert {r["channel"]: r["unit"] for r in got.channels.collect()} == {"a": "V", "bee": "V", "see": "V", "e": "", "g": "V", "h": ""}


def test_versions_failures_and_names(spark):
    f = frame(spark, a=[(0, 1)], late=[(9, 1)])
    d = Derived()
    d.define("x", plus, "a", "late")
    d.define("y", lambda q: q, "x")
    d.define("z", lambda q: q, "nowhere", version="1")
    d.define("a2", lambda q: q.map_value(lambda v: v * 2), "a", version="1")
    got, failed = d.recompute(f)
    assert failed == {"x": "signals don't overlap in time", "y": "reads x", "z": "reads nowhere"} and values(got, "a2") == [2]
    d.define("a2", lambda q: q.map_value(lambda v: v * 2), "a", version="1")
    d.recompute(f)
    assert d.ran == []
    d.define("late", lambda q: q, "a")  # outranks the channel of its name
    got, failed = d.recompute(f)
    assert values(got, "late") == [1] and set(failed) == {"z"} and got.channels.count() == 5
    with pytest.raises(ValueError):
        d.define("a", lambda q: q, "y")
    with pytest.raises(ValueError):
        d.rename("x", "y")
    assert d.dependents_of("a") == {"x", "y", "a2", "late"}
    d.forget("z")
    assert Derived().recompute(f)[0] is f
