import pytest

import loomframe as lf
from loomframe.exceptions import ImproperObjectAction, InvalidArgumentValue

GRID = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
NAMES = ["one", "two", "three"]


def grid(**more):
    return lf.data(GRID, featureNames=NAMES, **more)


def rows(f):
    return f.copy("python list")


def test_map_reduce():
    got = grid().points.mapReduce(lambda p: [(p[0], v) for v in list(p)[1:]], lambda k, v: (k, sum(v)))
    assert rows(got) == [[1, 5], [4, 11], [7, 17]]


def test_map_reduce_of_pairs_that_come_late():
    f = lf.data([[i, i % 3] for i in range(500)])
    total = lambda k, v: (k, sum(v))
    assert rows(f.points.mapReduce(lambda p: [(p[1], p[0])] if p[0] >= 400 else [], total)) == [[1, sum(range(400, 500, 3))], [2, sum(range(401, 500, 3))], [0, sum(range(402, 500, 3))]]
    # a float only after many whole numbers, in the values and in what is reduced
    got = rows(f.points.mapReduce(lambda p: [(p[1], p[0] + 0.5 if p[0] == 450 else p[0])], total))
    assert got == [[k, sum(range(k, 500, 3)) + (0.5 if k == 0 else 0)] for k in range(3)]
    got = rows(f.points.mapReduce(lambda p: [(p[1], p[0])], lambda k, v: (k, len(v) / 2 if k == 2 else 1) if k else None))
    assert got == [[1, 1], [2, 83.0]]
    got = rows(f.points.mapReduce(lambda p: [(p[1], None if p[0] == 4 else p[0])], lambda k, v: (k, len(v))))
    assert got == [[0, 167], [1, 167], [2, 166]]
    assert rows(f.points.mapReduce(lambda p: [], total)) == [] and rows(f.points.mapReduce(lambda p: [(p[1], 1)], lambda k, v: None)) == []


def test_targets():
    f = grid(pointNames=["a", "b", "c"])
    assert rows(f.points.copy("three > 3")) == GRID[1:]
    assert rows(f.points.copy("b")) == [GRID[1]]
    assert rows(f.points.copy(["c", 0])) == [GRID[2], GRID[0]]
    assert rows(f.points.copy(start=0, end=1)) == GRID[:2]
    assert rows(f.points.copy(number=2)) == GRID[:2]
    assert rows(f.points.copy(lambda p: p["two"] == 5)) == [GRID[1]]
    assert f.points.count("one >= 4") == 2
    assert len(f.points.copy(number=2, randomize=True).points) == 2
    got = f.points.extract("one == 4")
    assert rows(got) == [GRID[1]] and f.points.getNames() == ["a", "c"]
    with pytest.raises(KeyError):
        f.points.copy(["x"])
    with pytest.raises(InvalidArgumentValue):
        f.points.copy([0, "a"])


def test_queries_with_operators_in_names():
    f = lf.data([[1, True, -1.0], [2, False, 3.0]], featureNames=["<three>", "ft 2", "three >"])
    assert rows(f.points.copy("three > == 3")) == [[2, False, 3.0]]
    assert f.points.count("ft 2 is True") == 1
    assert f.points.count("ft 2 == True") == 0  # a value that is no number is a string
    assert f.points.count("<three> is not missing") == 2


def test_missing_in_queries():
    f = lf.data([[1.0, "x"], [None, "y"], [3.0, None]], featureNames=["a", "b"])
    assert f.points.count("a is missing") == 1
    assert f.points.count("b is not missing") == 2
    assert f.points.count("a != 1") == 2
    assert f.points.count(lf.match.anyMissing) == 2


def test_sort_stable_and_missing_last():
    f = lf.data([[2, "b"], [1, "c"], [2, "a"], [None, "z"]], featureNames=["k", "v"])
    f.points.sort("k")
    assert [r[1] for r in rows(f)] == ["c", "b", "a", "z"]
    f.points.sort("k", reverse=True)
    assert [r[1] for r in rows(f)][:3] == ["b", "a", "c"]
    f.points.sort(["k", "v"])
    assert [r[1] for r in rows(f)] == ["c", "a", "b", "z"]


def test_unique_keeps_the_first():
    f = lf.data([[0, 0], [0, 0], [99, 99], [99, 99], [5.5, 11], [5.5, 11], [5.5, 11], [-1, -2]], featureNames=["x", "y"], pointNames=[f"p{i}" for i in range(8)])
    assert f.points.unique().points.getNames() == ["p0", "p2", "p4", "p7"]


def test_append_insert_replace_repeat():
    f = grid()
    f.points.append(lf.data([[0, 0, 0]], featureNames=NAMES))
    f.points.insert(0, lf.data([[30, 10, 20]], featureNames=["three", "one", "two"]))
    assert rows(f)[0] == [10, 20, 30] and rows(f)[-1] == [0, 0, 0]
    f.points.replace(lf.data([[1, 1, 1]], featureNames=NAMES), points=[0])
    assert rows(f)[0] == [1, 1, 1]
    one = lf.data([[1, 2]], pointNames=["pt"], featureNames=["a", "b"])
    assert one.points.repeat(3, True).points.getNames() == ["pt_1", "pt_2", "pt_3"]


def test_melt_and_pivot():
    f = lf.data([[0, 0, 1, 2, 3, 4], [1, 1, 5, 6, 7, 8]], featureNames=["ret0", "ret1", "c0", "c1", "c2", "c3"], pointNames=["0", "1"])
    f.points.splitByCollapsingFeatures(["c0", "c1", "c2", "c3"], "ftNames", "ftValues")
    assert f.shape == (8, 4) and rows(f)[1] == [0, 0, "c1", 2] and f.points.getNames()[:2] == ["0_0", "0_1"]
    f.points.combineByExpandingFeatures("ftNames", "ftValues")
    assert f.features.getNames() == ["ret0", "ret1", "c0", "c1", "c2", "c3"] and rows(f)[1] == [1, 1, 5, 6, 7, 8]
    bad = lf.data([["a", "x", 1], ["a", "x", 2]], featureNames=["k", "n", "v"])
    with pytest.raises(ImproperObjectAction):
        bad.points.combineByExpandingFeatures("n", "v")


def test_row_statistics():
    f = lf.data([[1.0, 2.0, None], [4.0, 4.0, 10.0]])
    assert rows(f.points.mean()) == [[1.5], [6.0]]
    assert rows(f.points.median()) == [[1.5], [4.0]]
    assert rows(f.points.mode()) == [[1.0], [4.0]]
    assert rows(f.points.proportionMissing()) == [[pytest.approx(1 / 3)], [0.0]]
    assert rows(f.points.standardDeviation())[1] == [pytest.approx(12**0.5)]
    assert rows(f.points.calculate(lambda p: p[0] * 2)) == [[2.0], [8.0]]


def test_permute_keeps_all_points():
    f = grid()
    f.points.permute()
    assert sorted(rows(f)) == GRID
    f.points.permute([2, 0, 1])
    assert sorted(rows(f)) == GRID


def test_empty_table():
    f = grid().points.copy("one > 100")
    assert f.shape == (0, 3) and not f
    f.points.append(grid())
    assert f.shape == (3, 3)


def test_types_of_results_that_come_late():
    f = lf.data([[i] for i in range(300)], featureNames=["a"])
    assert rows(f.calculateOnElements(lambda v: v / 2 if v == 299 else v))[-1] == [149.5]
    assert rows(f.calculateOnElements(lambda v: "last" if v == 299 else v))[-1] == ["last"]
    assert rows(f.points.calculate(lambda p: 0.5 if p[0] == 299 else p[0]))[-1] == [0.5]
    f.points.sort(lambda p: -p[0] + (0.25 if p[0] == 7 else 0))
    assert rows(f)[0] == [299] and rows(f)[-8:-6] == [[7], [6]]


def test_directional_fills_raise_at_the_end_that_they_fill_from():
    for fill, values in ((lf.fill.backwardFill, [1, 2, None]), (lf.fill.forwardFill, [None, 2, 3])):
        f = lf.data([[v] for v in values], featureNames=["a"])
        with pytest.raises(InvalidArgumentValue):
            f.features.fillMatching(fill, lf.match.missing)
