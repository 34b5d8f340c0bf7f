
import pytest

import loomframe as lf
from loomframe.exceptions import ImproperObjectAction, InvalidArgumentValue


def rows(f):
    return f.copy("python list")


def test_statistics():
    f = lf.data([[1, "a", None], [None, 5, 6], [7, 0, 9]], featureNames=["x", "y", "z"])
    mean = rows(f.features.mean())[0]
    assert mean == [4, None, 7.5]  # not a number is missing in a table
    assert rows(f.features.proportionMissing())[0] == [pytest.approx(1 / 3), 0, pytest.approx(1 / 3)]
    q = lf.data([[v] for v in [1, 5, 12, 13, 14, 21, 23, None]])
    assert [r[0] for r in rows(q.features.quartiles())] == [8.5, 13, 17.5]
    m = lf.data([[v] for v in [0, 1, 2, None, None, None, 0, 6]])
    assert rows(m.features.mode()) == [[0]]
    t = lf.data([[v] for v in [4, 1, 3, 2]])
    assert rows(t.features.mode()) == [[2]]  # of four modes the one left of the centre
    d = lf.data([[v] for v in [1, 2, 3, 4, 5, 6, None]])
    assert rows(d.features.variance())[0][0] == pytest.approx(3.5)
    assert rows(d.features.medianAbsoluteDeviation()) == [[1.5]]
    assert lf.calculate.variance([1, 2, 3, 4, 5, 6], sample=False) == pytest.approx(35 / 12)
    assert lf.calculate.mode([0, 1, 2, None, 0, 6]) == 0


def test_group_by():
    f = lf.data([["Clemson", 15, 0], ["Clemson", 14, 1], ["Oklahoma", 13, 1], ["Oklahoma", 12, 2], ["Oklahoma", 12, 1]], featureNames=["Location", "Purchases", "Returns"])
    got = f.features.max(groupByFeature="Location")
    assert list(got) == ["Clemson", "Oklahoma"] and rows(got["Oklahoma"]) == [[13, 2]]
    assert f.groupByFeature("Location", countUniqueValueOnly=True) == {"Clemson": 2, "Oklahoma": 3}
    assert rows(f.groupByFeature("Location")["Clemson"]) == [[15, 0], [14, 1]]
    g = lf.data([["aa", "x"], ["", "y"], [None, "z"]], featureNames=["a", "b"], treatAsMissing=[None])
    assert list(g.groupByFeature("a", countUniqueValueOnly=True)) == ["aa", "", "NaN"]


def test_fills():
    def filled(values, how, match=2):
        f = lf.data([[v] for v in values])
        f.features.fillMatching(how, match)
        return [r[0] for r in rows(f)]

    assert filled([1, 2, 2, 2, 3, 4, 5], lf.fill.forwardFill) == [1, 1, 1, 1, 3, 4, 5]
    assert filled([1, 2, 2, 10], lf.fill.interpolate) == [1, 4, 7, 10]
    assert filled([1, 2, 2, 10], lf.fill.backwardFill) == [1, 10, 10, 10]
    assert filled([1, None, 3], lf.fill.mean, lf.match.missing) == [1, 2, 3]
    assert filled([1, None, 3], 0, lf.match.missing) == [1, 0, 3]
    with pytest.raises(InvalidArgumentValue):
        filled([2, 1], lf.fill.forwardFill)
    assert lf.fill.forwardFill([1, 2, 2, 3], 2) == [1, 1, 1, 3]


def test_normalize():
    f = lf.data([[-4], [3], [-1], [6], [1], [1]])
    f.features.normalize("percentileNormalize")
    assert [r[0] for r in rows(f)] == pytest.approx([0, 0.8, 0.2, 1, 0.5, 0.5])
    a, b = lf.calculate.percentileNormalize([-4, 3, -1, 6, 1, 1], [7, -5, -3, 1, 0])
    assert a == pytest.approx([0, 0.8, 0.2, 1, 0.5, 0.5]) and b == pytest.approx([1, 0, 1 / 15, 0.5, 0.35])
    f, g = lf.data([[-4], [3], [-1], [6], [1], [1]]), lf.data([[7], [-5], [-3], [1], [0]])
    f.features.normalize("percentileNormalize", applyResultTo=g)
    assert [r[0] for r in rows(g)] == pytest.approx([1, 0, 1 / 15, 0.5, 0.35])
    z = lf.data([[1.0], [3.0]])
    z.features.normalize(lf.calculate.meanStandardDeviationNormalize)
    assert rows(z) == [[-1.0], [1.0]]


def test_parsing_and_encoding():
    f = lf.data([[0, "a1/9000-AAA"]], featureNames=["f0", "merged"])
    f.features.splitByParsing("merged", ["/", "-"], ["x", "y", "z"])
    assert rows(f) == [[0, "a1", "9000", "AAA"]]
    g = lf.data([["Brand#17"], ["Brand#2"]], featureNames=["b"])
    g.features.splitByParsing("b", "#", ["w", "n"])
    assert rows(g) == [["Brand", "17"], ["Brand", "2"]]
    h = lf.data([[1], [2], [3]], featureNames=["col"])
    assert h.replaceFeatureWithBinaryFeatures("col") == ["col=1", "col=2", "col=3"]
    assert rows(h) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    i = lf.data([["b"], ["a"], ["b"]], featureNames=["c"])
    assert i.transformFeatureToIntegers("c") == {0: "b", 1: "a"} and rows(i) == [[0], [1], [0]]


def test_columns():
    f = lf.data([[1, 2, 1], [3, 4, 3]], featureNames=["a", "b", "c"])
    assert f.features.unique().features.getNames() == ["a", "b"]
    f.features.sort(reverse=True)
    assert f.features.getNames() == ["c", "b", "a"]
    f.features.retain(["a", "b"])
    assert rows(f) == [[1, 2], [3, 4]]
    f.features.append(lf.data([[9], [8]], featureNames=["z"]))
    assert rows(f) == [[1, 2, 9], [3, 4, 8]]
    assert rows(f.features.copy(lf.match.allNonZero)) == rows(f)
    assert rows(f.features.similarities("dot product"))[0][:2] == [10, 14]
    r = f.features.report()
    assert r.features.getNames()[0] == "mean" and rows(r)[0][0] == 2
    assert rows(f.features.calculate(lambda v: max(v) - min(v))) == [[2, 2, 1]]


def test_views_are_read_only():
    v = lf.data([[1, 2], [3, 4]]).view(0, 0)
    assert rows(v) == [[1, 2]]
    with pytest.raises(ImproperObjectAction):
        v.points.delete(0)
