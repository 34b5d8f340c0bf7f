"""Folds, validation and the search for arguments."""

from __future__ import annotations

import itertools
import random
import weakref

from pyspark.sql import functions as F

from loomframe import log
from loomframe import random as R
from loomframe.exceptions import InvalidArgumentValue, InvalidArgumentValueCombination
from loomframe.functions.calculate import detectBestResult
from loomframe.operators.points import stacked
from loomframe.plans.frame import PID, PNAME, Frame, ranked


def fold_sizes(n: int, k: int) -> list[int]:
    """The first n mod k folds have a point more."""
    return [n // k + (i < n % k) for i in range(k)]


def k_fold_plan(frame: Frame, folds: int, seed: int):
    """id and fold of each point: a random rank cut at the sizes of the folds."""
    n = frame._densify()._count()
    if not 2 <= folds <= n:
        raise InvalidArgumentValueCombination(f"{n} points do not make {folds} folds")
    df = ranked(frame._df.select(PID), [F.xxhash64(F.lit(seed), PID), F.col(PID)], "__rank", n)
    base, more = divmod(n, folds)
    edge = more * (base + 1)
    fold = F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (base + 1))).otherwise(more + F.floor((F.col("__rank") - edge) / base))
    return df.select(PID, fold.cast("int").alias("fold"))


class FoldIterator:
    """Pairs of training and validation tables, for each of the tables given: parts of one plan, which is kept while the iterator is."""

    def __init__(self, frames: list[Frame]):
        self.frames = [f for f in frames if f is not None]
        self._whole = together(self.frames)
        self.plan, self.folds = self.makeFoldList()
        self._plan, self._sizes = None, {}

    def makeFoldList(self):
        raise NotImplementedError

    def __iter__(self):
        whole = self._whole
        if self._plan is None:
            self._plan = whole._densify()._df.join(self.plan, PID).persist()
            weakref.finalize(self, self._plan.unpersist).atexit = False
            self._sizes = {r["fold"]: r["count"] for r in self._plan.groupBy("fold").count().collect()}
        n = sum(self._sizes.values())
        for k in range(self.folds):
            held, out = self._sizes.get(k, 0), [[] for _ in self.frames]
            for cut, rows in ((F.col("fold") != k, n - held), (F.col("fold") == k, held)):
                part, at = self._plan.filter(cut), 0
                for f, pair in zip(self.frames, out, strict=True):
                    cols = [F.col(f"f{at + i}") for i in range(len(f._names))]
                    made = whole._with(part if f._named else part.drop(PNAME))._derived(part, cols, len(cols), f._names, rows)
                    made._dense, at = False, at + len(cols)
                    pair.append(made)
            yield [tuple(pair) for pair in out]


def together(frames: list[Frame]) -> Frame:
    """The features of all frames as those of one, without names; of point names those of the first frame that has them."""
    df, cols, _ = frames[0]._rooted()
    if all(f._rooted()[0] is df for f in frames[1:]):
        cols = [c for f in frames for c in f._rooted()[1]]
        return frames[0]._with(df.select(*frames[0]._keys, *[c.alias(f"f{i}") for i, c in enumerate(cols)]), [None] * len(cols), rows=frames[0]._rows)
    n = {f._count() for f in frames}
    if len(n) > 1:
        raise InvalidArgumentValue("tables differ in their number of points")
    at, named, df = 0, False, None
    for f in frames:
        names = [PNAME] if f._named and not named else []
        part = f._densify()._df.select(PID, *names, *[F.col(c).alias(f"f{at + i}") for i, c in enumerate(f._cols)])
        df, named, at = part if df is None else df.join(part, PID), named or bool(names), at + len(f._names)
    return frames[0]._with(df.select(PID, *([PNAME] if named else []), *[f"f{i}" for i in range(at)]), [None] * at, dense=True, rows=n.pop())


class KFoldIterator(FoldIterator):
    def __init__(self, frames, folds: int, seed: int | None = None):
        self._k, self._seed = folds, R.generateSubsidiarySeed() if seed is None else seed
        super().__init__(frames)

    def makeFoldList(self):
        return k_fold_plan(self._whole, self._k, self._seed), self._k


class GroupFoldIterator(FoldIterator):
    """A fold for each value of a feature of the first table, by first appearance."""

    def __init__(self, frames, foldFeature):
        self._feature = foldFeature
        super().__init__(frames)

    def makeFoldList(self):
        f = self._whole._densify()
        c = f"f{self.frames[0]._feature_index(self._feature)}"
        first = f._df.groupBy(c).agg(F.min(PID).alias("p"))
        n = first.count()
        order = ranked(first, [F.col("p")], "fold", n)
        return f._df.select(PID, c).join(order, f._df[c].eqNullSafe(order[c])).select(PID, F.col("fold").cast("int").alias("fold")), n


class Validator:
    def __init__(self, learnerName, X, Y, performanceFunction, randomSeed=None, **settings):
        self.learnerName, self.X, self.Y, self.performanceFunction = learnerName, X, Y, performanceFunction
        self.randomSeed = R.generateSubsidiarySeed() if randomSeed is None else randomSeed
        self.settings, self.records = settings, []

    @property
    def _results(self):
        return [r for _, r in self.records]

    def validate(self, arguments=None, record: bool = True, **kwarguments):
        args = (arguments or {}) | kwarguments
        result = self._validate(args)
        if record:
            self.records.append((args, result))
        return result


class CrossValidator(Validator):
    """The metric of the predictions of all folds together, not the mean over folds."""

    def _iterator(self):
        raise NotImplementedError

    def _validate(self, args):
        from loomframe.learn.learners import train

        known, got, self.deep = [], [], []
        self._parts = getattr(self, "_parts", None) or self._iterator()
        for (trainX, testX), (trainY, testY) in self._folds():
            out = train(self.learnerName, trainX, trainY, args, randomSeed=self.randomSeed).apply(testX)
            self.deep.append(self.performanceFunction(testY, out))
            log.active.logDeepRun(None, type(self).__name__, self.learnerName, args, self.deep[-1])
            known.append(testY)
            got.append(out)
        return self.performanceFunction(*_joined(known, got))

    def _folds(self):
        return iter(self._parts)


def _joined(known: list[Frame], got: list[Frame]) -> tuple[Frame, Frame]:
    """The points of all tables, and of their partners, as tables of one plan: table by table."""
    parts, n, a, b = [], 0, len(known[0]._names), len(got[0]._names)
    for i, (one, other) in enumerate(zip(known, got, strict=True)):
        df, x, y = one._beside(other)
        # ids of a table are below 2 ** 48: those of the scan have 33 bits and a partition, or are places
        parts.append(df.select((F.col(PID) + F.lit(i).cast("long") * F.lit(1 << 48)).alias(PID), *[c.alias(f"f{k}") for k, c in enumerate(x + y)]))
        n += one._count()
    both = known[0]._with(parts[0], [None] * (a + b))
    both = both._with(stacked(both, parts), dense=False, rows=n)
    first, second = both._select(list(range(a))), both._select(list(range(a, a + b)))
    first._names, second._names = list(known[0]._names), list(got[0]._names)
    return first, second


class KFold(CrossValidator):
    def __init__(self, learnerName, X, Y, performanceFunction, randomSeed=None, folds: int = 5):
        super().__init__(learnerName, X, Y, performanceFunction, randomSeed, folds=folds)
        self.folds = folds

    def _iterator(self):
        return KFoldIterator([self.X, self.Y], self.folds, self.randomSeed)


class LeaveOneOut(KFold):
    def __init__(self, learnerName, X, Y, performanceFunction, randomSeed=None):
        super().__init__(learnerName, X, Y, performanceFunction, randomSeed, X.shape[0])


class LeaveOneGroupOut(CrossValidator):
    def __init__(self, learnerName, X, Y, performanceFunction, randomSeed=None, foldFeature=None):
        super().__init__(learnerName, X, Y, performanceFunction, randomSeed, foldFeature=foldFeature)
        self._group = foldFeature if isinstance(foldFeature, Frame) else X._select([X._feature_index(foldFeature)])
        if not isinstance(foldFeature, Frame):
            at = X._feature_index(foldFeature)
            self.X = X._select([i for i in range(len(X._names)) if i != at])

    def _iterator(self):
        return GroupFoldIterator([self._group, self.X, self.Y], 0)

    def _folds(self):
        return ((x, y) for _, x, y in self._parts)


class HoldoutValidator(Validator):
    def _validate(self, args):
        from loomframe.learn.learners import train

        return train(self.learnerName, self.trainX, self.trainY, args, randomSeed=self.randomSeed).test(self.performanceFunction, self.validateX, self.validateY)


class HoldoutData(HoldoutValidator):
    def __init__(self, learnerName, X, Y, performanceFunction, randomSeed=None, validateX=None, validateY=None):
        super().__init__(learnerName, X, Y, performanceFunction, randomSeed)
        if validateX is None:
            raise InvalidArgumentValueCombination("validateX is needed")
        self.trainX, self.trainY, self.validateX, self.validateY = X, Y, validateX, validateY


class HoldoutProportion(HoldoutValidator):
    def __init__(self, learnerName, X, Y, performanceFunction, randomSeed=None, proportion: float = 0.2):
        super().__init__(learnerName, X, Y, performanceFunction, randomSeed, proportion=proportion)
        n = X._densify()._count()
        held = int(proportion * n)
        if not 0 < held < n:
            raise InvalidArgumentValue("the proportion leaves nothing to train on or to validate with")
        rank = ranked(X._df.select(PID), [F.xxhash64(F.lit(self.randomSeed), PID), F.col(PID)], "__rank", n)
        cut = lambda f, keep: f._with(f._densify()._df.join(rank, PID).filter(keep).select(*f._keys, *f._cols), dense=False)._densify()
        self.trainX, self.trainY = (cut(f, F.col("__rank") >= held) for f in (X, Y))
        self.validateX, self.validateY = (cut(f, F.col("__rank") < held) for f in (X, Y))


class Tune:
    """Values of an argument to try: a list, or a range from start to end, by adding or multiplying by change."""

    def __init__(self, values=None, start=None, end=None, change=None, changeType: str = "add"):
        if values is not None:
            self.values = list(values)
        else:
            if start is None or end is None:
                raise InvalidArgumentValueCombination("values, or start and end, are needed")
            change = change if change is not None else (1 if changeType == "add" else 2)
            self.values, v = [], start
            while v <= end if (change > 0 and changeType == "add" or changeType == "multiply" and change > 1) else v >= end:
                self.values.append(v)
                v = v + change if changeType == "add" else v * change
            if self.values and self.values[-1] != end:
                self.values.append(end)
        if not self.values:
            raise InvalidArgumentValue("no values to try")

    def __iter__(self):
        return iter(self.values)

    def __len__(self):
        return len(self.values)


class ArgumentSelector:
    """Argument sets one after the other, each with its result, so that a choice may follow from it."""

    def __init__(self, arguments: dict, validator: Validator):
        self.fixed = {k: v for k, v in arguments.items() if not isinstance(v, Tune)}
        self.tunes = {k: v.values for k, v in arguments.items() if isinstance(v, Tune)}
        self.validator, self.maximize = validator, detectBestResult(validator.performanceFunction) == "max"
        self.tried: dict = {}

    def _try(self, chosen: dict):
        key = tuple(sorted((k, repr(v)) for k, v in chosen.items()))
        if key not in self.tried:
            self.tried[key] = self.validator.validate(self.fixed | chosen)
        return self.tried[key]

    def _better(self, a, b) -> bool:
        return a > b if self.maximize else a < b

    def validateAll(self) -> None:
        raise NotImplementedError


class BruteForce(ArgumentSelector):
    def validateAll(self) -> None:
        for values in itertools.product(*self.tunes.values()):
            self._try(dict(zip(self.tunes, values, strict=True)))


class Consecutive(ArgumentSelector):
    """One argument at a time, the others at their first or best values."""

    def __init__(self, arguments, validator, order=None, loops: int = 1):
        super().__init__(arguments, validator)
        self.order, self.loops = order or list(self.tunes), loops

    def validateAll(self) -> None:
        best = {k: v[0] for k, v in self.tunes.items()}
        for _ in range(self.loops):
            for k in self.order:
                results = [(self._try(best | {k: v}), v) for v in self.tunes[k]]
                top = results[0]
                for r in results[1:]:
                    if self._better(r[0], top[0]):
                        top = r
                best[k] = top[1]


class Iterative(ArgumentSelector):
    """Steps to the best neighbouring set until none is better."""

    def validateAll(self) -> None:
        at = {k: 0 for k in self.tunes}
        values = lambda a: {k: self.tunes[k][i] for k, i in a.items()}
        best = self._try(values(at))
        while True:
            near = [at | {k: at[k] + s} for k in at for s in (-1, 1) if 0 <= at[k] + s < len(self.tunes[k])]
            scored = [(self._try(values(n)), n) for n in near]
            better = [x for x in scored if self._better(x[0], best)]
            if not better:
                return
            best, at = (max if self.maximize else min)(better, key=lambda x: x[0])


class StochasticRandomMutator(ArgumentSelector):
    """Random changes of the best set so far, a random set now and then."""

    def __init__(self, arguments, validator, maxIterations: int = 50, learnFromScratch: float = 0.2, seed: int = 42):
        super().__init__(arguments, validator)
        self.n, self.scratch, self.rng = maxIterations, learnFromScratch, random.Random(seed)

    def _draw(self) -> dict:
        return {k: self.rng.choice(v) for k, v in self.tunes.items()}

    def validateAll(self) -> None:
        best = self._draw()
        score = self._try(best)
        for _ in range(self.n - 1):
            new = self._draw() if self.rng.random() < self.scratch else best | {(k := self.rng.choice(list(self.tunes))): self.rng.choice(self.tunes[k])}
            got = self._try(new)
            if self._better(got, score):
                best, score = new, got


class Bayesian(StochasticRandomMutator):
    """Draws each argument from the values of the better third of results, with all values smoothed in (a discrete Parzen estimate)."""

    def validateAll(self) -> None:
        seen: list[tuple] = []
        for i in range(self.n):
            new = self._draw()
            if i >= 10:
                good = sorted(seen, key=lambda x: x[0], reverse=self.maximize)[: max(1, len(seen) // 3)]
                new = {k: self.rng.choice([g[1][k] for g in good] + ([self.rng.choice(v)])) for k, v in self.tunes.items()}
            seen.append((self._try(new), new))


SELECTIONS = {"brute force": BruteForce, "consecutive": Consecutive, "bayesian": Bayesian, "iterative": Iterative, "storm": StochasticRandomMutator}


class Tuning:
    """How arguments are chosen: selection 'consecutive', 'brute force', 'bayesian', 'iterative' or 'storm'; validation
    'cross validation' (folds), 'leave one out', 'leave one group out', 'data', or a proportion."""

    def __init__(self, selection: str = "consecutive", validation="cross validation", performanceFunction=None, folds: int = 5, foldFeature=None, validateX=None, validateY=None, proportion: float = 0.2, **selectorArguments):
        if selection not in SELECTIONS:
            raise InvalidArgumentValue(f"no such selection: {selection!r}")
        if selection in ("bayesian", "iterative", "storm") and validation not in ("data", "proportion") and not isinstance(validation, float):
            raise InvalidArgumentValueCombination(f"{selection} goes with validation data or a proportion")
        self.selection, self.validation, self.performanceFunction = selection, validation, performanceFunction
        self.settings = {"folds": folds, "foldFeature": foldFeature, "validateX": validateX, "validateY": validateY, "proportion": proportion}
        self.selectorArguments = selectorArguments
        self._validator = None

    def _make(self, name, X, Y, metric, seed) -> Validator:
        v, s = self.validation, self.settings
        if isinstance(v, float) or v == "proportion":
            return HoldoutProportion(name, X, Y, metric, seed, v if isinstance(v, float) else s["proportion"])
        if v == "data":
            return HoldoutData(name, X, Y, metric, seed, s["validateX"], s["validateY"])
        if v == "leave one out":
            return LeaveOneOut(name, X, Y, metric, seed)
        if v == "leave one group out":
            return LeaveOneGroupOut(name, X, Y, metric, seed, s["foldFeature"])
        return KFold(name, X, Y, metric, seed, s["folds"])

    def tune(self, learnerName, trainX, trainY, arguments, performanceFunction, randomSeed=None, useLog=None) -> None:
        metric = performanceFunction or self.performanceFunction
        if metric is None:
            raise InvalidArgumentValue("a performance function is needed")
        self._validator = self._make(learnerName, trainX, trainY, metric, randomSeed)
        self._selector = SELECTIONS[self.selection](arguments, self._validator, **self.selectorArguments)
        self._selector.validateAll()
        pick = max if self._selector.maximize else min
        self._best = pick(self._validator.records, key=lambda r: r[1])

    @property
    def bestResult(self):
        return self._best[1]

    @property
    def bestArguments(self) -> dict:
        return self._best[0]

    @property
    def allResults(self) -> list:
        return [r for _, r in self._sorted()]

    @property
    def allArguments(self) -> list:
        return [a for a, _ in self._sorted()]

    def _sorted(self):
        return sorted(self._validator.records, key=lambda r: r[1], reverse=self._selector.maximize)

    @property
    def deepResults(self) -> list:
        if not hasattr(self._validator, "deep"):
            raise InvalidArgumentValue("only cross validation has results by fold")
        return self._validator.deep

    def copy(self) -> Tuning:
        return Tuning(self.selection, self.validation, self.performanceFunction, **self.settings, **self.selectorArguments)
