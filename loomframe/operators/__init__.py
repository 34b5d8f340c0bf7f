"""Verbs of tables."""

from loomframe.operators import plotting, verbs

_NAMES = "merge transpose flatten unflatten replaceRectangle replaceFeatureWithBinaryFeatures transformFeatureToIntegers trainAndTestSets matrixMultiply matrixPower inverse solveLinearSystem toString show save _residuals _beside"
VERBS = {n: getattr(verbs, n) for n in _NAMES.split()} | plotting.VERBS
