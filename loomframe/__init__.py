"""A labelled, ordered table on Spark DataFrames, with verbs on points and features, statistics, fills, merges and learners."""

from loomframe import config, exceptions, log, random
from loomframe.config import loadSettings, settings, showAvailablePackages
from loomframe.functions import calculate, fill, match
from loomframe.learn.learners import (
    CustomLearner,
    fillMatching,
    learnerNames,
    learnerParameterDefaults,
    learnerParameters,
    learnerType,
    loadTrainedLearner,
    normalizeData,
    showLearnerNames,
    showLearnerParameterDefaults,
    showLearnerParameters,
    train,
    trainAndApply,
    trainAndTest,
    trainAndTestOnTrainingData,
)
from loomframe.learn.tuning import Tune, Tuning
from loomframe.log import showLog
from loomframe.operators import verbs as _verbs
from loomframe.plans.frame import Frame
from loomframe.plans.predicates import QueryString
from loomframe.sources.files import fetchFiles
from loomframe.sources.memory import data, identity, ones, zeros

_verbs.install_operators()

__all__ = [n for n in dir() if not n.startswith("_")]
