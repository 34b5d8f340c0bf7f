"""Packages of learners: their names, versions, and whether they are there. Learners built in, custom ones and Spark ML's
can be used; of other packages only what is installed is told, and their learners are refused with a reason."""

from __future__ import annotations

import importlib.metadata
import importlib.util

from loomframe.exceptions import PackageException
from loomframe.learn import learners


class LearnerPackage:
    name, aliases, module = "", (), ""

    @classmethod
    def getCanonicalName(cls) -> str:
        return cls.name

    @classmethod
    def isAlias(cls, name: str) -> bool:
        return name.lower() in {n.lower() for n in (cls.name, *cls.aliases)}

    @classmethod
    def accessible(cls) -> bool:
        return importlib.util.find_spec(cls.module) is not None

    @classmethod
    def version(cls) -> str:
        try:
            return importlib.metadata.version(cls.module)
        except importlib.metadata.PackageNotFoundError as e:
            raise PackageException(f"{cls.name} is not installed") from e

    @classmethod
    def optionNames(cls) -> list[str]:
        return []

    @classmethod
    def learnerNames(cls) -> list[str]:
        return [n.split(".", 1)[1] for n in learners.learnerNames(cls.name)]

    @classmethod
    def learnerType(cls, name: str) -> str:
        return learners.learnerType(f"{cls.name}.{name}")

    @classmethod
    def registerLearnerClass(cls, learner: type) -> None:
        raise PackageException(f"only custom learners are registered, not those of {cls.name}")


class BuiltInLearners(LearnerPackage):
    name, module = "loomframe", "loomframe"

    @classmethod
    def version(cls) -> str:
        return "0"


class CustomLearners(LearnerPackage):
    name, module = "custom", "loomframe"

    @classmethod
    def version(cls) -> str:
        return "0"

    @classmethod
    def registerLearnerClass(cls, learner: type) -> None:
        learners.registerLearnerClass(learner)


class SparkML(LearnerPackage):
    name, aliases, module = "spark", ("pyspark", "sparkml"), "pyspark"


class SciKitLearn(LearnerPackage):
    name, aliases, module = "sklearn", ("scikitlearn", "scikit-learn", "skl"), "sklearn"


class Keras(LearnerPackage):
    name, aliases, module = "keras", ("tensorflow.keras", "tf.keras"), "keras"


class Autoimpute(LearnerPackage):
    name, module = "autoimpute", "autoimpute"


PACKAGES = (BuiltInLearners, CustomLearners, SparkML, SciKitLearn, Keras, Autoimpute)


def package(name: str) -> type[LearnerPackage]:
    """The package of a name or alias."""
    for p in PACKAGES:
        if p.isAlias(name):
            return p
    raise PackageException(f"no package {name!r}; there are {[p.name for p in PACKAGES]}")
