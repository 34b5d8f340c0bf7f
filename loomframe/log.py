"""An event log in a sqlite file: loads, preparations, runs and messages, by session."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import tempfile
import time

from loomframe.config import settings
from loomframe.exceptions import InvalidArgumentValue


class SessionLogger:
    def __init__(self, logLocation: str | None = None, logName: str = "log"):
        self.path = os.path.join(logLocation or settings.get("logger", "location") or tempfile.gettempdir(), f"{logName}.sqlite")
        self._db: sqlite3.Connection | None = None
        self.session = -1

    def setup(self, newFileName: str | None = None) -> None:
        if newFileName:
            self.cleanup()
            self.path = newFileName
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        self._db = sqlite3.connect(self.path)
        self._db.execute("CREATE TABLE IF NOT EXISTS log (entry INTEGER PRIMARY KEY, timestamp TEXT, session INTEGER, type TEXT, info TEXT)")
        last = self._db.execute("SELECT max(session) FROM log").fetchone()[0]
        self.session = 0 if last is None else last + 1

    def cleanup(self) -> None:
        if self._db:
            self._db.close()
        self._db = None

    def log(self, logType: str, logInfo: dict) -> None:
        if not self._db:
            self.setup()
        self._db.execute("INSERT INTO log (timestamp, session, type, info) VALUES (?, ?, ?, ?)", (time.strftime("%Y-%m-%d %H:%M:%S"), self.session, logType, json.dumps(logInfo, default=str)))
        self._db.commit()

    def extractFromLog(self, query: str, values=None) -> list:
        if not self._db:
            self.setup()
        return self._db.execute(query, values or ()).fetchall()

    def logLoad(self, useLog, obj, **kwargs) -> None:
        handleLogging(useLog, "load", {"shape": str(getattr(obj, "shape", None)), **kwargs})

    def logPrep(self, useLog, obj, func, returned=None, *args, **kwargs) -> None:
        handleLogging(useLog, "prep", {"function": func, "arguments": [str(a) for a in args], **{k: str(v) for k, v in kwargs.items()}})

    def logReport(self, useLog, reportType, reportInfo) -> None:
        handleLogging(useLog, "data", {"report": reportType, "info": str(reportInfo)})

    def logRun(self, useLog, function, learner, arguments, metrics=None, seconds=None) -> None:
        handleLogging(useLog, "run", {"function": function, "learner": str(learner), "arguments": str(arguments), "metrics": metrics, "time": seconds})

    def logTrainedLearner(self, useLog, obj) -> None:
        handleLogging(useLog, "tl", {"learner": obj.learnerName, "arguments": str(obj.arguments)})

    def logDeepRun(self, useLog, function, learner, arguments, metrics=None, seconds=None) -> None:
        """A run within a validation: only where deep logging is on too."""
        if deepLoggingEnabled():
            handleLogging(useLog, "deepRun", {"function": function, "learner": str(learner), "arguments": str(arguments), "metrics": metrics, "time": seconds})

    def logTLRun(self, useLog, trained, method, arguments, metrics=None, seconds=None) -> None:
        handleLogging(useLog, "run", {"function": f"TrainedLearner.{method}", "learner": trained.learnerName, "arguments": str(arguments), "metrics": metrics, "time": seconds})

    def logTuning(self, useLog, selector, validator) -> None:
        handleLogging(useLog, "tuning", {"selection": str(selector), "validation": str(validator)})

    def logRandomSeed(self, useLog, action, seed) -> None:
        handleLogging(useLog, "seed", {"action": action, "seed": seed})

    def showLog(self, levelOfDetail: int = 2, leastSessionsAgo: int = 0, mostSessionsAgo: int = 2, startDate=None, endDate=None, maximumEntries: int = 100, searchForText=None, regex: bool = False, saveToFileName=None, append: bool = False) -> str:
        if not self._db:
            self.setup()
        if leastSessionsAgo > mostSessionsAgo:
            raise InvalidArgumentValue("leastSessionsAgo exceeds mostSessionsAgo")
        where, values = ["session BETWEEN ? AND ?"], [self.session - mostSessionsAgo, self.session - leastSessionsAgo]
        for op, v in ((">=", startDate), ("<=", endDate)):
            if v is not None:
                where.append(f"timestamp {op} ?")
                values.append(str(v))
        rows = self.extractFromLog(f"SELECT timestamp, session, type, info FROM log WHERE {' AND '.join(where)} ORDER BY entry DESC", values)
        if searchForText is not None:
            hit = re.compile(searchForText if regex else re.escape(searchForText))
            rows = [r for r in rows if hit.search(" ".join(map(str, r)))]
        level = {1: ("load", "log"), 2: ("load", "log", "prep", "data", "seed", "run", "tl"), 3: None}[levelOfDetail]
        text = "\n".join(f"{t} session {s} {k}: {i}" for t, s, k, i in rows[:maximumEntries][::-1] if level is None or k in level)
        if saveToFileName:
            with open(saveToFileName, "a" if append else "w") as f:
                f.write(text + "\n")
        else:
            print(text)
        return text


def loggingEnabled(useLog=None) -> bool:
    return settings.get("logger", "enabledByDefault") == "True" if useLog is None else bool(useLog)


def deepLoggingEnabled() -> bool:
    return settings.get("logger", "enableCrossValidationDeepLogging") == "True"


def handleLogging(useLog, logType: str, info: dict) -> None:
    if loggingEnabled(useLog):
        active.log(logType, info)


def log(heading: str, logInfo) -> None:
    """An entry of one's own."""
    active.log("log", {"heading": heading, "info": logInfo})


def showLog(*args, **kwargs) -> str:
    return active.showLog(*args, **kwargs)


active = SessionLogger()
