"""Settings: options by section, for the session or saved in an ini file."""

from __future__ import annotations

import configparser
import importlib.util
import os
from collections.abc import Callable

from loomframe.exceptions import InvalidArgumentValue

DEFAULTS = {"logger": {"location": "", "name": "log", "enabledByDefault": "False", "enableCrossValidationDeepLogging": "False"}, "fetch": {"location": ""}}


class SessionConfiguration:
    def __init__(self, path: str | None = None):
        self.path = path or os.path.join(os.path.expanduser("~"), ".loomframe.ini")
        self._saved = configparser.ConfigParser()
        self._saved.optionxform = str
        self._saved.read_dict(DEFAULTS)
        self._saved.read(self.path)
        self._session: dict[tuple[str, str], str] = {}
        self._hooks: dict[tuple[str, str], Callable] = {}

    def get(self, section=None, option=None):
        """One option, a section as a dictionary, or all."""
        if section is None:
            return {s: self.get(s) for s in {*self._saved.sections(), *(s for s, _ in self._session)}}
        if option is None:
            return dict(self._saved[section] if section in self._saved else {}) | {o: v for (s, o), v in self._session.items() if s == section}
        if (section, option) in self._session:
            return self._session[section, option]
        if section not in self._saved or option not in self._saved[section]:
            raise configparser.NoOptionError(option, section)
        return self._saved[section][option]

    def set(self, section: str, option: str, value) -> None:
        if not section or not option:
            raise InvalidArgumentValue("a section and an option are needed")
        self._session[section, option] = str(value)
        if (section, option) in self._hooks:
            self._hooks[section, option](value)

    def setDefault(self, section: str, option: str, value) -> None:
        self.set(section, option, value)
        self.saveChanges(section, option)

    def hook(self, section: str, option: str, toCall: Callable | None) -> None:
        if toCall is None:
            self._hooks.pop((section, option), None)
        else:
            self._hooks[section, option] = toCall

    def saveChanges(self, section=None, option=None) -> None:
        for (s, o), v in list(self._session.items()):
            if section in (None, s) and option in (None, o):
                if s not in self._saved:
                    self._saved.add_section(s)
                self._saved[s][o] = v
                del self._session[s, o]
        with open(self.path, "w") as f:
            self._saved.write(f)

    def __str__(self) -> str:
        return "\n".join(f"[{s}]\n" + "\n".join(f"{o} = {v}" for o, v in self.get(s).items()) for s in self.get())

    __repr__ = __str__


def loadSettings(path: str | None = None) -> SessionConfiguration:
    return SessionConfiguration(path)


def setInterfaceOptions(interface, save: bool = False) -> None:
    """Gives each option of a package of learners a place in the settings, empty where it has no value; saved on demand."""
    section = interface.getCanonicalName()
    known = settings.get(section)
    for option in interface.optionNames():
        if option not in known:
            settings.set(section, option, "")
        if save:
            settings.saveChanges(section, option)


def showAvailablePackages() -> dict[str, bool]:
    """Optional packages and whether they are there."""
    found = {p: importlib.util.find_spec(p) is not None for p in ("pyspark", "numpy", "pandas", "pyarrow", "matplotlib", "h5py")}
    print("\n".join(f"{p}: {'available' if ok else 'absent'}" for p, ok in found.items()))
    return found


settings = SessionConfiguration()
