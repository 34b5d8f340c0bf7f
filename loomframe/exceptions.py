"""Errors of the library; each needs a message."""

from __future__ import annotations


class LoomException(Exception):
    def __init__(self, message: str):
        if not isinstance(message, str) or not message:
            raise TypeError("a message is required")
        self.message = self.value = message
        super().__init__(message)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.message!r})"


class InvalidArgumentType(LoomException, TypeError):
    """An argument is of a type that does not fit."""


class InvalidArgumentValue(LoomException, ValueError):
    """An argument has a value that does not fit."""


class InvalidArgumentTypeCombination(LoomException, TypeError):
    """Arguments are of types that do not go together."""


class InvalidArgumentValueCombination(LoomException, ValueError):
    """Arguments have values that do not go together."""


class ImproperObjectAction(LoomException, TypeError):
    """The table is not of a kind that allows the action."""


class PackageException(LoomException, ImportError):
    """An optional package is needed and absent."""


class FileFormatException(LoomException, ValueError):
    """A file does not have the form expected of it."""
