"""Errors of parameters and data. Constructors raise them on the driver; strict expressions raise their message in tasks."""

from __future__ import annotations


class SdrError(ValueError):
    """Any error of this library."""


class InvalidDimensions(SdrError):
    pass


class InvalidParameter(SdrError):
    def __init__(self, name: str, message: str):
        super().__init__(f"{name}: {message}")
        self.name = name


class IndexOutOfBounds(SdrError):
    pass


class DimensionMismatch(SdrError):
    pass


class InvalidSdrData(SdrError):
    pass


class SerializationError(SdrError):
    pass


def require(condition: bool, name: str, message: str) -> None:
    if not condition:
        raise InvalidParameter(name, message)
