"""Errors of the engine."""


class EngineError(Exception):
    """Base of the errors below."""


class MaxIterationsExceeded(EngineError):
    """A round was asked for beyond the round limit."""


class UnsupportedType(EngineError):
    """A column type that relations cannot order, compare or store."""


class InvalidFormat(EngineError):
    """What is at a path isn't a saved relation."""


class UnsupportedVersion(EngineError):
    """A saved relation of a version that this library can't read."""


class TooLarge(EngineError):
    """A saved relation with more rows than the caller allows."""


class NotStratified(EngineError):
    """Rules in which a relation depends on its own negation or aggregate."""
