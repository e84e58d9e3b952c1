"""Errors that callers can tell apart."""


class EngineError(Exception):
    """Base of all errors of this package."""


class InvalidData(EngineError, ValueError):
    """A table lacks columns or rows that an operator needs."""


class UnknownName(EngineError, KeyError):
    """No method, step, stratum or format is registered by that name."""


class NoCycles(EngineError):
    """An operator on cycles got none."""


class SyncFailed(EngineError):
    """Two recordings have no common signal long enough to align."""
