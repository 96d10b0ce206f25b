"""Errors raised while a reconciliation is being set up or read."""


class SpecError(ValueError):
    """The job description is wrong; raised before any row is read."""


class SourceError(RuntimeError):
    """A source cannot be read the way the job asks for."""
