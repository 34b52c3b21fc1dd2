"""Exceptions shown to users."""


class CheckError(Exception):
    """Bad input: unreadable data, an unknown dataset, a limit exceeded."""


class GateFailed(Exception):
    """A quality gate found more errors than allowed."""
