"""Errors this package raises itself."""


class LogweirError(Exception):
    """Base of every error this package raises itself."""


class ValidationError(LogweirError, ValueError):
    """An argument is not acceptable."""


class NotFoundError(LogweirError, LookupError):
    """A saved search, result or slice does not exist."""


class ConfigurationError(LogweirError, RuntimeError):
    """The session lacks a setting the job depends on."""


class IncompleteResultError(LogweirError, RuntimeError):
    """A result was not stored in full and is not committed."""
