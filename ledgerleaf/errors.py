"""Exceptions of the engine."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all errors."""


class NotFound(StoreError):
    """A document, stream or row that was required is missing."""


class VersionConflict(StoreError):
    """The expected version is not the present one."""


class DocVersionConflict(VersionConflict):
    """Of a document."""


class StreamVersionConflict(VersionConflict):
    """Of an event stream."""


class IdempotencyConflict(StoreError):
    """The idempotency key was used before."""


class TenantRequired(StoreError):
    """The tenancy mode needs a tenant and none was given."""


class TenantNotFound(StoreError):
    """The tenant has no namespace."""


class StreamArchived(StoreError):
    """Writes to archived streams are refused."""


class SchemaViolation(StoreError):
    """An event body does not fit the registered schema."""


class UpcastingCycle(StoreError):
    """An upcaster chain came back to a version it had left."""


class UpcastingFailed(StoreError):
    """An upcaster raised."""


class LeaseMismatch(StoreError):
    """The lease of a projection has moved to another owner."""


class ValidationFailed(StoreError):
    """An aggregate validator refused."""


class CommitConflict(StoreError):
    """Another writer took the log entry."""


class QueryError(StoreError):
    """A query cannot be built."""


class ProjectionPaused(StoreError):
    """A projection that was to run to the head is paused."""
