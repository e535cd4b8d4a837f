"""Exceptions raised when data breaks a contract."""


class PipelineError(Exception):
    """Base class of every failure raised by this package."""


class EmptySourceError(PipelineError):
    """A source that must hold rows holds none."""


class SchemaDriftError(PipelineError):
    """Incoming columns do not fit the agreed contract."""


class QualityError(PipelineError):
    """At least one expectation of a suite failed, so the load is blocked."""


class ReconcileError(PipelineError):
    """Source and target disagree."""


class LayoutError(PipelineError):
    """A bucketed table was laid out otherwise than the caller says."""


class DuplicateKeyError(PipelineError):
    """A merge source holds more than one row for a key."""


class AccessDenied(PipelineError):
    """The policy grants the role no access to the table or column."""
