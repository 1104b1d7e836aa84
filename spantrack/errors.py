"""Errors of the engine."""


class SpanTrackError(Exception):
    """Base of all errors."""


class InvalidFormatError(SpanTrackError):
    """The input breaks a rule of its format."""


class InvalidFormatWarning(SpanTrackError):
    """The input has rows that were skipped."""


class IncompatibleTracksError(SpanTrackError):
    """A track can't meet a requirement, even after conversion."""


class NotSupportedError(SpanTrackError):
    """The combination isn't supported."""


class OutsideBoundingRegionError(SpanTrackError):
    """A region isn't inside one bounding region."""


class BoundingRegionsNotAvailableError(SpanTrackError):
    """The track has no bounding regions."""


class EmptySourceError(SpanTrackError):
    """No valid row at all."""


class ArgumentValueError(SpanTrackError):
    """An argument has an unusable value."""
