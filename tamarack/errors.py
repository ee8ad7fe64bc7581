"""Typed errors."""


class ManifestError(ValueError):
    """A manifest that can't be used as a whole."""


class AlignmentError(ValueError):
    """An utterance that can't be aligned."""
