"""Errors of model loading."""


class InvalidModelError(ValueError):
    """The bytes are not a readable model file."""


class UnsupportedModelError(ValueError):
    """The model is neither Unigram nor BPE."""
