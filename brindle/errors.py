"""Errors of the engine; every one derives from BrindleError."""

from __future__ import annotations


class BrindleError(Exception):
    """Base of all errors of the engine."""


class StorageError(BrindleError): ...


class IndexError_(BrindleError): ...


class SparseError(BrindleError): ...


class MetadataError(BrindleError): ...


class SerializationError(BrindleError): ...


class InvalidQuery(BrindleError): ...


class NotFound(BrindleError):
    def __init__(self, id: str):
        super().__init__(f"no record {id!r}")
        self.id = id


class DimensionMismatch(BrindleError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} dimensions, got {got}")
        self.expected, self.got = expected, got


class CollectionNotFound(BrindleError):
    def __init__(self, name: str):
        super().__init__(f"no collection {name!r}")
        self.name = name


class CollectionAlreadyExists(BrindleError):
    def __init__(self, name: str):
        super().__init__(f"collection {name!r} exists")
        self.name = name
