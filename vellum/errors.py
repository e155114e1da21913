"""Typed errors; ``kind`` is a stable name for each condition."""


class VellumError(Exception):
    kind = "error"


class DatabaseConflict(VellumError):
    kind = "db-conflict"


class NoDatabaseVersion(VellumError):
    kind = "no-database-version"


class TableConflict(VellumError):
    kind = "table-conflict"


class NoTable(VellumError):
    kind = "no-table"


class InvalidNode(VellumError):
    kind = "invalid-node"


class BadTarget(VellumError):
    kind = "bad-target"


class BrokenLink(VellumError):
    kind = "broken-link"


class UnsupportedNode(VellumError):
    kind = "unsupported-node-type"


class RangeOverlap(VellumError):
    kind = "range-overlap"


class DuplicateKeys(VellumError):
    kind = "duplicate-keys"


class CommitConflict(VellumError):
    kind = "commit-conflict"


class IllegalArgument(VellumError, ValueError):
    kind = "illegal-argument"
