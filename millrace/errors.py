"""Errors that callers can test for, one class for each kind."""


class DialectError(Exception):
    """Any error of a statement or of its execution."""


class InvalidSQLStatement(DialectError):
    pass


class UnsupportedStatement(InvalidSQLStatement):
    """A statement of administration: sessions, storage and instances are Spark's and the file system's."""


class MissingFromClause(DialectError):
    pass


class MissingWithinClause(DialectError):
    pass


class MissingTablesDescription(DialectError):
    pass


class InvalidTableDescription(DialectError):
    pass


class InvalidColumnDescription(DialectError):
    pass


class AmbiguousColumnName(DialectError):
    pass


class InvalidCondition(DialectError):
    pass


class InvalidConditionValue(DialectError):
    pass


class MissingRightParenthesis(DialectError):
    pass


class UnexpectedEndOfStatement(DialectError):
    pass


class InvalidOrderByPart(DialectError):
    pass


class InvalidGroupByPart(DialectError):
    pass


class InvalidGroupColumnSet(DialectError):
    pass


class InvalidWindowByPart(DialectError):
    pass


class UnableToLockTableForProcess(DialectError):
    pass


class CannotAccessToDeletedRecord(DialectError):
    pass


class CommitConflict(DialectError):
    """Another session has committed a change of the same table since this transaction began."""
