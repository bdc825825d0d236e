"""Errors that the engine raises."""


class FolioError(Exception):
    """Anything that is wrong with a statement, an expression or its use."""


class SyntaxFault(FolioError):
    """Text that does not parse."""


class BindFault(FolioError):
    """An expression that does not fit the schema or its place."""


class ConflictFault(FolioError):
    """A write that breaks a unique key, or comes too late."""
