"""Errors of the engine, by what is wrong."""


class EngineError(Exception):
    """Any error that a statement can end with."""


class SyntaxFault(EngineError):
    """The text is no statement of the dialect."""


class Unsupported(EngineError):
    """A known SQL feature that the dialect leaves out; ``feature`` names it."""

    def __init__(self, feature: str):
        super().__init__(f"not supported: {feature}")
        self.feature = feature


class NameFault(EngineError):
    """A table, column or function that does not exist, or an ambiguous name."""


class TypeFault(EngineError):
    """A value that its column's declared type does not take."""


class ConstraintFault(EngineError):
    """kind: not null, unique, or foreign key."""

    def __init__(self, kind: str, what: str):
        super().__init__(f"{kind} constraint failed: {what}")
        self.kind = kind


class MatchFault(EngineError):
    """A full-text query that cannot be read, or a MATCH outside of its place."""


class ParameterFault(EngineError):
    """A parameter without a value."""
