"""Errors of the semantic layer; messages carry the text that users search for."""


class SemanticError(ValueError):
    """Anything wrong with a model or a query."""


class DeployError(SemanticError):
    """A model that cannot be registered."""


class QueryError(SemanticError):
    """A query that the model cannot answer."""


class AccessError(SemanticError):
    """The caller's roles do not suffice."""
