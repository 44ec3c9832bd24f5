"""Errors of the engine."""


class ModelError(ValueError):
    """A model or a row of one is not valid."""


class QueryError(ValueError):
    """A query asks for what its model doesn't offer."""


class PublishError(ValueError):
    """A message has no channel to go to."""


class SubscribeError(RuntimeError):
    """A handler failed on a batch."""
