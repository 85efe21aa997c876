"""Two kinds of failure: data that contradicts itself, and data that is sound but not handled."""


class InvalidData(ValueError):
    """A table, an option or an encoded column that breaks its own rules."""


class Unsupported(NotImplementedError):
    """Something well formed that Spark has no type or operator for."""
