"""Exceptions of the sequence and container layers."""


class PipelineError(RuntimeError):
    """Base of all errors that the library raises itself."""


class IllegalStateException(PipelineError):
    pass


class IllegalCollectorStateException(IllegalStateException):
    pass


class IllegalArgumentException(PipelineError, ValueError):
    pass


class IndexOutOfBoundsException(PipelineError, IndexError):
    pass


class NoSuchElementException(PipelineError, LookupError):
    pass


class NullPointerException(PipelineError, TypeError):
    pass


class UnsupportedOperationException(PipelineError, NotImplementedError):
    pass


class ConcurrentModificationException(PipelineError):
    pass


class ArithmeticException(PipelineError, ArithmeticError):
    pass


CONSUMED = "stream has already been operated upon or closed"
