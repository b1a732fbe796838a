"""Named errors of the engine."""


class DimensionMismatchError(ValueError):
    """Vectors have another length than was declared."""

    def __init__(self, expected: int, found: int):
        super().__init__(f"expected {expected} dimensions, found {found}")


class TargetValueError(ValueError):
    """A class label is not among the declared targets."""

    def __init__(self, label, targets):
        super().__init__(f"label {label!r} is not one of {list(targets)!r}")


class SingularMatrixError(ValueError):
    """A system has no unique solution; more rows or a penalty are needed."""
