"""Walking over Arrow batches, as the core does."""

from ..plans.batches import BYTES, ROWS, slices

__all__ = ["BYTES", "ROWS", "slices"]
