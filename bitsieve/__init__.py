"""bitsieve: approximate set membership over key columns as Spark DataFrames."""

from bitsieve.operators.filter import Filter
from bitsieve.spec import FilterSpec, Variant

__all__ = ["Filter", "FilterSpec", "Variant"]
