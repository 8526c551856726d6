"""Column-level helpers (all built-in Spark expressions, no UDFs)."""

from rota.functions.columns import (
    bit_and, bit_or, day_sequence, flag_text, refused_casts, sorted_array, whole_number,
)

__all__ = ["bit_and", "bit_or", "day_sequence", "flag_text", "refused_casts", "sorted_array",
           "whole_number"]
