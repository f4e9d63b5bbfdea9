"""Scalar and array functions: motifs, modification strings, alignment, formats."""
