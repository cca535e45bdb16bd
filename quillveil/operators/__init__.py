"""Operators over tables: detection, write-back, evaluation, image plans."""
