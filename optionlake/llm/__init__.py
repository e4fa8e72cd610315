"""Operators of a training-data pipeline: quality, duplicates, decontamination, packing, scoring."""
