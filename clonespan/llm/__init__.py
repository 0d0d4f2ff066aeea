"""Operators of a training-data pipeline: archives, deduplication, classifiers, decontamination, mixing and sharding."""
