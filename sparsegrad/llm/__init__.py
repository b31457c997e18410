"""Operators of a training-data pipeline: personal data, quality rules, near
duplicates, mixing, quality and toxicity scores, language, WARC, benchmark
decontamination, sharding, hard negatives, Merkle manifests and language-model
scores. Nothing else in the library imports this subpackage."""
