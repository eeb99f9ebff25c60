"""Operators for preparing text corpora: decontamination, duplicate passages,
packing, quality rules, licence notices, sharding, near duplicates, repeated
lines, toxicity and URL filters.

Nothing else in the library imports this subpackage."""
