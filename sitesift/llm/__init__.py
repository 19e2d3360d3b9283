"""Training-data operators: quality, language, toxicity and personal-data models,
URL filters, licence scans, token counts, near-duplicate and benchmark removal and
source mixing. Nothing else in the library imports this subpackage."""
