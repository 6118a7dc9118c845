"""Operators for large text corpora: deduplication, decontamination, token counts, quality, licences, HTML."""
