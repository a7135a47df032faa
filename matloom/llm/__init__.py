"""Operators on training corpora: sampling, search, scans, codecs, archives and duplicates."""
