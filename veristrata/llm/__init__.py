"""Operators for preparing large text corpora (see README, section "Corpus operators").

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
