"""Review analytics on Spark: clean, redact, theme, rank, quote, report, archive.

Column expressions live in ``functions``, DataFrame-to-DataFrame steps in
``operators``, readers and writers in ``sources``, whole jobs in ``plans`` and
the incremental job in ``streaming``.
"""
