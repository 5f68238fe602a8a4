"""DataFrame-to-DataFrame steps, keyed by product and week."""
