"""DataFrame-to-DataFrame operators over the canonical timeline columns."""
