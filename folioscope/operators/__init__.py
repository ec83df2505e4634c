"""DataFrame-to-DataFrame operators by area."""
