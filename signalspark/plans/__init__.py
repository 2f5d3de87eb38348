"""Feature bundles and cleaning plans."""
