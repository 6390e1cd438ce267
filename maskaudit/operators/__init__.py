"""DataFrame-to-DataFrame operators; every one is a plan, none collects data."""
