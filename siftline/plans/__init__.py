"""Session settings and storage of intermediate tables."""
