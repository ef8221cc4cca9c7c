"""DataFrame operators over detection, instance and run tables."""
