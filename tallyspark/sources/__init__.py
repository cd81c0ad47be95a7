"""Table specs, readers and writers."""
