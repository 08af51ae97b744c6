"""Live sessions as a stateful stream."""
