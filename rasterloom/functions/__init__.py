"""Column functions: colour transfer, compositing, distances, filter taps."""
