"""Training-data operators for text and agent trajectories. Nothing outside this package imports it."""
