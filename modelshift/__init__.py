"""Reshape data between relational, document, graph and wide-column models on Spark."""

from modelshift.dataset import Dataset, Step, run_steps, step

__all__ = ["Dataset", "Step", "run_steps", "step"]
