"""Connected components, as the graph's operators find them."""

from lattica.operators.weak import TASK_EDGES, components, local_labels

__all__ = ["TASK_EDGES", "components", "local_labels"]
