"""Plans of training: trees, local subtrees, packing of tasks, and the level loop."""
