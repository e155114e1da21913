"""Physical building blocks: overlay, fold, partitions, index tree, tools."""
