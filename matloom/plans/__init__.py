"""Plan helpers shared by the operators."""
