"""The two main jobs as chains of operators."""
