"""DataFrame to DataFrame steps. None of them collects rows or starts a Python worker."""
