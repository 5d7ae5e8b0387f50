"""Column-level building blocks: no jobs, no Python workers, only expressions."""
