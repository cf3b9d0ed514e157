"""Table operators: extraction, grids, chunks, invariants, retrieval, evaluation, anonymization."""
