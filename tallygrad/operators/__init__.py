"""Operators: DataFrame in, DataFrame out. Only ``run_pass`` and vector ``scale`` run a job of their own."""
