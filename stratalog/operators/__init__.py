"""Selection verbs, samplers, graph operators and metrics over DataFrames."""
