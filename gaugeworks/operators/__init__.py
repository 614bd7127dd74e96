"""DataFrame operators: summaries, ordinals, lookups, spatial joins, edits and kernels."""
