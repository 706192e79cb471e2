"""Multi-step plans built from the operators: chart dispatch, full profile, training."""
