"""Window features, novelty and rolling baselines on event streams."""
