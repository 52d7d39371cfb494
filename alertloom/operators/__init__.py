"""DataFrame operators: window features, rolling baselines, novelty, rules, metrics, models."""
