"""DataFrame operators: keys, aggregates, order statistics, features, audits."""
