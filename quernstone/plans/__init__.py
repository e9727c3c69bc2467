"""What reads Spark's parsed plans: the read-only gate, statement signatures, explanations, repairs."""
