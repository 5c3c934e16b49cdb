"""From slot probabilities to ranked readings of a question."""
