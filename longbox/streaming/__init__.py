"""Session progress as keyed state, and its batch twins."""
