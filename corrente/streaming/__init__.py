"""Flows over Structured Streaming: the stateless operators work as they are; running folds by key keep state."""
