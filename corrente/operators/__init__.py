"""The operators of a flow, by kind; ``corrente.flow`` puts them together."""
