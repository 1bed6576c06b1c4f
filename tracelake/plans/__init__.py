"""Bindings of the operators to the given tables, the registered queries, and hooks that users compose."""
