"""Diagnostic rules as data: predicates over one wide row of facts per stream."""
