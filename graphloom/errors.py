"""Errors carry a stable code and details."""

from __future__ import annotations


class GraphError(Exception):
    def __init__(self, code: str, message: str, **details: object):
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details


def unsupported(clause: str) -> GraphError:
    return GraphError("UNSUPPORTED_FEATURE", f"not supported: {clause}", unsupported_clause=clause)


def syntax(message: str) -> GraphError:
    return GraphError("SYNTAX_ERROR", message)


def invalid(message: str) -> GraphError:
    return GraphError("INVALID_ARGUMENT", message)
