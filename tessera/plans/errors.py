"""Errors that point into the query text."""


class QueryError(Exception):
    """What is wrong with a query, where (``start`` to ``end`` in its text) and what may help."""

    def __init__(self, message: str, start: int = 0, end: int = 0, hint: str | None = None) -> None:
        super().__init__(message)
        self.message, self.start, self.end, self.hint = message, start, end, hint

    def pointed(self, sql: str) -> str:
        """The message under the line it is about."""
        before = sql[: self.start]
        line = sql.splitlines()[before.count("\n")] if sql else ""
        column = self.start - (before.rfind("\n") + 1)
        mark = " " * column + "^" * max(1, min(self.end - self.start, len(line) - column))
        return "\n".join([line, mark, self.message, *([self.hint] if self.hint else [])])
