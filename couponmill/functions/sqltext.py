"""Text for SQL expressions."""


def literal(text: str) -> str:
    """``text`` as a SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def identifier(name: str) -> str:
    """A table name, with or without its database, quoted part by part."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))
