"""Names and texts inside SQL expressions."""


def quoted(name: str) -> str:
    """``name`` as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """``value`` as an SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
