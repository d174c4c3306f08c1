"""DuckDB spellings shared by oracle queries."""

from tuneframe import constants as K

# Python whitespace as a DuckDB string expression.
WS = " || ".join(f"chr({ord(c)})" for c in K.PY_WHITESPACE)
NL = "chr(10)"


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def sections(pairs, prefix: str) -> str:
    """``heading\\nvalue`` blocks joined by blank lines, values null -> 'None'."""
    out = []
    for i, (heading, value) in enumerate(pairs):
        if i:
            out.append(f"{NL} || {NL}")
        out.append(f"'{prefix}{heading}' || {NL}")
        out.append(f"coalesce(cast({value} AS VARCHAR), 'None')")
    return " || ".join(out)
