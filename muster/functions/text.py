"""String expressions."""

from __future__ import annotations

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029"
    "\u202f\u205f\u3000"
)

# The five HTML entities, ampersand first.
HTML_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + "".join(c if c.isalnum() else f"\\u{ord(c):04x}" for c in text) + "'"


def strip(x: str) -> str:
    return f"btrim({x}, {literal(WHITESPACE)})"


def html_escape(x: str) -> str:
    for char, entity in HTML_ENTITIES.items():
        x = f"replace({x}, {literal(char)}, {literal(entity)})"
    return x


def sanitize(x: str) -> str:
    """Strip and escape; NULL becomes the empty string."""
    return html_escape(strip(f"coalesce(cast({x} AS STRING), '')"))


def blank_to_null(x: str) -> str:
    return f"nullif({x}, '')"


def ascii_lower(x: str) -> str:
    """Lower-case A-Z only: accented letters stay distinct when searching."""
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
