"""Message search patterns (#18, #19).

The reference matches ``message ILIKE '%' || q || '%'`` without escaping q, so
``%`` and ``_`` inside q are wildcards and ``\\`` escapes the next character.
Spark's LIKE raises on ``\\`` before an ordinary character, where PostgreSQL
takes that character literally; the pattern is normalized so both agree.
"""

from __future__ import annotations

_ESCAPABLE = "%_\\"


def like_pattern(q: str) -> str:
    """The full ILIKE pattern for substring search ``q``, in Spark's dialect."""
    raw = "%" + q + "%"
    out = []
    i = 0
    while i < len(raw):
        ch = raw[i]
        if ch == "\\" and i + 1 < len(raw):
            nxt = raw[i + 1]
            out.append("\\" + nxt if nxt in _ESCAPABLE else nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "".join(out)

