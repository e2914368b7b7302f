"""Grids as text: walls stand where neighbouring cells aren't joined."""

from __future__ import annotations

from arcweave.model import Graph
from arcweave.operators.local import Local

#: Box corners by the walls that meet: up 1, right 2, down 4, left 8 (fixed values).
BOX = " ╵╶└╷│┌├╴┘─┴┐┤┬┼"


def _open(g: Graph) -> set[tuple[int, int]]:
    return {(min(s, d), max(s, d)) for s, d, _ in Local.of(g).edges()}


def grid_to_string(g: Graph, rows: int, cols: int, occupants: dict[int, str] | None = None) -> str:
    """Cells three wide, walls of +, - and |."""
    joined, inside = _open(g), occupants or {}
    out = ["+" + "---+" * cols]
    for r in range(rows):
        middle, below = "|", "+"
        for c in range(cols):
            i = r * cols + c
            middle += f" {inside.get(i, ' ')[:1]} " + (" " if c < cols - 1 and (i, i + 1) in joined else "|")
            below += ("   " if r < rows - 1 and (i, i + cols) in joined else "---") + "+"
        out += [middle, below]
    return "\n".join(out)


def grid_to_string_unicode(g: Graph, rows: int, cols: int, occupants: dict[int, str] | None = None) -> str:
    """As :func:`grid_to_string`, in box-drawing characters."""
    joined, inside = _open(g), occupants or {}
    wall_below = lambda r, c: not (0 <= r < rows - 1 and (r * cols + c, (r + 1) * cols + c) in joined)
    wall_right = lambda r, c: not (0 <= c < cols - 1 and (r * cols + c, r * cols + c + 1) in joined)
    out = []
    for r in range(-1, rows):
        line = ""
        for c in range(-1, cols):
            # the corner below and right of (r, c)
            up = r >= 0 and wall_right(r, c)
            down = r < rows - 1 and wall_right(r + 1, c)
            left = c >= 0 and wall_below(r, c)
            right = c < cols - 1 and wall_below(r, c + 1)
            line += BOX[up + 2 * right + 4 * down + 8 * left]
            if c < cols - 1:
                line += "───" if right else "   "
        out.append(line)
        if r < rows - 1:
            row = "│"
            for c in range(cols):
                row += f" {inside.get((r + 1) * cols + c, ' ')[:1]} " + ("│" if wall_right(r + 1, c) else " ")
            out.append(row)
    return "\n".join(out)


def _wraps(g: Graph, rows: int, cols: int) -> tuple[set[int], set[int]]:
    joined = _open(g)
    across = {r for r in range(rows) if cols > 2 and (r * cols, r * cols + cols - 1) in joined}
    down = {c for c in range(cols) if rows > 2 and (c, (rows - 1) * cols + c) in joined}
    return across, down


def _wrapped(text: str, across: set[int], down: set[int], rows: int, cols: int, arrows: str) -> str:
    left, up = arrows
    lines = text.split("\n")
    for r in across:
        line = lines[2 * r + 1]
        lines[2 * r + 1] = left + line[1:-1] + left
    mark = "".join(f"  {up if c in down else ' '} " for c in range(cols)).rstrip()
    return "\n".join([mark, *lines, mark]) if down else "\n".join(lines)


def toroidal_to_string(g: Graph, rows: int, cols: int, occupants: dict[int, str] | None = None) -> str:
    """As :func:`grid_to_string`, passages around the edges marked."""
    return _wrapped(grid_to_string(g, rows, cols, occupants), *_wraps(g, rows, cols), rows, cols, "<^")


def toroidal_to_string_unicode(g: Graph, rows: int, cols: int, occupants: dict[int, str] | None = None) -> str:
    return _wrapped(grid_to_string_unicode(g, rows, cols, occupants), *_wraps(g, rows, cols), rows, cols, "↔↕")
