"""Edge lists, adjacency lists, matrices, Matrix Market, Pajek and TGF.

Line formats are read as DataFrames (``scan_*``), split and cast by built-in
functions, so large files are read in parallel; ``parse_*`` takes a string.
Text is written from sorted rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, canonical, edge_frame, last_wins, node_frame
from arcweave.operators.local import MAX_EDGES, Local


class ParseError(ValueError):
    """Text that isn't of the format, with the line where that shows."""


@dataclass(frozen=True)
class Warned:
    """A graph and what was passed over: (line, kind, text)."""

    graph: Graph
    warnings: list[tuple[int, str, str]] = field(default_factory=list)


def _number(text: str) -> int | float:
    try:
        return int(text)
    except ValueError:
        return float(text)


def _built(nodes: Iterable[tuple], edges: Iterable[tuple], directed: bool) -> Graph:
    """A graph of (id, data) and (src, dst, w), both with the last repeat winning; ends become nodes."""
    kept: dict = {}
    for s, d, w in edges:
        kept[(s, d) if directed else (min(s, d), max(s, d))] = w
    held = dict(nodes)
    for e in kept:
        for n in e:
            held.setdefault(n, None)
    return Graph(node_frame(sorted(held.items())), edge_frame([(s, d, w) for (s, d), w in sorted(kept.items())]), directed)


def _plain(w: object) -> str:
    return "" if w is None else str(int(w)) if isinstance(w, float) and w.is_integer() else str(w)


# ---------------------------------------------------------------- edge lists


def from_edges(edges: Iterable[tuple], directed: bool = True) -> Graph:
    return _built([], [(s, d, *(rest or (None,))) for s, d, *rest in edges], directed)


def to_edges(g: Graph) -> DataFrame:
    return g.all_edges()


def parse_edge_list(text: str, directed: bool = True) -> Graph:
    """Lines ``src dst [w]`` parted by blanks, tabs or commas; # begins a comment; the first bad line raises."""
    edges = []
    for i, line in enumerate(text.splitlines(), 1):
        parts = [p for p in re.split(r"[ \t,]+", line.split("#", 1)[0].strip()) if p]
        if not parts:
            continue
        try:
            if len(parts) not in (2, 3):
                raise ValueError
            edges.append((int(parts[0]), int(parts[1]), float(parts[2]) if len(parts) == 3 else 1.0))
        except ValueError:
            raise ParseError(f"line {i}: {line!r} is not an edge") from None
    return _built([], edges, directed)


def scan_edge_list(lines: DataFrame, directed: bool = True) -> Graph:
    """The same from a DataFrame of lines (value); bad lines raise when they are read."""
    bare = F.trim(F.regexp_replace("value", r"#.*$", ""))
    parts = F.filter(F.split(bare, r"[ \t,]+"), lambda p: p != "")
    rows = lines.select("value", parts.alias("p"), F.monotonically_increasing_id().alias("_at")).where(F.size("p") > 0)
    number = F.coalesce(F.try_element_at("p", F.lit(3)), F.lit("1")).try_cast("double")
    src, dst = F.element_at("p", 1).try_cast("long"), F.try_element_at("p", F.lit(2)).try_cast("long")
    bad = src.isNull() | dst.isNull() | number.isNull() | (F.size("p") > 3)
    fail = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
    rows = rows.select(F.when(bad, fail.cast("long")).otherwise(src).alias("src"), dst.alias("dst"), number.alias("w"), "_at")
    return Graph.from_frames(None, last_wins(canonical(rows, directed), ["src", "dst"], "_at"), directed)


def edge_list_lines(g: Graph, weighted: bool = True) -> DataFrame:
    """(value), sorted by edge: ``src dst[ w]`` with six decimals."""
    parts = [F.col("src").cast("string"), F.col("dst").cast("string")]
    if weighted:
        parts.append(F.format_string("%.6f", F.col("w").cast("double")))
    return g.all_edges().select(F.concat_ws(" ", *parts).alias("value"))


def serialize_edge_list(g: Graph, weighted: bool = True, max_edges: int = MAX_EDGES) -> str:
    local = Local.of(g, max_edges)
    return "\n".join(f"{s} {d}" + (f" {float(w):.6f}" if weighted and w is not None else "") for s, d, w in local.edges())


# ---------------------------------------------------------------- adjacency lists


@dataclass(frozen=True)
class ListOptions:
    weighted: bool = False
    delimiter: str = ":"


def from_list(rows: Iterable[tuple[int, list[tuple[int, object]]]], directed: bool = True) -> Graph:
    rows = list(rows)
    return _built([(s, None) for s, _ in rows], [(s, d, w) for s, near in rows for d, w in near], directed)


def to_list(g: Graph) -> DataFrame:
    """(id, neighbors array<struct<dst, w>>), sorted, isolated nodes with none."""
    near = g.arcs().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("neighbors"))
    return g.nodes.select("id").join(near, "id", "left").orderBy("id")


def parse_adjacency(text: str, options: ListOptions = ListOptions(), directed: bool = True) -> Graph:
    """Lines ``id: n1 n2`` or, weighted, ``id: n1,w1 n2,w2``."""
    rows = []
    for i, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        try:
            head, _, rest = line.partition(options.delimiter)
            near = []
            for token in rest.split():
                n, _, w = token.partition(",")
                near.append((int(n), float(w) if w else 1.0))
            rows.append((int(head), near))
        except ValueError:
            raise ParseError(f"line {i}: {line!r} is not an adjacency row") from None
    return from_list(rows, directed)


from_string = parse_adjacency


def serialize_adjacency(g: Graph, options: ListOptions = ListOptions(), max_edges: int = MAX_EDGES) -> str:
    local = Local.of(g, max_edges)
    lines = []
    for n in local.nodes:
        near = [f"{d},{float(w if w is not None else 1):.6f}" if options.weighted else str(d) for d, w in local.out[n].items()]
        lines.append(f"{n}{options.delimiter}" + "".join(f" {x}" for x in near))
    return "\n".join(lines)


# ---------------------------------------------------------------- matrices


def from_matrix(matrix: list[list[float]], directed: bool = True) -> Graph:
    """Square weights, 0 for none, the diagonal ignored; undirected reads above it."""
    n = len(matrix)
    if any(len(row) != n for row in matrix):
        raise ParseError("the matrix is not square")
    edges = [(i, j, float(matrix[i][j])) for i in range(n) for j in range(n) if i != j and matrix[i][j] and (directed or i < j)]
    return _built([(i, None) for i in range(n)], edges, directed)


def to_matrix(g: Graph, max_nodes: int = 5000) -> tuple[list[int], list[list[float]]]:
    """(sorted ids, rows), the diagonal 0; quadratic, so bounded."""
    local = Local.of(g)
    if len(local.nodes) > max_nodes:
        raise ParseError(f"more than {max_nodes} nodes")
    at = {n: i for i, n in enumerate(local.nodes)}
    rows = [[0.0] * len(at) for _ in at]
    for u in local.nodes:
        for v, w in local.out[u].items():
            if u != v:
                rows[at[u]][at[v]] = float(1 if w is None else w)
    return local.nodes, rows


def matrix_rows(g: Graph) -> DataFrame:
    """(row, cols, vals): sparse rows, relationally."""
    near = g.arcs().where("src <> dst").groupBy(F.col("src").alias("row")).agg(F.array_sort(F.collect_list(F.struct("dst", F.col("w").cast("double").alias("w")))).alias("x"))
    return near.select("row", F.transform("x", lambda s: s["dst"]).alias("cols"), F.transform("x", lambda s: s["w"]).alias("vals"))


def serialize_matrix(g: Graph, delimiter: str = " ") -> str:
    return "\n".join(delimiter.join(_plain(x) for x in row) for row in to_matrix(g)[1])


# ---------------------------------------------------------------- Matrix Market


@dataclass(frozen=True)
class MatrixMarketOptions:
    weight: Callable[[object], str] = _plain


def parse_matrix_market(text: str, weight: Callable[[str], object] = float) -> Warned:
    """Coordinate format: real, integer, complex (its magnitude) or pattern; general or symmetric."""
    lines = text.splitlines()
    head = lines[0].lower().split() if lines else []
    if len(head) < 5 or head[0] != "%%matrixmarket" or head[1] != "matrix":
        raise ParseError("line 1: no Matrix Market header")
    if head[2] != "coordinate":
        raise ParseError(f"line 1: {head[2]} matrices are not supported")
    kind, symmetry = head[3], head[4]
    if kind not in ("real", "integer", "complex", "pattern"):
        raise ParseError(f"line 1: unknown field {kind}")
    if symmetry not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise ParseError(f"line 1: unknown symmetry {symmetry}")
    size, edges, warnings = None, [], []
    for i, line in enumerate(lines[1:], 2):
        parts = line.split()
        if not parts or line.lstrip().startswith("%"):
            continue
        if size is None:
            try:
                rows, cols, size = (int(x) for x in parts)
            except ValueError:
                raise ParseError(f"line {i}: no size line") from None
            continue
        try:
            s, d = int(parts[0]), int(parts[1])
            if not (1 <= s <= rows and 1 <= d <= cols):
                warnings.append((i, "out of range", line))
                continue
            w = 1.0 if kind == "pattern" else abs(complex(float(parts[2]), float(parts[3]))) if kind == "complex" else weight(parts[2])
            edges.append((s, d, w))
        except (ValueError, IndexError):
            warnings.append((i, "not an entry", line))
    if size is None:
        raise ParseError("no size line")
    if len(edges) != size:
        warnings.append((len(lines), "entry count", f"{size} announced, {len(edges)} found"))
    return Warned(_built([(n, None) for n in range(1, max(rows, cols) + 1)], edges, symmetry == "general"), warnings)


def serialize_matrix_market(g: Graph, options: MatrixMarketOptions = MatrixMarketOptions(), max_edges: int = MAX_EDGES) -> str:
    """Ids become 1 .. n by order."""
    local = Local.of(g, max_edges)
    at = {n: i for i, n in enumerate(local.nodes, 1)}
    edges = local.edges()
    bare = all(w is None for *_, w in edges)
    head = f"%%MatrixMarket matrix coordinate {'pattern' if bare else 'real'} {'general' if g.directed else 'symmetric'}"
    # a symmetric matrix is stored below its diagonal
    ends = lambda s, d: (at[s], at[d]) if g.directed else (at[d], at[s])
    rows = [" ".join([*map(str, ends(s, d)), *([] if bare else [options.weight(w)])]) for s, d, w in edges]
    return "\n".join([head, f"{len(at)} {len(at)} {len(edges)}", *rows]) + "\n"


# ---------------------------------------------------------------- Pajek


@dataclass(frozen=True)
class PajekOptions:
    label: Callable[[int, object], str] = lambda n, data: str(n if data is None else data)
    weight: Callable[[object], str | None] = lambda w: None if w is None else _plain(w)


def parse_pajek(text: str, label: Callable[[str], object] = str, weight: Callable[[str], object] = float) -> Warned:
    """``*Vertices n`` with quoted labels, then ``*Arcs`` or ``*Edges``; % begins a comment."""
    section, directed, nodes, edges, warnings, count = None, None, {}, [], [], None
    for i, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare or bare.startswith("%"):
            continue
        if bare.startswith("*"):
            name, *rest = bare[1:].lower().split()
            if name == "vertices":
                try:
                    section, count = "vertices", int(rest[0])
                except (IndexError, ValueError):
                    raise ParseError(f"line {i}: no vertex count") from None
                nodes = {n: None for n in range(1, count + 1)}
            elif name in ("arcs", "edges", "arcslist", "edgeslist"):
                kind = name.startswith("arcs")
                if directed is None:
                    directed = kind
                elif directed != kind:
                    warnings.append((i, "mixed sections", bare))
                section = name
            else:
                warnings.append((i, "unknown section", bare))
                section = None
            continue
        if count is None:
            raise ParseError(f"line {i}: *Vertices must come first")
        tokens = re.findall(r'"([^"]*)"|(\S+)', bare)
        parts = [a or b for a, b in tokens]
        try:
            if section == "vertices":
                n = int(parts[0])
                if n not in nodes:
                    warnings.append((i, "out of range", bare))
                else:
                    nodes[n] = label(parts[1]) if len(parts) > 1 else None
            elif section in ("arcs", "edges"):
                edges.append((int(parts[0]), int(parts[1]), weight(parts[2]) if len(parts) > 2 else 1.0))
            elif section:
                edges += [(int(parts[0]), int(p), 1.0) for p in parts[1:]]
        except (ValueError, IndexError):
            warnings.append((i, "not a row", bare))
    if count is None:
        raise ParseError("no *Vertices section")
    known = [e for e in edges if e[0] in nodes and e[1] in nodes]
    warnings += [(0, "unknown vertex", f"{s} {d}") for s, d, _ in edges if s not in nodes or d not in nodes]
    return Warned(_built(nodes.items(), known, directed is not False), warnings)


def serialize_pajek(g: Graph, options: PajekOptions = PajekOptions(), max_edges: int = MAX_EDGES) -> str:
    local = Local.of(g, max_edges)
    at = {n: i for i, n in enumerate(local.nodes, 1)}
    lines = [f"*Vertices {len(at)}"] + [f'{i} "{options.label(n, local.data.get(n))}"' for n, i in at.items()]
    lines.append("*Arcs" if g.directed else "*Edges")
    for s, d, w in local.edges():
        text = options.weight(w)
        lines.append(f"{at[s]} {at[d]}" + (f" {text}" if text is not None else ""))
    return "\n".join(lines) + "\n"


# ---------------------------------------------------------------- TGF


@dataclass(frozen=True)
class TgfOptions:
    node_label: Callable[[int, object], str | None] = lambda n, data: str(n if data is None else data)
    edge_label: Callable[[object], str | None] = lambda w: None


def parse_tgf(text: str, node: Callable[[str], object] = str, edge: Callable[[str], object] = str, directed: bool = True) -> Warned:
    """Lines ``id label``, a line ``#``, lines ``src dst label``; bad nodes raise, bad edges are passed over."""
    nodes, edges, warnings, below = {}, [], [], False
    for i, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        if not bare:
            continue
        if bare == "#":
            below = True
            continue
        parts = bare.split(None, 2 if below else 1)
        if not below:
            try:
                n = int(parts[0])
            except ValueError:
                raise ParseError(f"line {i}: {parts[0]!r} is not a node id") from None
            if n in nodes:
                raise ParseError(f"line {i}: node {n} repeats")
            nodes[n] = node(parts[1]) if len(parts) > 1 else None
        else:
            try:
                edges.append((int(parts[0]), int(parts[1]), edge(parts[2]) if len(parts) > 2 else None))
            except (ValueError, IndexError):
                warnings.append((i, "not an edge", bare))
    return Warned(_built(nodes.items(), edges, directed), warnings)


def serialize_tgf(g: Graph, options: TgfOptions = TgfOptions(), max_edges: int = MAX_EDGES) -> str:
    local = Local.of(g, max_edges)
    lines = []
    for n in local.nodes:
        label = options.node_label(n, local.data.get(n))
        lines.append(f"{n}" + (f" {label}" if label else ""))
    lines.append("#")
    for s, d, w in local.edges():
        label = options.edge_label(w)
        lines.append(f"{s} {d}" + (f" {label}" if label else ""))
    return "\n".join(lines) + "\n"
