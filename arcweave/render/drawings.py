"""DOT and Mermaid text, and options that highlight results."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from arcweave.model import Graph
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.multigraph import MultiGraph
from arcweave.operators.transform import TooLarge
from arcweave.sources.files import write_text


def _name(n: int, data: object) -> str:
    return str(n)


def _weight(w: object) -> str:
    return "" if w is None else str(w)


@dataclass(frozen=True)
class DotOptions:
    node_label: Callable[[int, object], str] = _name
    edge_label: Callable[[object], str] = _weight
    shape: str = "ellipse"
    color: str = "red"
    nodes: frozenset[int] = frozenset()
    edges: frozenset[tuple[int, int]] = frozenset()
    sides: tuple[frozenset[int], frozenset[int]] | None = None


@dataclass(frozen=True)
class MermaidOptions:
    node_label: Callable[[int, object], str] = _name
    edge_label: Callable[[object], str] = _weight
    direction: str = "TD"
    nodes: frozenset[int] = frozenset()
    edges: frozenset[tuple[int, int]] = frozenset()
    sides: tuple[frozenset[int], frozenset[int]] | None = None


default_dot_options = default_dot_multi_options = DotOptions()
default_mermaid_options = default_mermaid_multi_options = MermaidOptions()


def path_to_options(options, nodes: Iterable[int]):
    """The nodes and steps of a path."""
    nodes = list(nodes)
    return replace(options, nodes=frozenset(nodes), edges=frozenset(zip(nodes, nodes[1:], strict=False)))


def mst_to_options(options, edges: Iterable[tuple]):
    """A tree's edges and their ends."""
    pairs = [(e[0], e[1]) for e in edges]
    return replace(options, nodes=frozenset(n for p in pairs for n in p), edges=frozenset(pairs))


def cut_to_options(options, source_side: Iterable[int], sink_side: Iterable[int]):
    """The two sides of a cut."""
    return replace(options, sides=(frozenset(source_side), frozenset(sink_side)))


def matching_to_options(options, matching: dict[int, int] | Iterable[tuple[int, int]]):
    """Matched pairs, each once."""
    pairs = matching.items() if isinstance(matching, dict) else matching
    once = {(min(p), max(p)) for p in pairs}
    return replace(options, nodes=frozenset(n for p in once for n in p), edges=frozenset(once))


path_to_multi_options = path_to_options
mst_to_multi_options = mst_to_options
cut_to_multi_options = cut_to_options
matching_to_multi_options = matching_to_options


def _parts(g: Graph | MultiGraph, max_edges: int):
    """(nodes with payloads, edges (s, d, w, eid or None))."""
    if isinstance(g, Graph):
        local = Local.of(g, max_edges)
        return [(n, local.data.get(n)) for n in local.nodes], [(s, d, w, None) for s, d, w in local.edges()]
    rows, nodes = g.edges.limit(max_edges + 1).collect(), g.nodes.limit(max_edges + 1).collect()
    if len(rows) > max_edges or len(nodes) > max_edges:
        raise TooLarge(f"more than {max_edges} nodes or edges to draw")
    return sorted((r["id"], r["data"]) for r in nodes), sorted(((r["src"], r["dst"], r["w"], r["eid"]) for r in rows), key=lambda e: e[3])


def _lit(options, directed: bool, s: int, d: int) -> bool:
    return (s, d) in options.edges or (not directed and (d, s) in options.edges)


def _quote(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def render_dot(g: Graph | MultiGraph, options: DotOptions = default_dot_options, max_edges: int = MAX_EDGES) -> str:
    nodes, edges = _parts(g, max_edges)
    kind, arrow = ("digraph", "->") if g.directed else ("graph", "--")
    out = [f"{kind} G {{", f"  node [shape={options.shape}];"]
    for n, data in nodes:
        marks = [f"label={_quote(options.node_label(n, data))}"]
        if options.sides and n in options.sides[0]:
            marks.append('style=filled, fillcolor="lightblue"')
        elif options.sides and n in options.sides[1]:
            marks.append('style=filled, fillcolor="lightyellow"')
        elif n in options.nodes:
            marks.append(f'color="{options.color}", penwidth=2')
        out.append(f"  {n} [{', '.join(marks)}];")
    for s, d, w, eid in edges:
        marks = []
        if label := options.edge_label(w):
            marks.append(f"label={_quote(label)}")
        if eid is not None:
            marks.append(f'id="e{eid}"')
        if _lit(options, g.directed, s, d):
            marks.append(f'color="{options.color}", penwidth=2')
        out.append(f"  {s} {arrow} {d}" + (f" [{', '.join(marks)}]" if marks else "") + ";")
    return "\n".join([*out, "}"]) + "\n"


render_dot_multi = render_dot


def render_mermaid(g: Graph | MultiGraph, options: MermaidOptions = default_mermaid_options, max_edges: int = MAX_EDGES) -> str:
    nodes, edges = _parts(g, max_edges)
    arrow = "-->" if g.directed else "---"
    text = lambda x: x.replace('"', "#quot;")
    out = [f"graph {options.direction}"]
    lit = options.nodes or options.edges
    if lit:
        out += ["  classDef highlight fill:#ffeb3b,stroke:#f57c00,stroke-width:3px", "  linkStyle default stroke-width:1px"]
    if options.sides:
        out += ["  classDef sourceSide fill:#bbdefb", "  classDef sinkSide fill:#fff9c4"]
    for n, data in nodes:
        mark = ":::highlight" if n in options.nodes else ""
        if options.sides:
            mark = ":::sourceSide" if n in options.sides[0] else ":::sinkSide" if n in options.sides[1] else mark
        out.append(f'  {n}["{text(options.node_label(n, data))}"]{mark}')
    marked = []
    for i, (s, d, w, _) in enumerate(edges):
        label = options.edge_label(w)
        out.append(f"  {s} {arrow}" + (f'|"{text(label)}"|' if label else "") + f" {d}")
        if _lit(options, g.directed, s, d):
            marked.append(str(i))
    if marked:
        out.append(f"  linkStyle {','.join(marked)} stroke:#f57c00,stroke-width:3px")
    return "\n".join(out) + "\n"


render_mermaid_multi = render_mermaid


def write_dot(g: Graph | MultiGraph, path: str, options: DotOptions = default_dot_options) -> None:
    write_text(render_dot(g, options), path)


def write_mermaid(g: Graph | MultiGraph, path: str, options: MermaidOptions = default_mermaid_options) -> None:
    write_text(render_mermaid(g, options), path)


write_dot_multi = write_dot
write_mermaid_multi = write_mermaid
