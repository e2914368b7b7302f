"""JSON dialects, GDF and GraphML: graphs whose nodes and edges carry attributes."""

from __future__ import annotations

import csv
import io
import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.model import Graph, _spark
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.sources.files import read_text, write_text
from arcweave.sources.text_formats import ParseError, _built

Attributes = dict[str, str]


def _ids(names: list[str]) -> dict[str, int]:
    """Numbers for node names: the number itself, else the next one free by first appearance."""
    out: dict[str, int] = {}
    for name in names:
        if name not in out:
            try:
                out[name] = int(name)
            except ValueError:
                pass
    taken = set(out.values())
    free = max(taken, default=-1) + 1
    for name in names:
        if name not in out:
            out[name] = free
            free += 1
    return out


# ---------------------------------------------------------------- JSON

FORMATS = ("generic", "d3", "cytoscape", "vis_js", "networkx")


def default_node_serializer(data: object) -> object:
    return data


def default_edge_serializer(w: object) -> object:
    return w


def detect_format(text: str) -> str:
    """The dialect, by the keys at the top and in the first entries."""
    x = json.loads(text)
    if not isinstance(x, dict):
        raise ParseError("a JSON graph is an object")
    if isinstance(x.get("elements"), (dict, list)):
        return "cytoscape"
    if "links" in x:
        return "networkx" if "directed" in x or "multigraph" in x else "d3"
    if "edges" in x and any("from" in e for e in x["edges"]):
        return "vis_js"
    if "nodes" in x:
        return "generic"
    raise ParseError("no known JSON graph dialect")


def render_json(g: Graph, dialect: str = "generic", node: Callable = default_node_serializer, edge: Callable = default_edge_serializer, max_edges: int = MAX_EDGES) -> str:
    """A graph in one of ``FORMATS``; undirected edges once."""
    local = Local.of(g, max_edges)
    nodes, edges = [(n, node(local.data.get(n))) for n in local.nodes], [(s, d, edge(w)) for s, d, w in local.edges()]
    if dialect == "generic":
        made = {
            "kind": "directed" if g.directed else "undirected",
            "nodes": [{"id": n, "data": d} for n, d in nodes],
            "edges": [{"source": s, "target": d, "weight": w} for s, d, w in edges],
        }
    elif dialect == "d3":
        made = {"nodes": [{"id": str(n), "data": d} for n, d in nodes], "links": [{"source": str(s), "target": str(d), "value": w} for s, d, w in edges]}
    elif dialect == "cytoscape":
        made = {"elements": {
            "nodes": [{"data": {"id": str(n), "label": d}} for n, d in nodes],
            "edges": [{"data": {"id": f"e{i}", "source": str(s), "target": str(d), "weight": w}} for i, (s, d, w) in enumerate(edges)],
        }}
    elif dialect == "vis_js":
        made = {"nodes": [{"id": n, "label": d} for n, d in nodes], "edges": [{"from": s, "to": d, "label": w} for s, d, w in edges]}
    elif dialect == "networkx":
        made = {
            "directed": g.directed, "multigraph": False, "graph": {},
            "nodes": [{"id": n, "data": d} for n, d in nodes], "links": [{"source": s, "target": d, "weight": w} for s, d, w in edges],
        }
    else:
        raise ValueError(f"unknown dialect {dialect}")
    return json.dumps(made, ensure_ascii=False)


def parse_json(text: str) -> Graph:
    """Any of the dialects; names that aren't numbers get numbers by first appearance."""
    try:
        dialect, x = detect_format(text), json.loads(text)
    except json.JSONDecodeError as e:
        raise ParseError(str(e)) from None
    if dialect == "cytoscape":
        e = x["elements"]
        if isinstance(e, list):
            e = {"nodes": [i for i in e if "source" not in i["data"]], "edges": [i for i in e if "source" in i["data"]]}
        nodes = [(i["data"]["id"], i["data"].get("label")) for i in e.get("nodes", [])]
        edges = [(i["data"]["source"], i["data"]["target"], i["data"].get("weight")) for i in e.get("edges", [])]
        directed = False
    elif dialect == "vis_js":
        nodes = [(i["id"], i.get("label")) for i in x["nodes"]]
        edges = [(i["from"], i["to"], i.get("label", i.get("value"))) for i in x["edges"]]
        directed = False
    else:
        nodes = [(i["id"], i.get("data", i.get("label"))) for i in x["nodes"]]
        edges = [(i["source"], i["target"], i.get("weight", i.get("value"))) for i in x.get("links", x.get("edges", []))]
        directed = dialect != "d3" and (bool(x.get("directed", False)) if dialect == "networkx" else x.get("kind", "directed").lower() == "directed")
    ids = _ids([str(n) for n, _ in nodes] + [str(n) for s, d, _ in edges for n in (s, d)])
    text_of = lambda d: d if d is None or isinstance(d, str) else json.dumps(d)
    return _built([(ids[str(n)], text_of(d)) for n, d in nodes], [(ids[str(s)], ids[str(d)], _weight(w)) for s, d, w in edges], directed)


def _weight(w: object) -> object:
    if isinstance(w, str):
        try:
            return float(w)
        except ValueError:
            return w
    return w


def write_json(g: Graph, path: str, dialect: str = "generic") -> None:
    write_text(render_json(g, dialect), path)


def read_json(path: str) -> Graph:
    return parse_json(read_text(path))


# ---------------------------------------------------------------- attribute graphs


def _attribute_graph(nodes: list[tuple[int, Attributes]], edges: list[tuple[int, int, Attributes]], directed: bool) -> Graph:
    """A graph whose payloads and weights are maps of strings; ends become nodes without attributes."""
    kept: dict = {}
    for s, d, a in edges:
        kept[(s, d) if directed else (min(s, d), max(s, d))] = a
    held = dict(nodes)
    for e in kept:
        for n in e:
            held.setdefault(n, {})
    kind = T.MapType(T.StringType(), T.StringType())
    n = T.StructType([T.StructField("id", T.LongType()), T.StructField("data", kind)])
    e = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", kind)])
    spark = _spark()
    return Graph(spark.createDataFrame(sorted(held.items()), n), spark.createDataFrame([(s, d, a) for (s, d), a in sorted(kept.items())], e), directed)


def as_attributes(key: str) -> Callable[[object], Attributes]:
    """Payloads as attributes: maps as they are, anything else under ``key``."""
    return lambda x: {} if x is None else {str(k): str(v) for k, v in x.items()} if isinstance(x, dict) else {key: str(x)}


def weights_from(g: Graph, attribute: str = "weight") -> Graph:
    """Attribute maps on edges replaced by one attribute as a number, relationally."""
    return g.with_edges(g.edges.select("src", "dst", F.element_at("w", attribute).try_cast("double").alias("w")))


@dataclass(frozen=True)
class GdfOptions:
    separator: str = ","
    types: bool = True


def _quoted(text: str, separator: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in (separator, '"', "\n")) else text


def serialize_gdf(
    g: Graph, node: Callable[[object], Attributes] = as_attributes("label"), edge: Callable[[object], Attributes] = as_attributes("label"),
    options: GdfOptions = GdfOptions(), max_edges: int = MAX_EDGES,
) -> str:
    """Node and edge tables; columns are all attributes that occur; undirected edges stand both ways."""
    local = Local.of(g, max_edges)
    sep, kind = options.separator, (lambda k: f"{k} VARCHAR" if options.types else k)
    nodes = [(n, node(local.data.get(n))) for n in local.nodes]
    edges = [(s, d, edge(w)) for s in local.nodes for d, w in local.out[s].items()]
    nk, ek = sorted({k for _, a in nodes for k in a}), sorted({k for *_, a in edges for k in a})
    lines = ["nodedef>" + sep.join(map(kind, ["name", *nk]))]
    lines += [sep.join([str(n), *(_quoted(a.get(k, ""), sep) for k in nk)]) for n, a in nodes]
    head = [kind("node1"), kind("node2"), "directed BOOLEAN" if options.types else "directed"]
    lines.append("edgedef>" + sep.join([*head, *map(kind, ek)]))
    flag = "true" if g.directed else "false"
    lines += [sep.join([str(s), str(d), flag, *(_quoted(a.get(k, ""), sep) for k in ek)]) for s, d, a in edges]
    return "\n".join(lines) + "\n"


def serialize_gdf_weighted(g: Graph) -> str:
    return serialize_gdf(g, edge=as_attributes("weight"))


def parse_gdf(text: str, node: Callable[[Attributes], object] | None = None, edge: Callable[[Attributes], object] | None = None) -> Graph:
    """Rows of the wrong length are skipped; the first edge's ``directed`` gives the kind."""
    section, columns, nodes, edges, directed = None, [], [], [], None
    for row in csv.reader(io.StringIO(text)):
        if not row or not any(row):
            continue
        head = row[0].strip()
        if head.startswith(("nodedef>", "edgedef>")):
            section = head[:7]
            row[0] = head[8:]
            columns = [c.strip().split(" ")[0].lower() for c in row]
        elif section is None:
            raise ParseError("a GDF file begins with nodedef>")
        elif len(row) == len(columns):
            (nodes if section == "nodedef" else edges).append({k: v.strip() for k, v in zip(columns, row, strict=True)})
    if section is None:
        raise ParseError("a GDF file begins with nodedef>")
    if edges and "directed" in edges[0]:
        directed = edges[0]["directed"].lower() == "true"
    ids = _ids([n["name"] for n in nodes] + [e[k] for e in edges for k in ("node1", "node2")])
    strip = lambda a, *drop: {k: v for k, v in a.items() if k not in drop and v != ""}
    held = [(ids[n["name"]], strip(n, "name")) for n in nodes]
    rows = [(ids[e["node1"]], ids[e["node2"]], strip(e, "node1", "node2", "directed")) for e in edges]
    directed = directed is not False
    if node is None and edge is None:
        return _attribute_graph(held, rows, directed)
    node, edge = node or (lambda a: json.dumps(a)), edge or (lambda a: json.dumps(a))
    return _built([(n, node(a)) for n, a in held], [(s, d, edge(a)) for s, d, a in rows], directed)


def write_gdf(g: Graph, path: str, **how) -> None:
    write_text(serialize_gdf(g, **how), path)


def read_gdf(path: str, **how) -> Graph:
    return parse_gdf(read_text(path), **how)


#: The namespace of GraphML (fixed value).
GRAPHML = "http://graphml.graphdrawing.org/xmlns"


def serialize_graphml(
    g: Graph, node: Callable[[object], Attributes] = as_attributes("label"), edge: Callable[[object], Attributes] = as_attributes("weight"), max_edges: int = MAX_EDGES
) -> str:
    """Keys (all strings), nodes and edges; undirected edges stand both ways."""
    local = Local.of(g, max_edges)
    nodes = [(n, node(local.data.get(n))) for n in local.nodes]
    edges = [(s, d, edge(w)) for s in local.nodes for d, w in local.out[s].items()]
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<graphml xmlns="{GRAPHML}">']
    for kind, keys in (("node", {k for _, a in nodes for k in a}), ("edge", {k for *_, a in edges for k in a})):
        out += [f'  <key id={quoteattr(f"{kind}_{k}")} for="{kind}" attr.name={quoteattr(k)} attr.type="string"/>' for k in sorted(keys)]
    out.append(f'  <graph id="G" edgedefault="{"directed" if g.directed else "undirected"}">')

    def data(kind: str, a: Attributes) -> str:
        return "".join(f"<data key={quoteattr(f'{kind}_{k}')}>{escape(v)}</data>" for k, v in sorted(a.items()))

    out += [f'    <node id="{n}">{data("node", a)}</node>' for n, a in nodes]
    out += [f'    <edge source="{s}" target="{d}">{data("edge", a)}</edge>' for s, d, a in edges]
    return "\n".join([*out, "  </graph>", "</graphml>"]) + "\n"


def parse_graphml(text: str, node: Callable[[Attributes], object] | None = None, edge: Callable[[Attributes], object] | None = None) -> Graph:
    """Integer ids; a missing edgedefault is undirected. Raises :class:`ParseError`."""
    try:
        root = ElementTree.fromstring(text.encode("utf-8"))
    except ElementTree.ParseError as e:
        raise ParseError(str(e)) from None
    ns = f"{{{GRAPHML}}}"
    graph = root.find(f"{ns}graph")
    if root.tag != f"{ns}graphml" or graph is None:
        raise ParseError("no graph in the GraphML namespace")
    names = {k.get("id"): k.get("attr.name") or k.get("id") for k in root.findall(f"{ns}key")}
    attributes = lambda e: {names.get(d.get("key"), d.get("key")): d.text or "" for d in e.findall(f"{ns}data")}
    try:
        nodes = [(int(e.get("id")), attributes(e)) for e in graph.findall(f"{ns}node")]
        edges = [(int(e.get("source")), int(e.get("target")), attributes(e)) for e in graph.findall(f"{ns}edge")]
    except (TypeError, ValueError):
        raise ParseError("a node id is missing or no number") from None
    directed = graph.get("edgedefault") == "directed"
    if node is None and edge is None:
        return _attribute_graph(nodes, edges, directed)
    node, edge = node or (lambda a: json.dumps(a)), edge or (lambda a: json.dumps(a))
    return _built([(n, node(a)) for n, a in nodes], [(s, d, edge(a)) for s, d, a in edges], directed)


def try_parse_graphml(text: str, **how) -> tuple[Graph | None, str | None]:
    try:
        return parse_graphml(text, **how), None
    except ParseError as e:
        return None, str(e)


def write_graphml(g: Graph, path: str, **how) -> None:
    write_text(serialize_graphml(g, **how), path)


def read_graphml(path: str, **how) -> Graph:
    return parse_graphml(read_text(path), **how)


def try_read_graphml(path: str, **how) -> tuple[Graph | None, str | None]:
    try:
        return read_graphml(path, **how), None
    except Exception as e:  # noqa: BLE001  whatever the store or parser says is the answer
        return None, str(e).splitlines()[0]


def scan_graphml_nodes(path: str):
    """(id, data) of a large GraphML file, by Spark's own XML reader in parallel."""
    schema = "_id LONG, data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    rows = _spark().read.format("xml").option("rowTag", "node").schema(schema).load(path)
    return rows.select(F.col("_id").alias("id"), F.map_from_entries(F.coalesce("data", F.array())).alias("data"))


def scan_graphml_edges(path: str):
    """(src, dst, w) of a large GraphML file, by Spark's own XML reader in parallel."""
    schema = "_source LONG, _target LONG, data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    rows = _spark().read.format("xml").option("rowTag", "edge").schema(schema).load(path)
    return rows.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.map_from_entries(F.coalesce("data", F.array())).alias("w"))


def checksum(text: str) -> int:
    return zlib.crc32(text.encode())
