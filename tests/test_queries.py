import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare

ROOT = Path(__file__).resolve().parents[1]

NAMES = [
    "degrees_trade", "pagerank_trade", "all_pairs_trade", "quotient_trade", "line_graph_trade", "multigraph_first", "weak_components_orders", "lca_geo", "spanning_forest_trade",
    "bipartite_sold", "triangles_flow", "labeled_nations", "live_log_events", "scan_edge_list_lines", "strong_product_trade", "mobius_ladder_graph", "io_gdf",
    "path_rows_rings", "betweenness_flow", "matching_cover_bought", "max_flow_orders", "maximal_cliques_orders", "random_degrees_rings",
    "bridges_rings", "articulation_points_rings", "k_core_rings", "model_membership", "model_try_add_combined", "random_blocks_between", "toroidal_queen",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name, sf):
    compare(spark, name, sf)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_subpackage(tmp_path):
    """The rest imports and registers its queries where the corpus folders are gone."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pagerank_trade' in n and 'pipeline' not in n and not any(k.startswith('op') and k[2].isdigit() for k in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
