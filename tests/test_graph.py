from types import SimpleNamespace

import pyarrow as pa
import pytest

from cinderlake import storage
from cinderlake.operators import graph


@pytest.mark.parametrize("hot_links", [3, 100_000])
def test_giant_components_are_dealt_out(spark, monkeypatch, hot_links):
    monkeypatch.setattr(graph, "HOT_LINKS", hot_links)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(300, 301)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 131), 100), 300: 300, 301: 300}


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    hinted = lambda df, **most: "ResolvedHint" in (plan := storage.broadcast_if_small(df, **most)._jdf.queryExecution().analyzed().toString()) or "UnresolvedHint" in plan
    df = spark.createDataFrame([(1, "x" * 1000, ["a" * 500], [1.5])] * 20, "n long, s string, w array<string>, v array<double>")
    assert hinted(df) and not hinted(df, most=10) and not hinted(df, most_bytes=10_000)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError):
        storage.shared_dir(unset)


def test_links_of_tiles_give_the_components_of_all_links(spark):
    """Paths over tile borders and back, a node of many tiles, a tile of its own: as settled at once, with ties at borders only."""
    import random

    r = random.Random(4)
    edges = [(i, i + 1, i // 10) for i in range(0, 95)] + [(200, 200 + i, 50 + i) for i in range(1, 9)] + [(900, 901, 7)]
    edges += [(x, r.randrange(x + 1, 801), r.randrange(12)) for x in (r.randrange(300, 800) for _ in range(260))]
    df = spark.createDataFrame(edges, "a long, b long, tile int")
    whole = graph.settled(pa.table({"u": [a for a, *_ in edges], "v": [b for _, b, _ in edges]})).to_pylist()
    want = {x["node"]: x["component"] for x in whole}
    got = [(x["node"], x["component"]) for x in graph.tiled_components(df, ["tile"]).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert graph.tiled_components(df.limit(0), ["tile"]).count() == 0
