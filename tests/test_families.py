"""Parents of children by plugin, against all pairs."""

import random

from vigilrow.operators import families


def brute(children, plugins):
    """Per child the parent of the first plugin, those that hold its path before others."""
    best = {}
    for child, plugin, path in children:
        for name, folder, parent, place in plugins:
            if name != plugin:
                continue
            inside = path is not None and folder is not None and (path == folder or path.startswith(folder.rstrip("/") + "/"))
            key = (not inside, place, parent)
            best[child] = min(best.get(child, key), key)
    return {c: k[2] for c, k in best.items()}


def found(spark, children, plugins):
    c = spark.createDataFrame(children, "child long, plugin string, path string")
    p = spark.createDataFrame(plugins, "name string, path string, parent long, place long")
    rows = families.parents(c, p).collect()
    assert len(rows) == len({r.child for r in rows})
    return {r.child: r.parent for r in rows}


def test_parents(spark):
    rng = random.Random(5)
    paths = ["/", "//", "", "/a", "/a/", "/a//", "/a//b", "/a/b", "/ab", "/a/b/c", "a", "a/b", "/é/x", "/é", None]
    children = [(i // 2, rng.choice(["p", "q", "none"]), rng.choice(paths)) for i in range(200)]
    plugins = [(rng.choice(["p", "q", "r"]), rng.choice(paths), 1000 + i, i) for i in range(12)]
    assert found(spark, children, plugins) == brute(children, plugins)


def test_a_plugin_without_a_path_holds_nothing(spark):
    """It came before one that holds the path, as null sorts first."""
    assert found(spark, [(1, "p", "/a/b")], [("p", None, 7, 0), ("p", "/a", 8, 1)]) == {1: 8}


def test_many_of_one_name(spark):
    """All pairs of these would be 9 * 10^8 rows."""
    c = spark.range(30_000).selectExpr("id as child", "'p' as plugin", "concat('/root/p/x', id) as path")
    p = spark.range(30_000).selectExpr("'p' as name", "if(id < 20000, '/other', '/root/p') as path", "id as parent", "id as place")
    assert families.parents(c, p).groupBy("parent").count().collect() == [(20_000, 30_000)]
