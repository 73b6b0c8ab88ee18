import random

import pytest
from pyspark.sql import functions as F

from tagatlas.plans.map_build import LOOK
from tagatlas.sources.files import current
from tagatlas.streaming import map_folder
from tagatlas.streaming.map_folder import CHANGES, MapFolder, follow

NODES, WAYS = "node_id long, lon double, lat double, tags map<string,string>", "way_id long, nodes array<long>, tags map<string,string>"
RELATIONS = f"relation_id long, members {map_folder.MEMBERS}, tags map<string,string>"


def town(rnd, n=60):
    nodes = {k: (-123.1 + rnd.randrange(200) * 0.001, 49.2 + rnd.randrange(200) * 0.001) for k in range(n)}
    ways = {k: ([rnd.randrange(n) for _ in range(rnd.randint(2, 4))], rnd.choice([{"highway": "cycleway"}, {"highway": "cycleway", "oneway": "yes"}, {"highway": "path", "bicycle": "designated"}, {"highway": "motorway"}])) for k in range(n)}
    relations = {k: ([("way", rnd.randrange(n), "") for _ in range(3)] + [("node", 1, "")], {"type": "route", "route": rnd.choice(["bicycle", "hiking"])}) for k in range(6)}
    return nodes, ways, relations


def frames(spark, state):
    nodes, ways, relations = state
    return (
        spark.createDataFrame([(k, *p, None) for k, p in nodes.items()], NODES), spark.createDataFrame([(k, *w) for k, w in ways.items()], WAYS),
        spark.createDataFrame([(k, *r) for k, r in relations.items()], RELATIONS),
    )


def changed(rnd, state, seq):
    """Random changes, applied to the state as well."""
    nodes, ways, relations, out = *state, []
    for k in rnd.sample(sorted(nodes), 3):
        nodes[k] = (-123.1 + rnd.randrange(200) * 0.001, 49.2 + rnd.randrange(200) * 0.001)
        out.append(("node", "modify", seq, k, *nodes[k], None, None, None))
    for k in rnd.sample(sorted(ways), 3):
        out.append(("way", "delete", seq, k, None, None, None, None, None))
        del ways[k]
    new = max(ways) + 1
    ways[new] = ([rnd.choice(sorted(nodes)) for _ in range(3)], {"highway": "cycleway"})
    out.append(("way", "modify", seq, new, None, None, [0, 1], None, {"highway": "motorway"}))  # an older change of the same way
    out.append(("way", "create", seq + 1, new, None, None, *[ways[new][0], None, ways[new][1]]))
    k = rnd.choice(sorted(relations))
    relations[k] = ([("way", rnd.choice(sorted(ways)), "") for _ in range(2)], {"type": "route", "route": "bicycle"})
    out.append(("relation", "modify", seq, k, None, None, None, *relations[k]))
    out.append(("way", "delete", seq, 10**6, None, None, None, None, None))
    out.append(("node", "delete", seq, None, None, None, None, None, None))
    return out


def rows(df):
    return sorted(map(str, df.select("z", "x", "y", *LOOK, "n_lines", F.transform("geom", lambda p: F.struct(F.round(p.x, 6), F.round(p.y, 6))).alias("g")).collect()))


def test_updates_equal_a_full_build(spark, tmp_path):
    rnd = random.Random(4)
    state = town(rnd)
    folder = MapFolder(spark, str(tmp_path / "map"), 12)
    with pytest.raises(ValueError):
        folder.update(spark.createDataFrame([], CHANGES))
    folder.build(*frames(spark, state))
    for step in (1, 2):
        assert folder.update(spark.createDataFrame(changed(rnd, state, 10 * step), CHANGES)) == step
    full = MapFolder(spark, str(tmp_path / "full"), 12)
    full.build(*frames(spark, state))
    assert rows(folder.lines()) == rows(full.lines())
    # only tiles that were reached were written
    dirty = spark.read.parquet(f"{folder.folder}/dirty/rows/version=2")
    written = spark.read.parquet(f"{folder.folder}/lines/rows/version=2").select("z", "x", "y").distinct()
    assert written.join(dirty, ["z", "x", "y"], "left_anti").count() == 0 and 0 < dirty.count() < full._read("index", ["way_id"]).select("z", "x", "y").distinct().count()
    assert rows(folder.lines(0)) != rows(folder.lines(1)) != rows(folder.lines())
    folder.compact()
    assert rows(folder.lines()) == rows(full.lines()) and folder.version() == 0


def test_lost_and_repeated_updates(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    state = town(rnd, 20)
    folder, changes = MapFolder(spark, str(tmp_path / "map"), 7), str(tmp_path / "changes")
    folder.build(*frames(spark, state))
    before = rows(folder.lines())
    spark.createDataFrame(changed(rnd, state, 1), CHANGES).coalesce(1).write.parquet(changes)
    monkeypatch.setattr(MapFolder, "_count", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        follow(folder, changes, str(tmp_path / "checkpoint")).awaitTermination()
    monkeypatch.undo()
    assert folder.version() == 0 and rows(folder.lines()) == before  # nothing of it is seen
    for _ in range(2):  # the batch is run again, once
        follow(folder, changes, str(tmp_path / "checkpoint")).awaitTermination()
        assert folder.version() == 1 and folder.batches() == {0}
    assert folder.update(spark.read.schema(CHANGES).parquet(changes), 0) == 1
    full = MapFolder(spark, str(tmp_path / "full"), 7)
    full.build(*frames(spark, state))
    assert rows(folder.lines()) == rows(full.lines()) and current(folder.folder) == ["batch-0", "version-1"]


def test_an_update_shapes_only_what_was_reached(spark, tmp_path):
    rnd = random.Random(6)
    state = town(rnd)
    folder, full = MapFolder(spark, str(tmp_path / "map"), 9), MapFolder(spark, str(tmp_path / "full"), 9)
    folder.build(*frames(spark, state))
    folder.update(spark.createDataFrame(changed(rnd, state, 1), CHANGES))
    full.build(*frames(spark, state))
    reached = spark.read.parquet(f"{folder.folder}/reached/rows/version=1")
    shaped = spark.read.parquet(f"{folder.folder}/shapes/rows/version=1")
    assert 0 < shaped.count() < full._read("shapes", ["way_id"]).count() and shaped.join(reached, "way_id", "left_anti").count() == 0
    for table in ("shapes", "index"):
        want = full._read(table, ["way_id"])
        assert sorted(map(str, folder._read(table, ["way_id"]).select(want.columns).collect())) == sorted(map(str, want.collect()))
