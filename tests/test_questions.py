"""Verbs, tools, policies, providers and streams."""

import pytest
from pyspark.sql import functions as F

from geoloom.plans import providers, triage, verbs
from geoloom.plans.index import index
from geoloom.streaming import snapshots


@pytest.fixture(scope="module")
def i(spark, sf):
    return index(spark, sf)


def test_tool_statuses(i):
    call = lambda n, **a: verbs.call(i, n, a)["status"]
    assert call("count_regions", class_name="House") == "ok"
    assert call("find_regions", class_name="House", min_area_m2=1e9) == "empty"
    assert call("count_regions", class_name="greenhouse") == "unanswerable"
    assert call("count_regions", class_name="Igloo") == "unanswerable"
    assert call("count_regions") == call("count_regions", class_name=3) == call("nope") == call("count_regions", class_name="House", x=1) == call("find_regions", class_name="House", min_area_m2="5") == "error"
    assert call("corridor", class_name="PavedRoad", vehicle="boat") == "error"


def test_caps_state_what_they_leave_out(i):
    out = verbs.call(i, "find_regions", {"class_name": "House"})
    n = i.regions.where("class_id = 4").count()
    assert len(out["rows"]) + out["rows_omitted"] == n == len(out["evidence"]) + out["evidence_omitted"]
    for bad in ("", "jump House", "find House size 3", "find House slope ! 3"):
        with pytest.raises(ValueError):
            verbs.run(i, bad)


def test_regions_and_cells_agree(i):
    sizes = {r.region_id: r["count"] for r in i.cell_region.groupBy("region_id").count().collect()}
    assert sizes == {r.region_id: r.area_px for r in i.region_ids.collect()}
    assert sorted(sizes) == list(range(1, len(sizes) + 1))


def test_policies(spark):
    for p in triage.BUILTIN.values():
        assert triage.Policy.from_json(p.to_json()) == p
    p = triage.compile_query("find missing trees near paved roads and igloos")
    assert p.absence and "Maquis" in p.applies_to and p.rules == [("dist_to.PavedRoad < 100", 1.4)] and p.unmatched == ["igloos"]
    assert triage.missing_features(triage.BUILTIN["settlement"], {"entropy"}) == [r for r, _ in triage.BUILTIN["settlement"].rules]
    assert not spark.range(1).select(triage.rule_column("no rule at all", {"id"})).first()[0]


def test_selection_counts_the_whole(spark):
    rows = [(k, float(k % 7), k % 5 == 0, 0.0) for k in range(63)]
    s = triage.select(spark.createDataFrame(rows, "u long, score double, excluded boolean, ex_frac double"), ["u"])
    got = s.agg(*(F.count_if(F.expr(x)) for x in ("selected", "control", "selected and excluded", "selected and control"))).first()
    assert tuple(got) == (13, 2, 0, 0)


def test_providers_are_held_to_their_contract(i):
    with pytest.raises(KeyError):
        providers.estimate("nope", i)
    providers.register("wild", lambda i, vehicle, wet: i.cells.select("r", "c", "class_id", "valid", F.lit(2.0).alias("score")))
    with pytest.raises(Exception, match="provider wild"):
        providers.estimate("wild", i).collect()
    providers.register("nan", lambda i, vehicle, wet: i.cells.select("r", "c", "class_id", "valid", F.lit(float("nan")).alias("score")))
    assert providers.estimate("nan", i).where("score is not null").count() == 0
    assert providers.estimate("builtin", i).where("not valid and score is not null").count() == 0


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = snapshots.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == e.count()
    cells = index(spark, sf).cells
    cells.repartition(3).write.parquet(str(tmp_path / "cells"))
    q = snapshots.tile_counts(spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "cells")), 40).writeStream.outputMode("complete").format("memory").queryName("tiles").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in snapshots.tile_counts(cells, 40).collect()}
    assert {tuple(r) for r in spark.table("tiles").collect()} == want


def test_command_line(sf, capsys, tmp_path, spark):
    from geoloom import cli

    assert cli.main(["legend"]) == 0 and "MaralBadlands" in capsys.readouterr().out
    assert cli.main(["--sf-dir", sf, "--limit", "2", "run", "l0_histogram"]) == 0
    assert "rows omitted" in capsys.readouterr().out
    assert cli.main(["--sf-dir", sf, "ask", "count", "greenhouse"]) == 2
    assert cli.main(["--sf-dir", sf, "triage", "find", "igloos", "near", "water"]) == 0
    assert "not understood: igloos" in capsys.readouterr().out
    assert cli.html("a<b", {"t": "x\ty\n1\t<2>\n# NOTE: 3"}).count("&lt;") == 3
