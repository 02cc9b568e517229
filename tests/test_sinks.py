"""Region files written to a folder and read back: the data source, conversion and export."""

from pathlib import Path

import pytest
from test_regions import COLUMNAR, ROWS, sample

from gridlore.functions import regions as rg
from gridlore.sources import file_sink, region_files, region_source


def some_files(spark, n=3):
    return spark.createDataFrame([(f"a/r.{i}.0.region", bytearray(ROWS.encode(sample()))) for i in range(n)], "path string, content binary")


@pytest.mark.parametrize("options", [{"layout": "rows"}, {"layout": "columnar"}, {"layout": "columnar", "modelled": "true"}])
def test_data_source(spark, tmp_path, options):
    spark.dataSource.register(region_source.RegionSource)
    options = {"suffix": "region", "signature": "sig", "path": f"file://{tmp_path}", **options}
    records = region_files.read_region_files(some_files(spark), ROWS).repartition(4, "path")
    records.write.format("region").options(**options).mode("append").save()
    written = sorted(str(p.relative_to(tmp_path)) for p in Path(tmp_path).rglob("*") if p.is_file())
    assert written == [f"a/r.{i}.0.region" for i in range(3)] and not list(Path(tmp_path).glob(".*"))
    back = spark.read.format("region").options(**options).load()
    assert back.columns == ["path", *region_files.NAMES] and back.select("path").distinct().count() == 3
    for path in written:
        rows = [r.asDict() for r in back.where(back.path == path).collect()]
        assert rg.equal(region_files.from_records(rows), sample())
    cut = dict(options, newest="1")
    if options["layout"] == "rows":
        assert spark.read.format("region").options(**cut).load().where("level = 1 AND record = 'snapshot'").count() == 0
    (tmp_path / "broken.region").write_bytes(b"sigx")
    failed = spark.read.format("region").options(**options).load().where("error IS NOT NULL")
    assert [r.path for r in failed.collect()] == ["broken.region"]
    records.where("path LIKE '%r.1.%'").write.format("region").options(**options).mode("overwrite").save()
    assert [p.name for p in Path(tmp_path).rglob("*") if p.is_file()] == ["r.1.0.region"]


def test_a_path_in_two_partitions_is_refused(spark, tmp_path):
    spark.dataSource.register(region_source.RegionSource)
    records = region_files.read_region_files(some_files(spark, 1), ROWS)
    twice = records.unionByName(records)  # two partitions
    with pytest.raises(Exception, match="several partitions"):
        twice.write.format("region").options(path=f"file://{tmp_path}", suffix="region", signature="sig").mode("append").save()
    assert [p for p in Path(tmp_path).rglob("*") if p.is_file()] == []


def test_saved_files(spark, tmp_path):
    files = some_files(spark, 2).unionByName(spark.createDataFrame([("bad", bytearray(b"x")), ("none", None)], "path string, content binary"))
    done = region_files.convert(files, ROWS, COLUMNAR)
    outcomes = {r.path: r for r in file_sink.save_files(done, f"file://{tmp_path}").collect()}
    assert {p: r.outcome for p, r in outcomes.items()} == {"a/r.0.0.region": "written", "a/r.1.0.region": "written", "bad": "failed", "none": "failed"}
    assert outcomes["none"].error == "no content" and outcomes["bad"].bytes is None
    for path in ("a/r.0.0.region", "a/r.1.0.region"):
        data = (tmp_path / path).read_bytes()
        assert rg.equal(COLUMNAR.decode(data), sample()) and outcomes[path].bytes == len(data)
    assert len([p for p in Path(tmp_path).rglob("*") if p.is_file()]) == 2
    (tmp_path / "taken").write_bytes(b"")
    blocked = spark.createDataFrame([("p", "taken/x", bytearray(b"1")), ("q", None, bytearray(b"1"))], "path string, at string, content binary")
    assert {r.path: (r.outcome, r.error is None) for r in file_sink.save_files(blocked, f"file://{tmp_path}", "at").collect()} == {"p": ("failed", False), "q": ("failed", False)}
