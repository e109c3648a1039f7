import os

import pytest
from pyspark.sql import functions as F

from rulegrain.sources import workspace as ws
from rulegrain.sources.folders import Wanted, WorkspaceReader


@pytest.fixture()
def tree(tmp_path):
    for p in ("a[1].ts", "a1.ts", "{x}.ts", "sp ace+plus%20.ts", ".hidden", "_under", ".dot/in.ts", "src/deep/er/x.ts", "src/y.TXT", "src[2]/z", "src2/z", "empty/.keep"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"of {p}\r\n")
    (tmp_path / "bad").write_bytes(b"\xff\xfe ok")
    return tmp_path


def read(df):
    return {r.file: (r.ext, r.content) for r in df.collect()}


def test_all_files_literally(spark, tree):
    got = read(ws.scan(spark, [str(tree)]))
    want = {os.path.join(d, f) for d, _, fs in os.walk(tree) for f in fs}
    assert set(got) == want
    assert got[f"{tree}/src/y.TXT"] == ("txt", "of src/y.TXT\r\n") and got[f"{tree}/bad"][1] == "�� ok"
    for name in ("a[1].ts", "{x}.ts", "sp ace+plus%20.ts", "src[2]"):
        assert {os.path.relpath(f, tree).split("/")[0] for f in read(ws.scan(spark, [str(tree / name)]))} == {name}
    with pytest.raises(Exception, match="nowhere"):
        ws.scan(spark, [str(tree / "nowhere")]).collect()


def test_overlapping_paths_count_once(spark, tree):
    assert len(ws.scan(spark, [str(tree / "src"), str(tree / "src/deep"), str(tree / "src/y.TXT")]).collect()) == 2


def test_targets_are_pushed_down(spark, tree):
    df = ws.scan(spark, [str(tree)], [str(tree / "src"), str(tree / "a[1].ts"), str(tree / "src/deep")])
    assert set(read(df)) == {f"{tree}/src/deep/er/x.ts", f"{tree}/src/y.TXT", f"{tree}/a[1].ts"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    # nothing is left for Spark to filter: the reader took all of it
    assert plan.count("BatchScan") == 2 and "Filter" not in plan.replace("RuntimeFilters", "")
    names = ws.scan(spark, [str(tree)], names=True)
    assert names.where("content is not null").count() == 0 and names.where(F.col("file").isin(f"{tree}/a1.ts", f"{tree}/src2/z", "x")).count() == 2


def test_folders_that_hold_no_target_are_not_opened(tree):
    (tree / "locked").mkdir()
    reader = WorkspaceReader({"paths": f'["{tree}"]', "tasks": "1"})
    reader.wanted = Wanted((), (f"{tree}/src/",))
    (part,) = reader.partitions()
    assert part.folders == (str(tree),)
    opened, scandir = [], os.scandir
    os.scandir = lambda p: (opened.append(p), scandir(p))[1]
    try:
        assert sum(b.num_rows for b in reader.read(part)) == 2
    finally:
        os.scandir = scandir
    assert [os.path.relpath(p, tree) for p in opened] == [".", "src", "src/deep", "src/deep/er"]


def test_the_driver_lists_only_as_far_as_it_needs(tree):
    many = WorkspaceReader({"paths": f'["{tree}"]', "tasks": "100"}).partitions()
    few = WorkspaceReader({"paths": f'["{tree}"]', "tasks": "3"}).partitions()
    assert sum(len(p.files) for p in many) == 13 and not any(p.folders for p in many)
    assert {os.path.relpath(f, tree) for p in few for f in p.folders} == {".dot", "empty", "src", "src2", "src[2]"}
