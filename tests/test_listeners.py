import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rulegrain.plans import api, sinks
from rulegrain.queries import REGISTRY
from rulegrain.sources.engines import RegexEngine, RegexRule, Registry
from rulegrain.streaming.listeners import Recorder

FILES = "file string, ext string, content string"


@pytest.fixture()
def files(spark):
    return spark.createDataFrame([(f"/w/{k}.txt", "txt", "TODO one\nTODO two" if k % 2 else "") for k in range(40)], FILES).repartition(8)


def test_listeners_begin_before_selection_and_stop_before_writers(spark, files, tmp_path, monkeypatch):
    order = []

    class Ear(Recorder):
        def listen(self):
            order.append("listen")
            super().listen()

        def handle(self, event):
            order.append((event.phase, event.percent))
            super().handle(event)

        def stop(self):
            order.append("stop")
            super().stop()

    write = sinks.write_results
    monkeypatch.setattr(sinks, "write_results", lambda v, p: (order.append("write"), write(v, p))[1])
    ear = Ear()
    api.run(spark, rule_selector="all", files=files, registry=REGISTRY, output_file=str(tmp_path / "r.json"), listeners=[ear], tick=-1)
    assert order == ["listen", ("selection", 0), ("selection", 100), ("execution", 0), ("execution", 100), "stop", "write"]
    assert ear.heard[1].counts == {"rules": 11} and ear.heard[3].counts == {"files": 40, "violations": 40}
    assert ear.heard[3].engines == ("idle", "prose", "secrets", "web")


def test_progress_is_told_while_the_jobs_run(spark, files):
    class Slow(RegexEngine):
        def run(self, rules, files):
            def late(batches):
                import time

                for b in batches:
                    time.sleep(0.4)
                    yield b

            return super().run(rules, files.mapInPandas(late, FILES))

    ear = Recorder()
    got = api.run(spark, rule_selector="all", files=files, registry=Registry([Slow([RegexRule("r", "TODO")], "slow")]), listeners=[ear], tick=100)
    told = [e.percent for e in ear.heard if e.phase == "execution"]
    assert told[0] == 0 and told[-1] == 100 and len(told) > 3 and told == sorted(told) and max(told[:-1]) <= 99
    assert ear.heard[-1].counts == {"violations": 40} and got.violations.count() == 40
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_listeners_stop_where_the_run_fails(spark, files):
    ear = Recorder()
    bad = files.withColumn("content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        api.run(spark, rule_selector="all", files=bad, registry=REGISTRY, listeners=[ear])
    assert not ear.listening and ear.heard[-1].percent < 100


def test_the_entry_works_without_libraries_that_only_the_pipeline_needs():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'violations_regex' in q, 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1:] == ["True", "False"]
