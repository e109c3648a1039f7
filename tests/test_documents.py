import json
import os

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import results
from rulegrain.plans import documents, sinks
from rulegrain.schema import RULES, VIOLATIONS


@pytest.fixture(scope="module")
def violations(spark):
    rules = spark.createDataFrame([(e, k, f"{e}{n}", n, 1 + (n + k) % 5, ["t"], "d", ["u"]) for k, e in enumerate(("one", "two")) for n in range(3)], RULES)
    rows = []
    for k in range(400):
        e = ("one", "two")[k % 2]
        at = [(f"/w/{(k * 7) % 11}.ts", k % 13 or None, k % 5 or None, None, None, 'say "hi" <b>' if k % 3 else None)] if k % 17 else []
        rows.append((k, e, f"{e}{k % 3}", f"<m> & 'é' {k}", at + [("/w/x", 1, 2, 3, 4, None)] * (k % 2), 0, []))
    return results.enriched(spark.createDataFrame(rows, VIOLATIONS).repartition(6), rules)


def order(violations, engine=None):
    rows = results.ordered(violations).collect()
    return [r.violation_ord for r in rows if engine in (None, r.engine)]


def test_json_is_whole_and_in_order(violations, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("old")
    sinks.write_results(violations, str(path))
    made = json.loads(path.read_text())["violations"]
    assert [r["violation_ord"] for r in made] == order(violations) and set(made[0]) == set(violations.columns)
    assert os.listdir(tmp_path) == ["r.json"]


def test_sarif_has_a_run_for_each_engine_in_order(violations, tmp_path):
    path = tmp_path / "r.sarif"
    sinks.write_results(violations, str(path))
    runs = json.loads(path.read_text())["runs"]
    assert [r["tool"]["driver"]["name"] for r in runs] == ["one", "two"]
    for r in runs:
        engine = r["tool"]["driver"]["name"]
        assert [x["id"] for x in r["tool"]["driver"]["rules"]] == [f"{engine}{n}" for n in range(3)]
        assert [int(x["message"]["text"].split()[-1]) for x in r["results"]] == order(violations, engine)
    at = {int(x["message"]["text"].split()[-1]): x for r in runs for x in r["results"]}
    assert at[1]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "/w/7.ts"}, "region": {"startLine": 1, "startColumn": 1}}
    assert at[1]["locations"][0]["message"] == {"text": 'say "hi" <b>'} and len(at[1]["relatedLocations"]) == 1 and at[0]["locations"] == []
    assert at[13]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "/w/3.ts"}}


def test_html_escapes(violations, tmp_path):
    path = tmp_path / "r.html"
    sinks.write_results(violations, str(path))
    text = path.read_text()
    assert text.count("<tr>") == 401 and "&lt;m&gt; &amp; &#x27;é&#x27; 7" in text and "<m>" not in text and text.endswith(documents.HTML_TAIL)


@pytest.mark.parametrize("name", ["r.json", "r.sarif.json", "r.html"])
def test_no_violations_make_a_document_too(violations, tmp_path, name):
    sinks.write_results(violations.limit(0), str(tmp_path / name))
    text = (tmp_path / name).read_text()
    assert json.loads(text).get("violations", []) == [] if name.endswith("json") else text.count("<tr>") == 1


def test_a_failed_write_leaves_the_old_file(spark, violations, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("old")
    bad = violations.withColumn("message", F.when(F.col("violation_ord") == 300, F.raise_error(F.lit("broken"))).otherwise(F.col("message")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_results(bad, str(path))
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["r.json"]


def test_parts_of_failed_attempts_are_not_joined(tmp_path):
    (tmp_path / "parts").mkdir()
    for name, text in (("0-1-0", "a,\nb"), ("0-0-0", "never"), ("1-2-0", "c")):
        (tmp_path / "parts" / name).write_text(text)
    w = documents.DocumentWriter({"path": str(tmp_path / "d.json"), "kind": "json", "parts": str(tmp_path / "parts")})
    part = lambda k, f: documents.Part(k, {"": str(tmp_path / "parts" / f)}, {"": []})
    w.commit([part(1, "1-2-0"), None, documents.Part(2), part(0, "0-1-0")])
    assert (tmp_path / "d.json").read_text() == '{"violations": [\na,\nb,\nc\n]}\n' and os.listdir(tmp_path) == ["d.json"]
