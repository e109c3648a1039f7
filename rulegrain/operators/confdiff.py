"""What a user's configuration changes against the defaults, as rows and as YAML."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.functions import same_value


def rule_diff(user: DataFrame, default: DataFrame, include_unmodified: bool = False) -> DataFrame:
    """One row for each selected rule that differs: effective and default severity and tags.

    A rule without a default counts as unmodified. Tags are compared in order.
    """
    base = default.select("engine", "rule", F.col("severity").alias("default_severity"), F.col("tags").alias("default_tags"), F.lit(True).alias("__known"))
    out = user.select("engine", "rule", "severity", "tags").join(base, ["engine", "rule"], "left")
    out = out.withColumns({
        "severity_modified": F.col("__known").isNotNull() & (F.col("severity") != F.col("default_severity")),
        "tags_modified": F.col("__known").isNotNull() & ~same_value(F.to_json("tags"), F.to_json("default_tags")),
    }).drop("__known")
    return out if include_unmodified else out.where("severity_modified or tags_modified")


#: The rest of a JSON string, up to its closing quote; an escaped quote doesn't close it.
STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'


def shortened(value_json: Column, config_root: str | None) -> Column:
    """Paths under config_root that are string values, at any depth, relative to it; keys stay.

    Each search begins where a string ended, so it goes from string to string and
    never takes a quote inside one for its beginning.
    """
    if not config_root:
        return value_json
    root = json.dumps(config_root.rstrip("/") + "/")[1:-1]
    others = rf'[^"]*+(?:"{STRING}[^"]*+)*?'
    return F.regexp_replace(value_json, rf'\G({others})"\Q{root}\E({STRING})(?!\s*:)', '$1"$2')


def field_diff(fields: DataFrame, config_root: str | None = None) -> DataFrame:
    """One row for each described field: the value to print and why (`status`).

    derived: not supplied and not the default, so the default is printed and the
    value noted; default; modified: the value is printed and the default noted.
    Fields without a description are left out. A null value is the default.
    """
    value = F.coalesce("value_json", "default_json")
    same = same_value(value, F.col("default_json"))
    status = F.when(~F.col("supplied") & ~same, F.lit("derived")).when(same, F.lit("default")).otherwise(F.lit("modified"))
    shown = F.when(F.col("status") == "modified", shortened(F.col("__value"), config_root)).otherwise(F.col("default_json"))
    note = F.when(F.col("status") == "derived", F.col("__value")).when(F.col("status") == "modified", F.col("default_json"))
    out = fields.where("description is not null").withColumns({"__value": value, "status": status})
    return out.withColumns({"printed_json": shown, "note_json": note}).drop("__value")


def resolved(fields: DataFrame, validated: DataFrame, raw: DataFrame) -> DataFrame:
    """fields with their value: the validated one of an engine that could be made, else the user's raw one.

    validated, raw: engine, field, value_json.
    """
    v = validated.select("engine", "field", F.col("value_json").alias("__v"))
    r = raw.select("engine", "field", F.col("value_json").alias("__r"))
    made = validated.select("engine").distinct().withColumn("__made", F.lit(True))
    out = fields.drop("value_json", "supplied").join(v, ["engine", "field"], "left").join(r, ["engine", "field"], "left").join(made, "engine", "left")
    out = out.withColumns({"value_json": F.when(F.col("__made"), F.col("__v")).otherwise(F.col("__r")), "supplied": F.col("__r").isNotNull()})
    return out.drop("__v", "__r", "__made")


def yaml_text(top: list[dict], rules: list[dict], engines: list[str], fields: list[dict]) -> str:
    """The configuration as YAML. Values are JSON, which is YAML. Bounded by the size of a configuration.

    top: field rows of the configuration itself; rules: rows of rule_diff();
    engines: in order; fields: rows of field_diff().
    """

    def entry(f: dict, pad: str) -> list[str]:
        note = {"modified": f"  # Modified from: {f['note_json']}", "derived": f"  # Last calculated as: {f['note_json']}"}.get(f["status"], "")
        return [*(f"{pad}# {line}".rstrip() for line in f["description"].split("\n")), f"{pad}{f['field']}: {f['printed_json']}{note}"]

    out = ["# Configuration"]
    for f in top:
        out += ["", *entry(f, "")]
    out += ["", "# Changes of rules", "rules:" if engines else "rules: {}  # No rules are selected"]
    for e in engines:
        mine = [r for r in rules if r["engine"] == e]
        out += ["", f"  # {e.upper()}: changes of rules"]
        out.append(f"  {e}:" if mine else f"  {e}: {{}}  # Remove this empty object to change rules of this engine")
        for r in mine:
            out.append(f"    {json.dumps(r['rule'])}:")
            for key in ("severity", "tags"):
                changed = r[f"{key}_modified"]
                out.append(f"      {key}: {json.dumps(r[key])}" + (f"  # Modified from: {json.dumps(r[f'default_{key}'])}" if changed else ""))
    out += ["", "# Settings of engines", "engines:" if engines else "engines: {}  # No engines are selected"]
    for e in engines:
        mine = [f for f in fields if f["engine"] == e]
        out += ["", f"  # {e.upper()}: settings"]
        out.append(f"  {e}:" if mine else f"  {e}: {{}}")
        for f in mine:
            out += entry(f, "    ")
    return "\n".join([*out, "", "# End"]) + "\n"
