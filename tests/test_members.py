"""Members of parsed objects, looked up in maps that are built once."""

from pyspark.sql import functions as F

from token_ledger.functions import jsonx as J

VALUES = ["5", "-7", "12.7", "1e3", "123456789012345678901", "true", "null", "[1, 2]", '{"b": 1}', *(f'"{t}"' for t in ("5", " 5 ", "+5", "-0", "12.7", "1e3", "x", "", "99999999999999999999", "5L", "0x5"))]


def test_members_are_read_as_by_path(spark):
    """Each kind of value gives what a path into the whole gives; what is no object has no members."""
    lines = [f'{{"a.x": {v}, "in": {{"a.x": {v}}}}}' for v in VALUES] + ["[1]", "3", '{"in": [1]}', '{"in": null}', "{}"]
    rows = J.parsed(spark.createDataFrame([(t,) for t in lines], "value string"))
    rows = J.members(J.members(rows.select("v", F.col("v").alias("w")), own=F.col("v")), inner=J.at("own", "in"))
    for by, path in (("own", J.path("a.x")), ("inner", J.path("in", "a.x"))):
        pairs = {
            "text": (J.first(J.text, by, "none", "a.x"), J.text("w", "$.none", path)),
            "whole": (J.first(J.integer, by, "none", "a.x"), J.integer("w", "$.none", path)),
            "number": (J.number(J.at(by, "a.x"), "$"), J.number("w", path)),
            "has": (J.has(J.at(by, "a.x"), "$"), J.has("w", path)),
            "pair": (F.try_variant_get(J.at(by, "a.x"), "$", "array<double>"), F.try_variant_get("w", path, "array<double>")),
        }
        for r in rows.select(F.to_json("w").alias("line"), *(F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items())).collect():
            for n in pairs:
                assert r[n]["a"] == r[n]["b"], (n, r["line"], by)


def test_copilot_reads_its_lines_once(spark, monkeypatch):
    """The step that reads lines casts few values inside values; before it read 158 of them for a line."""
    from token_ledger import queries as core
    from token_ledger.sources import line_agents

    class Seen(Exception):
        pass

    def stop(df, name):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(line_agents, "staged", stop)
    try:
        core.queries()["scan_copilot"](spark, "/root/testdata/sf0.001")
    except Seen as seen:
        assert 0 < seen.args[0].count("variant_get(") < 110
    else:
        raise AssertionError("not staged")
