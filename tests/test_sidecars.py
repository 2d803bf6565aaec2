"""Sidecars of mixed types, parsed once."""

from dwitable.sources import sidecars as SC

BODIES = ['{"a": 1, "b": "x", "c": {"d": 1.5, "e\'f": "q"}}', '{"a": "one", "l": [1, 2]}', "not json", None, "[1]", '{"a": 2.5, "b": null}',
          '"text"', '{"a": true}', "", "{}", '{"a": 12345678901234567890123}']


def frame(spark):
    return spark.createDataFrame([(i, "m" if i < 6 else "n", b, "kept") for i, b in enumerate(BODIES)], "id long, make string, body string, extra string")


def test_properties_of_any_type(spark):
    found = SC.with_properties(SC.parsed(frame(spark)), {"a": "string", "b": "string", "c/d": "double", "c/e'f": "string", "a ": "long"}, {"c/d": "d", "c/e'f": "e"})
    rows = {r["id"]: r for r in found.drop(SC.DOCUMENT).collect()}
    assert {i: r["is_json"] for i, r in rows.items()} == {i: None if b is None else b not in ("not json", "") for i, b in enumerate(BODIES)}
    assert [rows[i]["a"] for i in range(8)] == ["1", "one", None, None, None, "2.5", None, "true"]
    assert (rows[0]["b"], rows[0]["d"], rows[0]["e"], rows[0]["extra"], rows[5]["b"]) == ("x", 1.5, "q", "kept", None)
    numbers = SC.with_properties(SC.parsed(frame(spark)), {"a": "long"}).collect()
    assert [r["a"] for r in sorted(numbers)[:8]] == [1, None, None, None, None, 2, None, 1]


def test_a_body_is_parsed_once(spark):
    many = SC.with_properties(SC.parsed(frame(spark)), {f"p{i}": "string" for i in range(40)})
    assert many._jdf.queryExecution().optimizedPlan().toString().count("parse_json") + \
        many._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_drift_is_data(spark):
    documents = SC.parsed(frame(spark))
    kinds = {(r["make"], r["property"], r["kind"]): r["n"] for r in SC.property_kinds(documents, "make").collect()}
    assert kinds == {("m", "a", "number"): 2, ("m", "a", "string"): 1, ("m", "b", "string"): 1, ("m", "b", "null"): 1, ("m", "c", "object"): 1,
                     ("m", "l", "array"): 1, ("n", "a", "boolean"): 1, ("n", "a", "number"): 1}
    assert {(r["make"], r["property"]): r["kinds"] for r in SC.drifted(documents, "make").collect()} == {
        ("m", "a"): ["number", "string"], ("n", "a"): ["boolean", "number"]}
    schemas = {r["make"]: (r["schema"], r["n"]) for r in SC.merged_schemas(documents.where("id in (0, 5)"), "make").collect()}
    assert schemas["m"][1] == 2 and "a: DECIMAL" in schemas["m"][0] and "b: STRING" in schemas["m"][0]
    assert SC.property_kinds(documents.where("false"), "make").count() == 0
