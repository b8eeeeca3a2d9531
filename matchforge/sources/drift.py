"""Drift of JSON payloads: what objects lack or have too many, wrong containers, unknown event types, and the paths that payloads really hold.

Payloads are read as VARIANT, so nothing about them has to be known to find out what is in them. Findings are rows; no payload fails a job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shape(v) -> Column:
    """The type of a variant as text; containers name what they hold."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is(v, kind: str) -> Column:
    return _shape(v).startswith(kind)


def _fields(v) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _no_names() -> Column:
    return F.array().cast("array<string>")


def walk(rows: DataFrame, paths: Mapping[str, list[str]]) -> DataFrame:
    """Follow named paths ('*' takes every item of a list) from `_v`, all at once: `_name`, and `_v` and `_path` of what is reached, or `_kind` and `_names` where it ends.

    A missing key is told at its parent; items of a list have their place in the path. A value is taken apart once a step, in a column
    of its own: its fields and items, which also tell objects and lists from other values.
    """
    keep = [c for c in rows.columns if c != "_v"]
    if not paths:
        return rows.where("false").withColumns({"_name": F.lit(""), "_path": F.lit("$"), "_kind": F.lit(None).cast("string"), "_names": _no_names()})
    every = F.array(*[F.struct(F.lit(n).alias("name"), _texts(p).alias("path")) for n, p in paths.items()])
    rows = rows.select(*keep, "_v", F.inline(every).alias("_name", "_tokens")).withColumns({"_path": F.lit("$"), "_kind": F.lit(None).cast("string"), "_names": _no_names()})
    none = F.lit(None).cast("string")
    node = lambda v, p, kind, names: F.struct(v.alias("v"), p.alias("p"), kind.alias("k"), names.alias("n"))
    stay = lambda kind, names: F.array(node(F.col("_v"), F.col("_path"), kind, names))
    for i in range(max(map(len, paths.values()))):
        token = F.get("_tokens", F.lit(i))
        goes, star = F.col("_kind").isNull() & F.col("_token").isNotNull(), F.col("_token") == "*"
        rows = rows.withColumn("_token", token).withColumns({"_items": F.when(goes & star, _items(F.col("_v"))), "_fields": F.when(goes & ~star, _fields(F.col("_v")))})
        child = F.array(node(F.try_element_at("_fields", F.col("_token")), F.concat("_path", F.lit("."), "_token"), none, _no_names()))
        each = F.transform("_items", lambda x, i: node(x, F.concat(F.col("_path"), F.lit("["), i.cast("string"), F.lit("]")), none, _no_names()))
        in_list = F.when(F.col("_items").isNull(), stay(F.lit("expected_list"), _no_names())).otherwise(each)
        in_object = F.when(F.col("_fields").isNull(), stay(F.lit("expected_object"), _no_names())).when(~F.map_contains_key("_fields", F.col("_token")), stay(F.lit("missing_path"), F.array("_token"))).otherwise(child)
        steps = F.when(~goes, stay(F.col("_kind"), F.col("_names"))).when(star, in_list).otherwise(in_object)
        rows = rows.select(*keep, "_name", "_tokens", F.inline(steps).alias("_v", "_path", "_kind", "_names"))
    return rows.drop("_tokens")


def _texts(names) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else _no_names()


def _pick(choices: Mapping[str, Column], key: Column) -> Column:
    """The list of the name that `key` holds; null for other names."""
    out = F.lit(None).cast("array<string>")
    for name, value in reversed(choices.items()):
        out = F.when(key == name, value).otherwise(out)
    return out


def drift(raw: DataFrame, checks: Mapping[str, dict] | None = None, events: Mapping[str, dict] | None = None, path: list[str] | None = None, payload: str = "payload", key: str = "matchid") -> DataFrame:
    """The rows of object_drift for `checks` and those of event_drift for `events` at `path` together: payloads are read and parsed once."""
    checks, jobs = checks or {}, (checks is not None) + (events is not None)
    paths = {f"o:{n}": c["path"] for n, c in checks.items()} | ({"e": [*path, "*"]} if events is not None else {})
    # a payload that is no JSON is told once for each of the two jobs
    parsed = raw.select(key, F.try_parse_json(payload).alias("_v"))
    rows = walk(parsed.withColumn("_bad", F.col("_v").isNull()), {"p": []} | paths)
    bad, job, ended = F.col("_bad"), F.col("_name"), F.col("_kind").isNotNull()
    rows = rows.where(bad == (job == "p"))
    finding = lambda name, kind, names: F.struct(name.alias("object"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), names.alias("names"))

    own = F.substring(job, 3, 1 << 30)
    object_, required, known, quiet = own, {}, {}, []
    for n, c in checks.items():
        required[f"o:{n}"], known[f"o:{n}"] = _texts(c.get("required", [])), _texts([*c.get("required", []), *c.get("optional", [])])
        quiet += [f"o:{n}"] if c.get("may_lack") else []
    want, may = _pick(required, job), _pick(known, job)
    rows = rows.withColumn("_fields", F.when(~bad & ~ended, _fields(F.col("_v"))))
    if events is not None:
        of = F.try_element_at("_fields", F.lit("type"))
        rows = rows.withColumn("_type", F.when((job == "e") & _is(of, "STRING"), F.try_variant_get(of, "$", "string")))
        here, listed = job == "e", F.coalesce(F.col("_type").isin(*events), F.lit(False))
        want = F.when(here, _pick({t: _texts(e.get("required", [])) for t, e in events.items()}, F.col("_type"))).otherwise(want)
        may = F.when(here, _pick({t: _texts([*e.get("required", []), *e.get("optional", [])]) for t, e in events.items()}, F.col("_type"))).otherwise(may)
        object_ = F.when(here, F.concat(F.lit("event:"), "_type")).otherwise(own)
    held = F.map_keys("_fields")
    keys = F.array(finding(object_, "missing_keys", F.sort_array(F.array_except(want, held))), finding(object_, "unexpected_keys", F.sort_array(F.array_except(held, may))))
    found = F.when(F.col("_fields").isNull(), F.array(finding(object_, "expected_object", _no_names()))).otherwise(F.filter(keys, lambda f: F.size(f["names"]) > 0))
    if events is not None:
        found = F.when(here & ~listed, F.array(finding(F.lit("event"), "unknown_event_type", F.array_compact(F.array("_type"))))).otherwise(found)
        own = F.when(here, F.lit("events")).otherwise(own)
    stopped = F.when(job.isin(*quiet), F.slice(F.array(finding(own, F.col("_kind"), F.col("_names"))), 1, 0)).otherwise(F.array(finding(own, F.col("_kind"), F.col("_names"))))
    none = finding(F.lit("payload"), "not_json", _no_names())
    found = F.when(bad, F.array(*[none] * jobs)).when(ended, stopped).otherwise(found)
    rows = rows.select(key, "_v", F.col("_path").alias("path"), F.inline(found))
    return rows.select(key, "object", "path", "kind", "names", F.when(F.col("kind") != "not_json", _shape(F.col("_v"))).alias("shape"))


def object_drift(raw: DataFrame, checks: Mapping[str, dict], payload: str = "payload", key: str = "matchid") -> DataFrame:
    """Findings about objects at paths: key, object, path, kind, names, shape.

    `checks`: object -> path (list of keys and '*'), required, optional (names of keys), and may_lack (no finding where the path ends).
    Kinds: missing_keys, unexpected_keys, expected_list, expected_object, missing_path, not_json (also for null payloads).
    """
    return drift(raw, checks, payload=payload, key=key)


def event_drift(raw: DataFrame, events: Mapping[str, dict], path: list[str], payload: str = "payload", key: str = "matchid") -> DataFrame:
    """Findings about lists of typed events at a path, such as info.frames.*.events: as object_drift, and unknown_event_type.

    `events`: type -> required, optional. An event without a text type, or of a type that is not listed, is unknown; its type is in `names`.
    """
    return drift(raw, None, events, path, payload, key)


def observed_paths(raw: DataFrame, payload: str = "payload", depth: int = 12) -> DataFrame:
    """path, type, n: every path that payloads hold down to `depth`, with the types of what is there and how often; items of lists share '[*]'.

    Types are OBJECT, ARRAY or the name of a plain type. Payloads that are no JSON have the path '$' and the type INVALID.
    """
    plain = lambda v: F.when(_is(v, "OBJECT"), "OBJECT").when(_is(v, "ARRAY"), "ARRAY").otherwise(F.regexp_extract(_shape(v), "^[A-Z]+", 0))
    rows = raw.select(F.lit("$").alias("path"), F.try_parse_json(payload).alias("v"))
    rows = rows.withColumn("type", F.when(F.col("v").isNull(), "INVALID").otherwise(plain(F.col("v"))))
    node = lambda p, v, t: F.struct(p.alias("path"), v.alias("v"), t.alias("type"))
    gone = F.lit(None).cast("variant")
    for _ in range(depth):
        own = F.array(node(F.col("path"), gone, F.col("type")))
        fields = F.transform(F.map_entries(_fields(F.col("v"))), lambda e: node(F.concat(F.col("path"), F.lit("."), e["key"]), e["value"], plain(e["value"])))
        items = F.transform(_items(F.col("v")), lambda x: node(F.concat(F.col("path"), F.lit("[*]")), x, plain(x)))
        open_ = F.col("v").isNotNull()
        steps = F.when(open_ & (F.col("type") == "OBJECT"), F.concat(own, fields)).when(open_ & (F.col("type") == "ARRAY"), F.concat(own, items)).otherwise(own)
        rows = rows.select(F.explode(steps).alias("_s")).select("_s.*")
    return rows.groupBy("path", "type").agg(F.count("*").alias("n"))


def observed_schema(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: the schema that all payloads fit, as Spark merges it."""
    return raw.agg(F.schema_of_variant_agg(F.try_parse_json(payload)).alias("schema"))


def path_drift(observed: DataFrame, known: DataFrame) -> DataFrame:
    """path, type, kind (new or gone): what two tables of observed_paths do not have in common."""
    new = observed.join(known, ["path", "type"], "left_anti").select("path", "type", F.lit("new").alias("kind"))
    return new.unionByName(known.join(observed, ["path", "type"], "left_anti").select("path", "type", F.lit("gone").alias("kind")))
