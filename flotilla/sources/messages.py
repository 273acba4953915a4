"""Message log as JSON lines: decode, encode, conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.states import CONTAINER_STATES, INSTANCE_STATES, TERMINATION_REASONS
from .kinds import (ADDRESS_PATTERN, KINDS, LOOSE_UUID_PATTERN, MESSAGE_FIELDS, NESTED, UUID_PATTERN,
                    Field, column_name, kinds_having, kinds_requiring, wire_schema)

_ENUMS = {
    "instance_state": INSTANCE_STATES,
    "container_state": CONTAINER_STATES,
    "termination_reason": TERMINATION_REASONS,
}
_CHECKED = {*_ENUMS, "uuid", "address", "instant", "duration"}
_DECIMALS = sorted({f.name for fields in (MESSAGE_FIELDS, *NESTED.values()) for f in fields if f.kind == "decimal"})
# A decimal that reading would round, or one with an exponent. Inside a JSON text a quote has a backslash, so no other value looks like this.
_INEXACT = rf'"({"|".join(_DECIMALS)})"\s*:\s*-?[0-9]+([.][0-9]{{18}}[0-9]*[1-9]|[.]?[0-9]*[eE])'


def _bad_value(col: Column, kind: str) -> Column | None:
    """True where a present value of this kind cannot be read, or None if any text will do."""
    if kind in _ENUMS:
        return ~col.isin(_ENUMS[kind])
    if kind == "uuid":
        return ~col.rlike(LOOSE_UUID_PATTERN)
    if kind == "address":
        return ~col.rlike(ADDRESS_PATTERN)
    if kind == "instant":
        return text.instant(col).isNull()
    if kind == "duration":
        return ~col.rlike(text.DURATION)
    if kind in NESTED:
        return _any([_field_fault(col.getField(f.name), f) for f in NESTED[kind]])
    return None


def _any(tests: list[Column | None]) -> Column | None:
    out = None
    for test in tests:
        if test is not None:
            out = test if out is None else out | test
    return out


def _field_fault(col: Column, field: Field) -> Column | None:
    bad = None
    if field.many:
        if field.kind in NESTED or field.kind in _CHECKED:
            bad = F.exists(col, lambda item: F.coalesce(_bad_value(item, field.kind), F.lit(False)))
    else:
        bad = _bad_value(col, field.kind)
    bad = None if bad is None else col.isNotNull() & bad
    return bad if field.optional else _any([col.isNull(), bad])


def _typed(col: Column, kind: str) -> Column:
    """Wire value to table value: instants to timestamps, durations to milliseconds."""
    if kind == "instant":
        return text.instant(col)
    if kind == "duration":
        return text.duration_millis(col)
    if kind in NESTED:
        inner = F.struct(*[_each(col.getField(f.name), f, _typed).alias(f.name) for f in NESTED[kind]])
        return F.when(col.isNotNull(), inner)
    return col


def _wired(col: Column, kind: str) -> Column:
    """Table value to wire value, the inverse of ``_typed``; a decimal as text without the zeros behind its fourth place."""
    if kind == "decimal":
        return F.regexp_replace(col.cast("string"), r"(\.\d{4}\d*?)0+$", "$1")
    if kind == "instant":
        return text.instant_text(col)
    if kind == "duration":
        return text.duration_text(col)
    if kind in NESTED:
        inner = F.struct(*[_each(col.getField(f.name), f, _wired).alias(f.name) for f in NESTED[kind]])
        return F.when(col.isNotNull(), inner)
    return col


def _each(col: Column, field: Field, convert) -> Column:
    return F.transform(col, lambda item: convert(item, field.kind)) if field.many else convert(col, field.kind)


def _parsed(lines: DataFrame, keep: list[str], text_col: str, schema: T.StructType) -> DataFrame:
    """``keep`` and ``__m``, the parsed text.

    The one-element explode keeps the optimizer from copying the parse into every test on its
    fields: a filter is not moved below a generator, so each text is parsed once.
    """
    parse = F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(*keep, F.explode(F.array(parse)).alias("__m"))


def _checked(lines: DataFrame, text_col: str) -> DataFrame:
    """``lines`` with ``__m``, the parsed text, and ``reject``, why it cannot be decoded."""
    parsed = _parsed(lines, lines.columns, text_col, wire_schema())
    kind = F.col("__m").getField("$type")
    reason = (
        F.when(F.col("__m").isNull() | (F.col("__m._corrupt_record").isNotNull() & kind.isNull()), "malformed JSON")
        .when(kind.isNull(), "no $type")
        .when(~kind.isin(list(KINDS)), F.concat(F.lit("unknown $type "), kind))
        .when(F.col("__m._corrupt_record").isNotNull(), "malformed JSON")
    )
    for field in MESSAGE_FIELDS:
        value = F.col("__m").getField(field.name)
        reason = reason.when(kind.isin(kinds_requiring(field.name)) & value.isNull(), f"missing {field.name}")
    for field in MESSAGE_FIELDS:
        value = F.col("__m").getField(field.name)
        fault = _field_fault(value, Field(field.name, field.kind, field.many, True))
        if fault is not None:
            reason = reason.when(kind.isin(kinds_having(field.name)) & fault, f"invalid {field.name}")
    reason = reason.when(F.col(text_col).rlike(_INEXACT), "inexact decimal")
    return parsed.withColumn("reject", reason)


def _columns(message: str) -> list[Column]:
    """``kind`` and one typed column per message field, from a struct column of parsed fields."""
    kind = F.col(message).getField("$type")
    return [kind.alias("kind")] + [
        F.when(kind.isin(kinds_having(f.name)), _each(F.col(message).getField(f.name), f, _typed)).alias(column_name(f.name))
        for f in MESSAGE_FIELDS
    ]


def message_parse(lines: DataFrame, text_col: str) -> DataFrame:
    """Every line with ``kind``, one column per message field and ``reject``, from one parse of each text.

    Fields a kind lacks are null; so are all fields of a line that cannot be decoded, and ``reject``
    says why. To keep messages and rejects both, write this and read it back.
    """
    checked = _checked(lines, text_col)
    good = checked.select(*lines.columns, "reject", F.when(F.col("reject").isNull(), F.col("__m")).alias("__good"))
    return good.select(*lines.columns, *_columns("__good"), "reject")


def message_decode(lines: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines to ``(messages, rejects)``.

    Messages have the other columns of ``lines``, ``kind`` and one column per message field, null
    where the kind lacks it; rejects keep the text and get the ``reason``. A line that cannot be
    decoded never stops the others.
    """
    checked = _checked(lines, text_col)
    others = [c for c in lines.columns if c != text_col]
    messages = checked.where(F.col("reject").isNull()).select(*others, *_columns("__m"))
    rejects = checked.where(F.col("reject").isNotNull()).select(*lines.columns, F.col("reject").alias("reason"))
    return messages, rejects


def message_encode(messages: DataFrame) -> DataFrame:
    """Decoded messages to ``event_id, line``: compact JSON led by ``$type``, absent fields left out."""
    have = {column_name(f.name): f for f in MESSAGE_FIELDS if column_name(f.name) in messages.columns}
    wire = F.struct(
        F.col("kind").alias("$type"),
        *[_each(F.col(name), field, _wired).alias(field.name) for name, field in have.items()])
    # decimals are written as numbers; inside a JSON text a quote has a backslash, so no other value looks like this
    line = F.regexp_replace(F.to_json(wire), rf'"({"|".join(_DECIMALS)})":"(-?[0-9.]+)"', '"$1":$2')
    return messages.select("event_id", line.alias("line"))


def write_lines(encoded: DataFrame, path: str) -> None:
    """Land encoded messages as one JSON text per line."""
    encoded.select("line").write.mode("overwrite").text(path)


def _schema_rules() -> tuple[list[dict[str, tuple]], dict[str, list[str]]]:
    """By depth and path: (JSON type, enum, is it a cluster id) of every value; and the fields each object needs by its path."""
    rules, needs = [], {}

    def visit(path: str, field: Field, depth: int) -> None:
        if len(rules) < depth:
            rules.append({})
        if field.many:
            rules[depth - 1][path] = ("array", None, False)
            visit(f"{path}[]", Field(field.name, field.kind, False, False), depth + 1)
        elif field.kind in NESTED:
            rules[depth - 1][path] = ("object", None, False)
            needs[path] = [f.name for f in NESTED[field.kind] if not f.optional]
            for inner in NESTED[field.kind]:
                visit(f"{path}.{inner.name}", inner, depth + 1)
        elif field.kind == "textmap":
            rules[depth - 1][path] = ("object", None, False)
            visit(f"{path}.*", Field("*", "text", False, True), depth + 1)
        else:
            kind = {"int": "integer", "decimal": "number"}.get(field.kind, "string")
            enum = list(_ENUMS[field.kind]) if field.kind in _ENUMS else None
            rules[depth - 1][path] = (kind, enum, field.kind == "uuid")

    for field in MESSAGE_FIELDS:
        visit(field.name, field, 1)
    return rules, needs


def _json_type(name: Column) -> Column:
    """JSON's name for the type of a variant, which ``schema_of_variant`` calls ``name``."""
    return (F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
            .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
            .when((name == "BIGINT") | name.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").otherwise("number"))


def _scalar_fault(node: Column) -> Column:
    """The rule that a value breaks which should be no object or array, by its ``path``, ``rule``, ``found`` and ``value``."""
    path, wanted, found = node["path"], node["rule"]["wanted"], node["found"]
    text_value, fits = F.try_variant_get(node["value"], "$", "string"), found == wanted
    return (F.when(~fits & ~((wanted == "number") & (found == "integer")), F.concat(F.lit("type "), path))
            .when(fits & ~F.array_contains(node["rule"]["enum"], text_value), F.concat(F.lit("enum "), path))
            .when(fits & node["rule"]["is_id"] & ~text_value.rlike(UUID_PATTERN), F.concat(F.lit("pattern "), path)))


def message_conformance(lines: DataFrame, text_col: str) -> DataFrame:
    """``kind, rule, n``: how often the lines of each kind break each schema rule, at every level.

    A rule is ``missing``, ``type``, ``enum`` or ``pattern`` and the path it is about, ``clusters[].workers[].state`` say; a line
    breaks it once for each place. Each text is parsed once to a variant, which is opened level by level: objects and arrays that the
    schema knows give rows, their other members are judged where they are found and only broken rules go on. A field that is null counts
    as absent. A value of the wrong type is looked into no further; fields that a kind doesn't have are left alone. A text that is no JSON
    object (or repeats a key) is malformed; an empty table gives no rows.
    """
    rules, needs = _schema_rules()
    open_ = {kind: [path for level in rules for path, (t, *_) in level.items() if t == kind] for kind in ("object", "array")}
    maps = [path[:-2] for level in rules for path in level if path.endswith(".*")]
    texts = lambda values: F.lit(None).cast("array<string>") if values is None else F.array(*[F.lit(x) for x in values]).cast("array<string>")
    by = lambda table: F.create_map(*[x for key, value in table.items() for x in (F.lit(key), value)])
    rule_of = lambda t, enum, is_id: F.struct(F.lit(t).alias("wanted"), texts(enum).alias("enum"), F.lit(is_id).alias("is_id"))
    # as the one item of an array, for parsing stops at the end of a value; the generator keeps the optimizer from copying the parse, see _parsed
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(text_col), F.lit("]"))), "$", "array<variant>")
    no_rule, no_value = F.lit(None).cast("string"), F.lit(None).cast("variant")
    nodes = lines.select(F.explode(F.array(alone)).alias("all")).select(F.when(F.size("all") == 1, F.try_element_at("all", F.lit(1))).alias("value")).select(
        F.try_variant_get("value", "$['$type']", "string").alias("kind"), F.lit("").alias("path"), "value", no_rule.alias("broken"))
    path, kind = F.col("path"), F.col("kind")
    for depth, level in enumerate(rules):
        known = by({p: rule_of(*rule) for p, rule in level.items()})
        fields = F.try_element_at(by({k: texts([*required, *optional]) for k, (required, optional) in KINDS.items()}), kind)
        needed = (F.try_element_at(by({p: texts(names) for p, names in needs.items()}), path) if depth else
                  F.try_element_at(by({k: texts(required) for k, (required, _) in KINDS.items()}), kind))
        # a row is a value to open, or a rule that was broken; the generator keeps the optimizer from copying what opens it
        opened = nodes.select("kind", "path", "broken", F.explode(F.array(F.struct(
            fields.alias("fields"), needed.alias("needed"), path.isin(maps).alias("is_map"),
            F.when(F.col("broken").isNull() & ((path == "") | path.isin(open_["object"])), F.try_variant_get("value", "$", "map<string,variant>")).alias("members"),
            F.when(F.col("broken").isNull() & path.isin(open_["array"]), F.try_variant_get("value", "$", "array<variant>")).alias("items")))).alias("in")
        ).select("kind", "path", "broken", "in.*")
        members, held = F.map_entries("members"), F.map_keys(F.map_filter("members", lambda _, v: ~F.is_variant_null(v)))
        if not depth:
            wanted, named = lambda key: F.array_contains("fields", key), lambda key: key
            single = F.when(F.col("members").isNull(), "malformed JSON").when(~F.coalesce(kind.isin(list(KINDS)), F.lit(False)), "unknown $type")
        else:
            # a name with a mark of paths in it is none of the schema's
            wanted = lambda key: F.col("is_map") | ~(key.contains(".") | key.contains("[") | key.contains("*"))
            named = lambda key: F.when(F.col("is_map"), F.concat(path, F.lit(".*"))).otherwise(F.concat(path, F.lit("."), key))
            single = F.when(F.col("members").isNull() & F.col("items").isNull(), F.concat(F.lit("type "), path))
        members = F.filter(members, lambda e: ~F.is_variant_null(e["value"]) & wanted(e["key"]))  # noqa: B023
        inner = F.coalesce(
            F.transform(members, lambda e: F.struct(named(e["key"]).alias("path"), e["value"].alias("value"))),  # noqa: B023
            F.transform("items", lambda v: F.struct(F.concat(path, F.lit("[]")).alias("path"), v.alias("value"))))
        ruled = F.transform(inner, lambda c: F.struct(c["path"].alias("path"), c["value"].alias("value"), F.try_element_at(known, c["path"]).alias("rule")))  # noqa: B023
        container = lambda c: c["rule"]["wanted"].isin("object", "array")
        seen = F.transform(F.filter(ruled, lambda c: c["rule"].isNotNull()), lambda c: F.struct(
            c["path"].alias("path"), c["value"].alias("value"), c["rule"].alias("rule"),
            F.when(~container(c), F.schema_of_variant(c["value"])).alias("name")))
        seen = F.transform(seen, lambda c: F.struct(c["path"].alias("path"), c["value"].alias("value"), c["rule"].alias("rule"), _json_type(c["name"]).alias("found")))
        judged = F.transform(seen, lambda c: F.struct(
            c["path"].alias("path"), F.when(container(c), c["value"]).alias("value"), F.when(~container(c), _scalar_fault(c)).alias("broken")))
        go_on = F.filter(judged, lambda c: c["value"].isNotNull() | c["broken"].isNotNull())
        missing = F.transform(F.array_except("needed", held), lambda name: F.concat(F.lit("missing "), F.concat_ws(".", F.nullif(path, F.lit("")), name)))
        faults = F.transform(F.concat(F.array_compact(F.array(single)), F.coalesce(missing, texts([]))),
                             lambda rule: F.struct(path.alias("path"), no_value.alias("value"), rule.alias("broken")))
        own = F.array(F.struct(path.alias("path"), no_value.alias("value"), F.col("broken").alias("broken")))
        out = F.when(F.col("broken").isNotNull(), own).otherwise(F.concat(faults, F.coalesce(go_on, F.slice(own, 1, 0))))
        nodes = opened.select("kind", F.explode(out).alias("node")).select("kind", "node.*")
    return nodes.where(F.col("broken").isNotNull()).groupBy(F.coalesce("kind", F.lit("?")).alias("kind"), F.col("broken").alias("rule")).agg(F.count("*").alias("n"))
