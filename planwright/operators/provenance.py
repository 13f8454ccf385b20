"""Where a bill line's number comes from: the payload is built per basis, parsed back strictly, and audited per axis.

Payloads are JSON text. A payload is parsed once, in Arrow batches, and checked field by field against the forms below; one
that does not fit is null as a whole, while steps of a chain that an item carries are dropped one by one. Plain payloads of
a batch are parsed and checked all at once by Arrow, the others one by one, each distinct text once. All else is column
expressions: a line is judged where it stands, without a shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json as arrow_json
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from planwright.functions.numbers import chain_confidence, normal_confidence
from planwright.operators.audit import REVIEW_BELOW

# Source types, derivation types, step types and the fields of each kind of evidence. A field is text, a
# number, a whole number, a box or one of some words; `?` marks those that may be absent, `0` those that may be null, too.
SOURCES = ["MEASURED", "DERIVED", "ESTIMATED", "MANUAL", "IMPORTED", "PROVISIONAL_SUM", "LUMP_SUM"]
DERIVATIONS = ["formula", "rule", "ai_reasoning"]
STEPS = ["EXTRACTION", "MEASUREMENT", "DERIVATION", "ASSUMPTION", "PRIOR"]
BOX = {"cs": "dxf-mm|pdf-pt|pdf-pct", "x": "number", "y": "number", "w": "number?", "h": "number?"}
EVIDENCE = {
    "sheet": {"sheetId": "text", "drawingNo": "text?0", "pageNo": "whole?0", "label": "text?", "sheetTitle": "text?", "sourceDocFilename": "text?", "sheetType": "text?", "bbox": "box?", "extractedValue": "text?"},
    "takeoffItem": {"takeoffItemId": "text", "tag": "text?0", "description": "text?", "category": "text?"},
    "document": {"documentId": "text", "filename": "text", "pageNo": "whole?0", "bbox": "box?"},
    "rateLibrary": {"code": "text", "scope": "org|global", "rate": "text"},
    "assembly": {"assemblyId": "text", "name": "text?", "brandName": "text?0"},
    "user": {"userId": "text", "at": "text", "note": "text?"},
    "mepRule": {"ruleId": "text", "name": "text?", "factorSource": "text?", "rateSource": "text?"},
    "import": {"importType": "text", "sourceLabel": "text", "importedAt": "text", "importedBy": "text?"},
    "legacy": {"note": "text"},
}
STEP = {"id": "text", "type": "|".join(STEPS), "confidence": "share", "weight": "share", "label": "text?", "sourceRef": "text?"}
INPUT = {"name": "text", "value": "text or number", "unit": "text?", "source": "evidence?"}
PAYLOAD = {"sourceType": "|".join(SOURCES), "derivationType": "|".join(DERIVATIONS) + "?0", "formula": "text?", "ruleRef": "text?", "reasoning": "text?", "confidence": "share?", "stampedBy": "text?"}
#: Sources that are set by a person or a supplier: nothing is derived, and neither confidence nor a rate is judged.
GIVEN = ["MANUAL", "IMPORTED", "PROVISIONAL_SUM", "LUMP_SUM"]
#: Evidence that tells where a rate comes from.
RATE_KINDS = ["rateLibrary", "assembly", "mepRule", "import"]
#: Items named one by one in the evidence of a collapsed line.
NAMED_ITEMS = 25

STEP_LIST = "array<struct<id:string,type:string,confidence:double,weight:double,label:string,sourceRef:string>>"
_TYPED = f"struct<sourceType:string,derivationType:string,evidence:array<struct<kind:string>>,formula:string,ruleRef:string,reasoning:string,confidence:double,evidenceChain:{STEP_LIST},stampedBy:string>"
#: The same, with what was read from a sheet and where.
_PLACED = _TYPED.replace("array<struct<kind:string>>", "array<struct<kind:string,extractedValue:string,bbox:struct<cs:string,x:double,y:double>>>", 1)

#: An item's meta as read(): its chain, the texts that payloads name and its place on the sheet.
_META_TEXTS = ["extractedValue", "mepRuleId", "mepDiscipline", "mepFactorSource", "mepRateSource", "mepFormulaText", "estimationReasoning"]
_META = f"struct<chain:{STEP_LIST},{','.join(f'{k}:string' for k in _META_TEXTS)},box:struct<cs:string,x:double,y:double,w:double,h:double>>"

_ABSENT = object()


def _is_text(x: object) -> bool:
    return type(x) is str


def _is_number(x: object) -> bool:
    return type(x) in (int, float)


def _check(kind: str) -> Callable[[object], bool]:
    """Whether a value that is there, and no null, has its form."""
    given = {
        "text": _is_text, "number": _is_number, "text or number": lambda x: type(x) in (str, int, float), "share": lambda x: type(x) in (int, float) and 0 <= x <= 1,
        "whole": lambda x: type(x) is int or type(x) is float and (math.isinf(x) or x.is_integer()), "box": lambda x: _fits(x, _BOX_FORM), "evidence": evidence_fits}
    words = frozenset(kind.split("|"))
    return given.get(kind, lambda x: type(x) is str and x in words)


def _form(form: dict[str, str]) -> list[tuple]:
    """(field, check, whether it may be absent, whether it may be null) of a form, for _fits()."""
    return [(field, _check(kind.rstrip("?0")), "?" in kind, kind.endswith("0")) for field, kind in form.items()]


def _fits(v: object, form: list[tuple]) -> bool:
    if type(v) is not dict:
        return False
    for field, check, absent, null in form:
        x = v.get(field, _ABSENT)
        if not (absent if x is _ABSENT else null if x is None else check(x)):
            return False
    return True


def evidence_fits(v: object) -> bool:
    kind = v.get("kind") if type(v) is dict else None
    return type(kind) is str and kind in _EVIDENCE_FORMS and _fits(v, _EVIDENCE_FORMS[kind])


_BOX_FORM, _STEP_FORM, _INPUT_FORM, _PAYLOAD_FORM = _form(BOX), _form(STEP), _form(INPUT), _form(PAYLOAD)
_EVIDENCE_FORMS = {kind: _form(form) for kind, form in EVIDENCE.items()}


def _each(v: dict, field: str, fits: Callable[[object], bool], least: int = 0) -> bool:
    """Absent if `least` is 0, or a list of at least so many elements that all fit."""
    listed = v.get(field, _ABSENT)
    return least == 0 if listed is _ABSENT else type(listed) is list and len(listed) >= least and all(map(fits, listed))


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a field is named twice")
    return out


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


class _Decoder(json.JSONDecoder):
    """Made once and not for each text; tasks make their own."""

    def __init__(self) -> None:
        json.JSONDecoder.__init__(self, object_pairs_hook=_object, parse_constant=_no_number)

    def __reduce__(self) -> tuple:
        return _Decoder, ()


_DECODER = _Decoder()


def _json(raw: str | None) -> dict | None:
    """The object that a JSON text holds; None for other values, and for what is no JSON or names a field of an object twice."""
    try:
        v = None if raw is None else _DECODER.decode(raw)
    except (ValueError, RecursionError):
        return None
    return v if type(v) is dict else None


def _text(x: object) -> str | None:
    """A text as it can be stored: halves of surrogate pairs are no characters."""
    return x if type(x) is not str or x.isascii() else x.encode("utf-8", "replace").decode()


def _step(v: dict) -> dict:
    return {"id": _text(v["id"]), "type": v["type"], "confidence": float(v["confidence"]), "weight": float(v["weight"]), "label": _text(v.get("label")), "sourceRef": _text(v.get("sourceRef"))}


def step_fits(v: object) -> bool:
    return _fits(v, _STEP_FORM)


def _chain(v: dict) -> list[dict] | None:
    listed = v.get("evidenceChain")
    return [_step(x) for x in listed if step_fits(x)] or None if type(listed) is list else None


def _double(x: float) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.copysign(math.inf, x)


def _evidence(e: dict) -> dict:
    if e["kind"] != "sheet":
        return {"kind": e["kind"]}
    at = e.get("bbox")
    return {"kind": "sheet", "extractedValue": _text(e.get("extractedValue")), "bbox": at and {"cs": at["cs"], "x": _double(at["x"]), "y": _double(at["y"])}}


def _payload(raw: str | None) -> dict | None:
    v = _json(raw)
    if v is None or not (_fits(v, _PAYLOAD_FORM) and _each(v, "evidence", evidence_fits, 1) and _each(v, "inputs", lambda x: _fits(x, _INPUT_FORM)) and _each(v, "evidenceChain", step_fits)):
        return None
    sure, chain = v.get("confidence"), v.get("evidenceChain")
    return {k: _text(v.get(k)) for k in ("sourceType", "derivationType", "formula", "ruleRef", "reasoning", "stampedBy")} | {
        "evidence": [_evidence(e) for e in v["evidence"]], "confidence": None if sure is None else float(sure), "evidenceChain": None if chain is None else [_step(x) for x in chain]}


def _place(v: dict) -> dict | None:
    """The place of an item on its sheet, from `position` or else `bbox` of its meta; only with both coordinates."""
    at = next((v[k] for k in ("position", "bbox") if v.get(k) is not None), None)
    if type(at) is not dict or not (_is_number(at.get("x")) and _is_number(at.get("y"))):
        return None
    cs = at.get("cs")
    cs = "dxf-mm" if cs is None else cs if type(cs) is str else json.dumps(cs, separators=(",", ":"), ensure_ascii=False)
    return {"cs": _text(cs)} | {k: float(at[k]) if _is_number(at.get(k)) else None for k in ("x", "y", "w", "h")}


def _item_meta(raw: str | None) -> dict | None:
    v = _json(raw)
    return None if v is None else {"chain": _chain(v), "box": _place(v)} | {k: _text(v[k]) if type(v.get(k)) is str else None for k in _META_TEXTS}


def _item_steps(raw: str | None) -> list[dict] | None:
    v = _json(raw)
    return None if v is None else _chain(v)


# Many payloads at once


def _once(texts: pa.Array, read: Callable[[str | None], object], type_: pa.DataType) -> pa.Array:
    """What `read` gives for each text; texts that are the same are read once."""
    distinct = texts.dictionary_encode()
    values = pa.array([*map(read, distinct.dictionary.to_pylist()), read(None)], type_)
    return values.take(pc.fill_null(distinct.indices, len(values) - 1))


def _struct_of(form: dict[str, str]) -> pa.DataType:
    of = lambda kind: pa.struct([("cs", pa.string()), *[(k, pa.float64()) for k in "xywh"]]) if kind == "box" else pa.float64() if kind in ("number", "share", "whole") else pa.string()
    return pa.struct([(field, of(kind.rstrip("?0"))) for field, kind in form.items()])


#: All fields that evidence has, of whatever kind; a payload with others, or with inputs, is read by itself.
_ANY_EVIDENCE = _struct_of({"kind": "text"} | {field: kind for form in EVIDENCE.values() for field, kind in form.items()})
_PLAIN = pa.schema([*_struct_of(PAYLOAD), ("evidence", pa.list_(pa.field("element", _ANY_EVIDENCE))), ("evidenceChain", pa.list_(pa.field("element", _struct_of(STEP))))])
#: What Arrow's parser does not tell apart (nulls from what is absent) or takes otherwise (escaped characters), and line feeds, which divide texts here.
_NOT_PLAIN = r"null|\\u|\n"
#: Payloads parsed together where one of a batch stops the parser; where it is among them, they are read one by one.
_TOGETHER = 500


def _holds(v: pa.StructArray, form: dict[str, str]) -> pa.Array:
    """_fits() of structs that Arrow has parsed, so that types are right already and nulls were absent."""
    fits = pc.is_valid(v)
    for field, kind in form.items():
        x, plain = v.field(field), kind.rstrip("?0")
        if plain == "share":
            right = pc.and_(pc.greater_equal(x, 0.0), pc.less_equal(x, 1.0))
        elif plain == "whole":
            right = pc.equal(pc.floor(x), x)
        elif plain == "box":
            right = _holds(x, BOX)
        elif plain in ("text", "number"):
            right = pc.is_valid(x)
        else:
            right = pc.is_in(x, value_set=pa.array(plain.split("|")))
        fits = pc.and_(fits, pc.if_else(pc.is_null(x), "?" in kind, right))
    return fits


def _all_hold(lists: pa.ListArray, fits: pa.Array) -> pa.Array:
    """Whether all elements of each list fit; `fits` has a value for each element of all lists."""
    out = np.ones(len(lists), dtype=bool)
    out[pc.list_parent_indices(lists).filter(pc.invert(fits)).to_numpy()] = False
    return pa.array(out)


def _plain_payloads(texts: pa.Array, type_: pa.DataType) -> pa.Array | None:
    """_payload() of texts that begin and end as objects do, parsed all at once; None if one of them stops the parser.

    A text can't go on in the next one, which begins with a brace; so there is a row for each only if each holds one object.
    """
    if not len(texts):
        return pa.array([], type_)
    lines = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "\n")[0].as_buffer()
    options = arrow_json.ParseOptions(explicit_schema=_PLAIN, unexpected_field_behavior="error")
    try:
        table = arrow_json.read_json(pa.BufferReader(lines), arrow_json.ReadOptions(use_threads=False, block_size=lines.size + 1), options)
    except pa.ArrowInvalid:
        return None
    if len(table) != len(texts):
        return None
    rows = table.to_struct_array().combine_chunks()
    evidence, chain = rows.field("evidence"), rows.field("evidenceChain")
    each, steps = evidence.flatten(), chain.flatten()
    kind = each.field("kind")
    known = pc.is_in(kind, value_set=pa.array(list(EVIDENCE)))
    for name in set(pc.unique(kind).to_pylist()) & set(EVIDENCE):
        known = pc.and_(known, pc.or_(pc.not_equal(pc.fill_null(kind, ""), name), _holds(each, EVIDENCE[name])))
    fits = reduce(pc.and_, [_holds(rows, PAYLOAD), pc.fill_null(pc.greater(pc.list_value_length(evidence), 0), False), _all_hold(evidence, known), _all_hold(chain, _holds(steps, STEP))])
    kept = type_.field("evidence").type
    no_sheet = pc.fill_null(pc.not_equal(kind, "sheet"), True)
    columns = [kind]
    if kept.value_type.num_fields > 1:
        box = each.field("bbox")
        columns.append(pc.if_else(no_sheet, None, each.field("extractedValue")))
        columns.append(pa.StructArray.from_arrays([box.field(c) for c in ("cs", "x", "y")], ["cs", "x", "y"], mask=pc.or_(no_sheet, pc.is_null(box))))
    shown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(evidence), 0).to_numpy())]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kept.value_type)), type=kept)
    return pa.StructArray.from_arrays([shown if f.name == "evidence" else rows.field(f.name) for f in type_], fields=list(type_), mask=pc.invert(fits))


def _payloads(texts: pa.Array, type_: pa.DataType) -> pa.Array:
    """_payload() of each text: plain ones together, the others one by one."""
    plain = reduce(pc.and_, [pc.starts_with(texts, "{"), pc.ends_with(texts, "}"), pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))])
    plain = pc.fill_null(plain, False)
    some = texts.filter(plain)
    read = _plain_payloads(some, type_)
    if read is None:
        parts = [some[k : k + _TOGETHER] for k in range(0, len(some), _TOGETHER)]
        read = pa.concat_arrays([_once(part, _payload, type_) if (done := _plain_payloads(part, type_)) is None else done for part in parts])
    if len(some) == len(texts):
        return read
    places = plain.to_numpy(zero_copy_only=False)
    order = np.where(places, np.cumsum(places) - 1, len(some) + np.cumsum(~places) - 1)
    return pa.concat_arrays([read, _once(texts.filter(pc.invert(plain)), _payload, type_)]).take(pa.array(order))


def _reader(read: Callable[[pa.Array, pa.DataType], pa.Array], type_: str) -> Callable[[Column], Column]:
    """A column function that reads JSON texts by `read`, Arrow batch by batch."""

    def over(raw: Column) -> Column:
        arrow = to_arrow_type(DataType.fromDDL(type_))
        return F.arrow_udf(lambda texts: read(texts, arrow), returnType=type_)(raw.cast("string"))

    return over


_read_payload, _read_placed = _reader(_payloads, _TYPED), _reader(_payloads, _PLACED)
_read_meta, _read_steps = _reader(lambda texts, type_: _once(texts, _item_meta, type_), _META), _reader(lambda texts, type_: _once(texts, _item_steps, type_), STEP_LIST)


def parse(raw: Column) -> Column:
    """The payload of a JSON text as a struct, or null if it is absent, no JSON or not of the forms above.

    Unknown fields are passed over, of evidence only the kind is kept.
    """
    return _read_payload(raw)


def parse_placed(raw: Column) -> Column:
    """parse() that also keeps the value read from a sheet, and its place there."""
    return _read_placed(raw)


def parse_variant(v: Column) -> Column:
    """parse() of JSON that is a VARIANT already."""
    return parse(F.to_json(v))


def valid_steps(meta: Column) -> Column:
    """The steps of an item's chain that fit, in order; null if its JSON has no list of steps or none of them fits."""
    return _read_steps(meta)


# Building


def _meta(field: str) -> Column:
    return F.col(f"_m.{field}")


def _kind(name: str, /, **fields: Column) -> Column:
    """An evidence struct with all fields any builder fills; absent ones are null and leave the JSON."""
    none = F.lit(None)
    known = {"kind": F.lit(name), **fields}
    text = ["kind", "takeoffItemId", "tag", "description", "category", "sheetId", "drawingNo", "label", "sheetTitle", "sheetType", "sourceDocFilename", "extractedValue", "ruleId", "name", "factorSource", "rateSource", "note", "userId", "at", "importType", "sourceLabel", "importedAt", "importedBy"]
    box = F.coalesce(known.get("bbox", none), none).cast("struct<cs:string,x:double,y:double,w:double,h:double>") if "bbox" in known else none.cast("struct<cs:string,x:double,y:double,w:double,h:double>")
    return F.struct(*[known.get(k, none).cast("string").alias(k) for k in text], known.get("pageNo", none).cast("bigint").alias("pageNo"), box.alias("bbox"))


def _item_evidence(length: int) -> Column:
    return _kind("takeoffItem", takeoffItemId=F.col("item_id").cast("string"), tag=F.col("tag"), description=F.substring("description", 1, length), category=F.col("category"))


def build_auto(items: DataFrame, is_provisional: str = "is_provisional") -> DataFrame:
    """`items` with provenance, the JSON payload of the bill line generated for each.

    Items have item_id, tag, description, category, basis, confidence (a share or a percentage), meta (JSON text), source_note
    and of their sheet sheet_id, drawing_no, page_no, title, sheet_type, filename (sheet_id null: no sheet). The chain is what
    fits of meta's steps, and the confidence that of the chain or else the item's. An item that a services rule made is
    derived by that rule; others go by basis; an unknown basis counts as an estimate. Null fields leave the payload.
    """
    items = items.withColumn("_m", _read_meta(F.col("meta")))
    chain = _meta("chain")
    confidence = F.when(chain.isNotNull(), chain_confidence(chain)).otherwise(normal_confidence(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    extracted = F.coalesce(_meta("extractedValue"), filled("source_note"))
    sheet = F.when(F.col("sheet_id").isNotNull(), _kind(
        "sheet", sheetId=F.col("sheet_id").cast("string"), drawingNo=F.col("drawing_no"), pageNo=F.col("page_no"), label=F.col("source_note"), sheetTitle=filled("title"), sheetType=filled("sheet_type"),
        sourceDocFilename=filled("filename"), bbox=_meta("box"), extractedValue=F.when(extracted != "", extracted)))
    rule = _meta("mepRuleId")
    services = F.when(rule.isNotNull(), _kind(
        "mepRule", ruleId=rule, name=F.coalesce(F.concat(_meta("mepDiscipline"), F.lit(" / "), F.col("description")), F.col("description")), factorSource=_meta("mepFactorSource"), rateSource=_meta("mepRateSource")))
    measured, derived = F.col("basis").isin("MEASURED", "VISUAL"), F.col("basis").isin("DERIVED", "PARAMETRIC")
    guessed = F.col("basis").isin("ESTIMATED", "PLACEHOLDER")
    by_rule, by_formula = rule.isNotNull(), rule.isNull() & derived
    # The formulas and reasons a line is stamped with.
    formula = F.when(F.col(is_provisional), F.concat(F.lit("psAmount carried from takeoff "), F.coalesce("tag", F.substring("description", 1, 30)))).otherwise("amount = qty × rate")
    reason = F.when(by_rule, F.coalesce(_meta("mepFormulaText"), F.concat(F.lit("Derived from MEP rule "), rule)))
    reason = reason.when(measured | derived, F.lit(None)).when(guessed, F.coalesce(_meta("estimationReasoning"), F.col("source_note"), F.concat(F.lit("Estimated from "), F.col("category"), F.lit(" prior"))))
    reason = reason.otherwise(F.concat(F.lit("Unknown takeoff basis '"), F.coalesce("basis", F.lit("null")), F.lit("' — defaulted to ESTIMATED")))
    payload = F.struct(
        F.when(by_rule | derived, "DERIVED").when(measured, "MEASURED").otherwise("ESTIMATED").alias("sourceType"),
        F.when(by_rule, "rule").when(derived, "formula").when(~F.coalesce(measured, F.lit(False)), "ai_reasoning").alias("derivationType"),
        F.array_compact(F.array(_item_evidence(100), sheet, services)).alias("evidence"), F.when(by_formula, formula).alias("formula"),
        F.when(by_rule, F.concat(F.lit("mep-rule:"), rule)).alias("ruleRef"), reason.alias("reasoning"), confidence.alias("confidence"), chain.alias("evidenceChain"),
        F.when(by_rule, "generateBoq.auto.mep").otherwise("generateBoq.auto").alias("stampedBy"))
    return items.withColumn("provenance", F.to_json(payload)).drop("_m")


#: What a collapsed line says of itself.
_ALLOWANCE = {"PROVISIONAL_SUM": ("P/S allowance", "generateBoq.provisionalCollapse"), "LUMP_SUM": ("LS supplier-quote allowance", "generateBoq.lumpSumCollapse")}
_CONFIRMED_BY = ". The app deliberately does not estimate this discipline from the drawing; a contractor / supplier confirms the number."


def build_collapsed(items: DataFrame, keys: list[str], kind: str, allowance: Column | None = None) -> DataFrame:
    """One line per `keys`, category among them, for items rolled up into a provisional or a lump sum: keys, n_items and provenance.

    `allowance` is the sum set aside, by the columns in `keys`; null means that it is still to be confirmed.

    The first 25 items by item_id are named, the others counted. The limit on the row number is applied in each task
    before the shuffle, so of a group of any size only 25 rows a task are moved.
    """
    if kind not in ("PROVISIONAL_SUM", "LUMP_SUM"):
        raise ValueError(f"a collapsed line is a PROVISIONAL_SUM or a LUMP_SUM, not {kind}")
    place = Window.partitionBy(*keys).orderBy("item_id", "tag", "description", "category")
    named = items.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= NAMED_ITEMS)
    some = F.transform(F.array_sort(F.collect_list(F.struct("_place", _item_evidence(80).alias("e")))), lambda x: x["e"])
    named = named.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(some.alias("some"))
    counted = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))
    whole = counted.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    more = F.when(F.col("n_items") > NAMED_ITEMS, _kind("legacy", note=F.concat(F.lit("+"), (F.col("n_items") - NAMED_ITEMS).cast("string"), F.lit(" more takeoff items rolled up"))))
    label, stamp = _ALLOWANCE[kind]
    amount = F.lit(None).cast("double") if allowance is None else allowance
    said = F.coalesce(F.concat(F.format_number(amount, 0), F.lit(" AED from engineer-takeoff defaults")), F.lit("allowance pending estimator confirmation"))
    note = _kind("legacy", note=F.concat(F.lit(f"Contractor-typical {label} for "), F.coalesce("category", F.lit("null")), F.lit(" — "), said, F.lit(_CONFIRMED_BY)))
    payload = F.struct(F.lit(kind).alias("sourceType"), F.array_compact(F.concat("some", F.array(more, note))).alias("evidence"), F.lit(1.0).alias("confidence"), F.lit(stamp).alias("stampedBy"))
    return whole.select(*keys, "n_items", F.to_json(payload).alias("provenance"))


def build_manual(user: Column, at: Column, note: Column, confidence: Column | None = None) -> Column:
    """The payload of a line that a person typed."""
    sure = F.lit(1.0) if confidence is None else F.coalesce(confidence, F.lit(1.0))
    return F.to_json(F.struct(F.lit("MANUAL").alias("sourceType"), F.array(_kind("user", userId=user, at=at, note=note)).alias("evidence"), sure.alias("confidence"), F.lit("routes.manual").alias("stampedBy")))


def build_imported(import_type: Column, label: Column, at: Column, by: Column) -> Column:
    """The payload of a line taken from a supplier's or consultant's document."""
    source = _kind("import", importType=import_type, sourceLabel=label, importedAt=at, importedBy=by)
    return F.to_json(F.struct(F.lit("IMPORTED").alias("sourceType"), F.array(source).alias("evidence"), F.lit(1.0).alias("confidence"), F.lit("routes.import").alias("stampedBy")))


# Auditing

_FINDING = "array<struct<reason:string,resolution:string,tag:string>>"
#: How to settle a doubtful step, by its type.
SETTLE = {
    "EXTRACTION": "open the drawing and compare the value read with what stands there", "MEASUREMENT": "check the area or length against the drawing and correct the item if it is off",
    "DERIVATION": "check that the formula suits the scope", "ASSUMPTION": "measure the value, or confirm that the assumption holds for this project",
    "PRIOR": "measure the value, or confirm that the prior fits this kind of project",
}


def _finding(holds: Column, reason: Column | str, resolution: Column | str, tag: str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(holds, F.struct(text(reason).alias("reason"), text(resolution).alias("resolution"), F.lit(tag).alias("tag")))


def _module(name: str, axis: Column | str, verdict: Column, findings: Column) -> Column:
    axis = F.lit(axis) if isinstance(axis, str) else axis
    return F.struct(F.lit(name).alias("module"), axis.alias("axis"), verdict.alias("verdict"), findings.alias("findings"))


def integrity(p: Column) -> Column:
    """Whether the payload is there and its derivation fits its source; fails on the quantity's axis, on both if it is absent."""
    source, derivation = p["sourceType"], p["derivationType"]
    got = F.coalesce(derivation, F.lit("null"))
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    derived, estimated, none = source == "DERIVED", source == "ESTIMATED", ~source.isin("DERIVED", "ESTIMATED")
    odd = derived & ~F.coalesce(derivation.isin("formula", "rule"), F.lit(False))
    # The reasons and tags are fixed values.
    hard = F.array_compact(F.array(
        _finding(odd, F.concat(F.lit("DERIVED requires derivationType=formula|rule (got "), got, F.lit(")")), "say by which formula or rule the number was derived", "BAD_DERIVATION"),
        _finding(derived & (derivation == "formula") & empty(p["formula"]), "DERIVED+formula requires provenance.formula", "write the formula down", "BAD_DERIVATION"),
        _finding(derived & (derivation == "rule") & empty(p["ruleRef"]), "DERIVED+rule requires provenance.ruleRef", "name the rule", "BAD_DERIVATION"),
        _finding(estimated & ~F.coalesce(derivation == "ai_reasoning", F.lit(False)), F.concat(F.lit("ESTIMATED requires derivationType=ai_reasoning (got "), got, F.lit(")")), "mark the estimate as reasoned and give the reasoning", "BAD_DERIVATION"),
        _finding(estimated & empty(p["reasoning"]), "ESTIMATED requires non-empty reasoning", "say what the estimate rests on", "MISSING_REASONING"),
        _finding(none & derivation.isNotNull(), F.concat(source, F.lit(" should have derivationType=null (got '"), derivation, F.lit("'); a measured/typed/imported/P-S/LS line has no derivation step")), "clear the derivation, or call the line derived", "BAD_DERIVATION"),
    ))
    kinds = F.transform(p["evidence"], lambda e: e["kind"])
    unsigned = (source == "MANUAL") & ~F.array_contains(kinds, "user") & ~F.array_contains(kinds, "legacy")
    soft = F.array_compact(F.array(_finding(unsigned, "MANUAL line has no user or legacy backfill evidence", "add who set the value, and when", "MISSING_EVIDENCE")))
    absent = F.array(_finding(F.lit(True), "no provenance payload — line predates TR-1 or write path missed stamping", "fill in old payloads or generate the bill again", "MISSING_PROVENANCE"))
    verdict = F.when(p.isNull() | (F.size(hard) > 0), "failed").when(F.size(soft) > 0, "review").otherwise("verified")
    return _module("Integrity", F.when(p.isNull(), "shared").otherwise("quantity"), verdict, F.when(p.isNull(), absent).when(F.size(hard) > 0, hard).otherwise(soft))


def _two(x: Column) -> Column:
    return F.format_string("%.2f", F.floor(x * 100 + 0.5) / 100)


def confidence_module(p: Column) -> Column:
    """Whether the chain's product, or the flat confidence, reaches 0.6; names the step that pulls most."""
    chain = p["evidenceChain"]
    chained = F.coalesce(F.size(chain) > 0, F.lit(False))
    sure = F.when(chained, chain_confidence(chain)).otherwise(normal_confidence(F.coalesce(p["confidence"], F.col("confidence").cast("double"), F.lit(0.0))))
    pull = lambda s: F.pow(F.greatest(F.least(s["confidence"], F.lit(1.0)), F.lit(1e-6)), s["weight"])
    worst = F.array_min(F.transform(chain, lambda s, k: F.struct(pull(s).alias("pull"), k.alias("place"))))
    step = F.get(chain, worst["place"])
    why = F.concat(F.lit("confidence "), _two(sure), F.lit(f" below threshold {REVIEW_BELOW}"), F.when(chained, " (weighted-compound from evidence chain)").otherwise(" (flat — no chain)"))
    weakest = F.concat(F.lit("weakest step: "), step["type"], F.lit(' "'), F.coalesce(step["label"], step["id"]), F.lit('" c='), _two(step["confidence"]), F.lit(" w="), _two(step["weight"]), F.lit(" → contributes "), _two(worst["pull"]))
    settle = reduce(lambda rest, kind: F.when(step["type"] == kind, SETTLE[kind]).otherwise(rest), STEPS, F.lit(""))
    settle = F.concat(settle, F.coalesce(F.concat(F.lit(" (source: "), step["sourceRef"], F.lit(")")), F.lit("")))
    findings = F.array_compact(F.array(
        _finding(F.lit(True), why, F.when(chained, settle).otherwise("give the line a chain of steps, so that the doubtful one shows"), "LOW_CONF"),
        _finding(chained, weakest, "see the resolution before", "LOW_CONF")))
    low = sure < REVIEW_BELOW
    return _module("Confidence", "quantity", F.when(low, "review").otherwise("verified"), F.when(low, findings).otherwise(F.array().cast(_FINDING)))


def rate_evidence(p: Column) -> Column:
    """Whether something tells where the rate comes from; judged on the rate's axis alone."""
    linked = F.exists(p["evidence"], lambda e: e["kind"].isin(RATE_KINDS))
    absent = F.array(_finding(F.lit(True), "no provenance — cannot assess rate source", "fill in old payloads or generate the bill again", "MISSING_PROVENANCE"))
    unlinked = F.array(_finding(F.lit(True), "priced line has no rate source link (assembly / rateLibrary / mepRule / supplier import)", "link an assembly or a supplier's rate, or make the line provisional", "NO_RATE_EVIDENCE"))
    verdict = F.when(p.isNull(), "failed").when(linked, "verified").otherwise("review")
    return _module("RateEvidence", "rate", verdict, F.when(p.isNull(), absent).when(linked, F.array().cast(_FINDING)).otherwise(unlinked))


def _computed(p: Column) -> Column:
    return ~F.coalesce(p["sourceType"].isin(GIVEN), F.lit(False))


#: The modules in order: when one applies to a line, and what it finds. A caller may pass more of them to audit_lines().
MODULES: list[tuple[Callable[[Column], Column], Callable[[Column], Column]]] = [
    (lambda p: F.lit(True), integrity),
    (_computed, confidence_module),
    (lambda p: _computed(p) & ~F.coalesce(F.col("is_provisional"), F.lit(False)), rate_evidence),
]


def _worst(modules: Column, *axes: str) -> Column:
    of = F.filter(modules, lambda m: m["axis"].isin(*axes)) if axes else modules
    some = lambda verdict: F.exists(of, lambda m: m["verdict"] == verdict)
    return F.when(some("failed"), "failed").when(some("review"), "review").otherwise("verified")


def audit_lines(lines: DataFrame, modules: list | None = None) -> DataFrame:
    """`lines` (provenance JSON, confidence, is_provisional) with payload, modules, status, quantity_verdict and rate_verdict.

    A finding about the rate never lowers the verdict on the quantity; status is the worst of all. Repeated lines are
    judged alike, an empty table gives none, and columns of these names are replaced.
    """
    p = F.col("payload")
    parsed = lines.withColumn("payload", parse(F.col("provenance")))
    found = F.array_compact(F.array(*[F.when(applies(p), check(p)) for applies, check in modules or MODULES]))
    out = parsed.withColumn("modules", found)
    m = F.col("modules")
    return out.withColumns({"status": _worst(m), "quantity_verdict": _worst(m, "quantity", "shared"), "rate_verdict": _worst(m, "rate", "shared")})


def summary(audited: DataFrame, section: str) -> DataFrame:
    """(dimension, key, verified, review, failed): all lines, and by source type, derivation type and section, in one pass."""
    of = lambda name, key: F.struct(F.lit(name).alias("dimension"), key.alias("key"))
    each = F.array(
        of("all", F.lit("")), of("source_type", F.coalesce("payload.sourceType", F.lit("UNKNOWN"))), of("derivation_type", F.coalesce("payload.derivationType", F.lit("none"))), of("section", F.col(section)))
    rows = audited.select("status", F.explode(each).alias("d"))
    return rows.groupBy("d.dimension", "d.key").agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("verified", "review", "failed")])


def top_reasons(audited: DataFrame, n: int = 15) -> DataFrame:
    """(module, reason, n) of the most frequent findings; ties by module and reason."""
    # Plain explode() would have its input filtered first, with all that the modules are made from worked out once more for it.
    rows = audited.select(F.explode_outer("modules").alias("m")).select("m.module", F.explode_outer("m.findings.reason").alias("reason")).where(F.col("reason").isNotNull())
    return rows.groupBy("module", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module", "reason").limit(n)
