"""Scalar rules of language annotations ("atoms") and visual question answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the annotation format.
PERSISTENT_STYLES = ["task_aug", "subtask", "plan", "memory"]
EVENT_STYLES = ["interjection", "vqa"]
VIEW_DEPENDENT_STYLES = ["vqa", "trace"]
ROLES = ["user", "assistant", "system", "tool"]
PERSISTENT = "language_persistent"
EVENTS = "language_events"
MAX_ATOMS = 1000

TOOL_CALLS = "array<struct<type:string,function:struct<name:string,arguments:struct<text:string>>>>"
PERSISTENT_TYPE = f"array<struct<role:string,content:string,style:string,timestamp:float,camera:string,tool_calls:{TOOL_CALLS}>>"
EVENT_TYPE = f"array<struct<role:string,content:string,style:string,camera:string,tool_calls:{TOOL_CALLS}>>"


def column_for_style(style: Column) -> Column:
    """Which frame column stores an atom; an unknown style gives NULL."""
    return F.when(style.isin(PERSISTENT_STYLES), PERSISTENT).when(style.isNull() | style.isin(EVENT_STYLES), EVENTS)


def say_call(text: Column) -> Column:
    arguments = F.struct(text.alias("text"))
    function = F.struct(F.lit("say").alias("name"), arguments.alias("arguments"))
    return F.array(F.struct(F.lit("function").alias("type"), function.alias("function")))


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text_ok(value: Column, maximum: int = 500) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce((_type(value) == "STRING") & (F.length(F.trim(text)) > 0) & (F.length(text) <= maximum), F.lit(False))


def _get(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _unit_ok(value: Column, length: int) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    number = lambda v: (
        _type(v).rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$") & F.try_variant_get(v, "$", "double").between(0.0, 1.0))
    return F.coalesce((F.size(items) == length) & F.forall(items, number), F.lit(False))


def _keys(json: Column) -> Column:
    return F.json_object_keys(json)


def _within(keys: Column, allowed: list[str], required: list[str]) -> Column:
    need = F.array(*[F.lit(k) for k in required])
    may = F.array(*[F.lit(k) for k in allowed])
    return (F.size(F.array_except(keys, may)) == 0) & (F.size(F.array_except(need, keys)) == 0)


def vqa_kind(json: Column) -> Column:
    """bbox, keypoint, count, attribute or spatial; NULL when the answer has none of these shapes."""
    v = F.try_parse_json(json)
    array = lambda key: F.coalesce(_type(_get(v, key)).startswith("ARRAY"), F.lit(False))
    text = lambda key: F.coalesce(_type(_get(v, key)) == "STRING", F.lit(False))
    number = F.coalesce(_type(_get(v, "count")).rlike(r"^(BIGINT|DOUBLE|DECIMAL.*)$"), F.lit(False))
    value = F.coalesce(_type(_get(v, "value")) != "VOID", F.lit(False))
    return (
        F.when(array("detections"), "bbox")
        .when(_get(v, "point_format").isNotNull() & array("point"), "keypoint")
        .when(number & text("label"), "count")
        .when(text("attribute") & value, "attribute")
        .when(text("subject") & text("relation"), "spatial")
    )


def vqa_valid(json: Column) -> Column:
    """True when the answer obeys the rules of its shape: keys, texts, unit coordinates and limits."""
    v = F.try_parse_json(json)
    keys = _keys(json)
    has = lambda key: F.array_contains(keys, key)
    detections = F.try_variant_get(_get(v, "detections"), "$", "array<variant>")

    def detection_ok(d: Column) -> Column:
        fields = F.json_object_keys(F.to_json(d))
        return (
            _within(fields, ["label", "bbox_format", "bbox", "camera"], [])
            & _text_ok(_get(d, "label"))
            & F.coalesce(F.try_variant_get(d, "$.bbox_format", "string").isin("xyxy", "xywh"), F.lit(False))
            & _unit_ok(_get(d, "bbox"), 4)
        )

    boxes = _within(keys, ["detections"], ["detections"]) & F.coalesce(
        F.size(detections).between(1, 100) & F.forall(detections, detection_ok), F.lit(False))
    point = (
        _within(keys, ["label", "point_format", "point", "camera"], ["label", "point_format", "point"])
        & _text_ok(_get(v, "label")) & F.coalesce(F.try_variant_get(v, "$.point_format", "string") == "xy", F.lit(False))
        & _unit_ok(_get(v, "point"), 2))
    count = (
        _within(keys, ["label", "count", "note"], ["label", "count"]) & _text_ok(_get(v, "label"))
        & F.coalesce((_type(_get(v, "count")) == "BIGINT") & (F.try_variant_get(v, "$.count", "bigint") >= 0), F.lit(False))
        & (~has("note") | _text_ok(_get(v, "note"), 2000)))
    attribute = (
        _within(keys, ["label", "attribute", "value"], ["label", "attribute", "value"])
        & _text_ok(_get(v, "label")) & _text_ok(_get(v, "attribute")) & _text_ok(_get(v, "value"), 2000))
    relation = (
        _within(keys, ["subject", "relation", "object"], ["subject", "relation", "object"])
        & _text_ok(_get(v, "subject")) & _text_ok(_get(v, "relation")) & _text_ok(_get(v, "object")))
    checked = (
        F.when(keys.isNull(), False).when(has("detections"), boxes).when(has("point"), point).when(has("count"), count)
        .when(has("attribute"), attribute).when(has("relation"), relation).otherwise(False))
    return F.coalesce(checked, F.lit(False))


def bbox_corners(bbox: Column, bbox_format: Column) -> Column:
    """``[x1, y1, x2, y2]`` from either box format."""
    return F.when(bbox_format == "xywh", F.array(
        F.get(bbox, F.lit(0)), F.get(bbox, F.lit(1)), F.get(bbox, F.lit(0)) + F.get(bbox, F.lit(2)),
        F.get(bbox, F.lit(1)) + F.get(bbox, F.lit(3)))).otherwise(bbox)


def coordinate_space(x: Column, y: Column) -> Column:
    """Unit coordinates up to 1.5, the 0..1000 grid up to 1000, source pixels beyond."""
    top = F.greatest(F.abs(x), F.abs(y))
    return F.when(top <= 1.5, "unit").when(top <= 1000, "grid").otherwise("pixels")


def to_unit(x: Column, y: Column, width: Column, height: Column) -> Column:
    space = coordinate_space(x, y)
    sx = F.when(space == "unit", F.lit(1.0)).when(space == "grid", F.lit(1000.0)).otherwise(width)
    sy = F.when(space == "unit", F.lit(1.0)).when(space == "grid", F.lit(1000.0)).otherwise(height)
    return F.struct((x / sx).alias("x"), (y / sy).alias("y"))


def camera_matches(atom_camera: Column, camera: Column | str, payload: Column | None = None) -> Column:
    """The atom's own camera decides; without one the legacy camera inside the answer does, else all match."""
    cam = camera if isinstance(camera, Column) else F.lit(camera)
    if payload is None:
        return atom_camera.isNull() | (atom_camera == cam)
    inner = F.get_json_object(payload, "$.camera")
    legacy = inner.isNull() | (inner == "") | (inner == cam)
    boxes = F.from_json(payload, "detections array<struct<camera:string>>")["detections"]
    any_box = F.exists(boxes, lambda d: d["camera"].isNull() | (d["camera"] == "") | (d["camera"] == cam))
    return F.when(atom_camera.isNotNull(), atom_camera == cam).otherwise(F.coalesce(any_box, legacy))


def atom_problem(role: Column, content: Column, style: Column, timestamp: Column, camera: Column, tool_calls: Column) -> Column:
    """First violated annotation rule, or NULL for a valid atom."""
    has_content = F.coalesce(F.length(F.trim(content)) > 0, F.lit(False))
    has_tools = F.coalesce(F.size(tool_calls) > 0, F.lit(False))
    say = F.forall(tool_calls, lambda c: (c["type"] == "function") & (c["function"]["name"] == "say")
                   & F.length(c["function"]["arguments"]["text"]).between(1, 2000))
    return (
        F.when(role.isNull() | ~role.isin(ROLES), "role")
        .when(style.isNotNull() & ~style.isin(PERSISTENT_STYLES + EVENT_STYLES), "style")
        .when(timestamp.isNull() | F.isnan(timestamp) | (timestamp < 0) | (timestamp > 1e9), "timestamp")
        .when(F.length(content) > 16000, "content_length")
        .when(content.contains("\r") | F.contains(content, F.char(F.lit(0))), "content_characters")
        .when(~has_content & ~has_tools, "empty")
        .when(style.isNull() & ((role != "assistant") | ~has_tools | has_content), "speech")
        .when(style.isNotNull() & has_tools, "tool_calls")
        .when(has_tools & ((F.size(tool_calls) > 4) | ~F.coalesce(say, F.lit(False))), "tool_calls")
        .when((style == "vqa") & (camera.isNull() | ~role.isin("user", "assistant")), "vqa_camera")
        .when((style == "vqa") & ~camera.startswith("observation."), "camera_name")
        .when(F.coalesce(style != "vqa", F.lit(True)) & camera.isNotNull(), "camera")
        .when((style == "vqa") & (role == "assistant") & ~vqa_valid(content), "vqa_answer")
    )
