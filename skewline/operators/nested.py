"""Deeply nested image records turned into linked flat tables.

Contract: a payload that is null, isn't valid JSON or doesn't hold an object gives no row; a payload may be a JSON string
that holds the record, once or several times over. Objects lie in ``labels``, ``frames[].objects`` and, at any depth, in
``parts``; an object in place of an array is its element 0; elements that aren't objects are counted but give no row. Of
repeated members the last counts. Members that are missing, null or of another form give nulls. Repeated rows of the
table give repeated rows; ``found_boxes`` gives each (id, path) once. Extra columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.functions.keys import known_key
from skewline.operators.jsonindex import ARR, OBJ, STR, Tape

NAMES = ["labels", "frames", "objects", "parts", "attributes", "weather", "scene", "timeofday", "key", "value", "name", "timestamp", "category", "id", "box2d", "geometry", "x1", "y1", "x2", "y2"]
ATTRIBUTES = ("weather", "scene", "timeofday")
SCHEMAS = {
    "records": "record_id long, name string, timestamp string, weather string, scene string, timeofday string, n_frames long, n_objects long",
    "frames": "record_id long, frame_path string, frame_no int, timestamp string",
    "objects": "record_id long, obj_path string, parent_path string, frame_path string, depth int, category string, object_id string, weather string",
    "labelled": "record_id long, obj_path string, x1 double, y1 double, x2 double, y2 double, weather string, category string, object_id string",
    "boxes": "record_id long, obj_path string, x1 double, y1 double, x2 double, y2 double, weather string",
}
#: texts indexed at once: bounds the memory of a step whatever the length of the batch
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 2000


def _records(texts: list[bytes | None]) -> Iterator[tuple[Tape, np.ndarray, np.ndarray]]:
    """(tape, rows, root tokens) of the texts that hold an object, unwrapping strings that hold a text."""
    rows = np.arange(len(texts))
    while len(rows):
        tape = Tape(texts)
        kinds = tape.kind_of(tape.root)
        is_obj = kinds == OBJ
        yield tape, rows[is_obj], tape.root[is_obj]
        wrapped = np.flatnonzero(kinds == STR)
        texts = [_utf8(tape.string(tape.root[i])) for i in wrapped]
        rows = rows[wrapped]


def _utf8(s: str) -> bytes:
    return s.encode("utf-8", "replace")


def _attributes(tape: Tape, slots: dict[str, np.ndarray], tokens: np.ndarray) -> dict[str, pa.Array]:
    """weather, scene and timeofday (only strings) of attributes given as an object, as key/value entries or as a string of either."""
    kinds = tape.kind_of(tokens)
    value = {a: np.where(kinds == OBJ, slots[a][np.where(kinds == OBJ, tokens, -1)], -1) for a in ATTRIBUTES}
    who, _, entry = tape.elements(np.where(kinds == ARR, tokens, -1))
    if len(who):
        key = np.array(tape.texts(slots["key"][entry], strings_only=True).to_pylist(), object)
        for a in ATTRIBUTES:
            mine = np.flatnonzero(key == a)
            # of repeated entries the last counts
            last = mine[np.append(who[mine][1:] != who[mine][:-1], True)] if len(mine) else mine
            value[a][who[last]] = slots["value"][entry[last]]
    out = {a: tape.texts(v, strings_only=True) for a, v in value.items()}
    held = np.flatnonzero(kinds == STR)
    if len(held):
        inner = Tape([_utf8(tape.string(t)) for t in tokens[held]])
        there = np.zeros(len(tokens), bool)
        there[held] = True
        for a, x in _attributes(inner, inner.name_keys(NAMES), inner.root).items():
            out[a] = pc.replace_with_mask(out[a], pa.array(there), x)
    return out


def _boxes(tape: Tape, slots: dict[str, np.ndarray], objects: np.ndarray) -> np.ndarray:
    """(objects, 4): the usable box of each object or of its geometry, NaN where there is none."""
    out = np.full((len(objects), 4), np.nan)
    geometry = slots["geometry"][objects]
    geometry = np.where(tape.kind_of(geometry) == OBJ, geometry, -1)
    for holder in (geometry, objects):  # the object's own box is taken if it is usable
        box = slots["box2d"][holder]
        kinds = tape.kind_of(box)
        members = np.stack([slots[m][np.where(kinds == OBJ, box, -1)] for m in ("x1", "y1", "x2", "y2")], 1)
        members = np.where((kinds == ARR)[:, None], tape.items(np.where(kinds == ARR, box, -1), 4), members)
        full = np.flatnonzero((members >= 0).all(1))
        xy = tape.numbers(members[full].ravel()).reshape(-1, 4)
        good = np.isfinite(xy).all(1) & (xy[:, 0] < xy[:, 2]) & (xy[:, 1] < xy[:, 3])
        out[full[good]] = xy[good]
    return out


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _numbered(path: pa.Array, idx: np.ndarray) -> pa.Array:
    return _joined(path, "[", pa.array(idx).cast(pa.string()), "]")


def _flatten(texts: list[bytes | None], table: str) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
    """(rows of the batch, the table's other columns), whole arrays at a time."""
    for tape, rows, roots in _records(texts):
        if not len(rows):
            continue
        slots = tape.name_keys(NAMES)
        attrs = _attributes(tape, slots, slots["attributes"][roots])
        f_who, f_idx, f_tok = tape.elements(slots["frames"][roots])
        f_path = _numbered(pa.array(["frames"] * len(f_who), pa.string()), f_idx)
        if table == "frames":
            yield rows[f_who], {"frame_path": f_path, "frame_no": pa.array(f_idx, pa.int32()), "timestamp": tape.texts(slots["timestamp"][f_tok])}
            continue
        # containers of objects: place of the record, path of the container and of its parent, frame, token
        rec = np.concatenate([np.arange(len(roots)), f_who])
        none = pa.nulls(len(roots), pa.string())
        path = pa.concat_arrays([pa.array(["labels"] * len(roots), pa.string()), _joined(f_path, ".objects")])
        frame = pa.concat_arrays([none, f_path])
        above = frame
        held = np.concatenate([slots["labels"][roots], slots["objects"][f_tok]])
        n_objects = np.zeros(len(roots), np.int64)
        depth = 0
        while len(held):
            who, idx, tok = tape.elements(held)
            r = rec[who]
            n_objects += np.bincount(r, minlength=len(roots))
            at = pa.array(who)
            paths = _numbered(path.take(at), idx)
            frames, parents = frame.take(at), above.take(at)
            if table in ("boxes", "labelled"):
                box = _boxes(tape, slots, tok)
                j = np.flatnonzero(~np.isnan(box[:, 0]))
                cols = {"obj_path": paths.take(pa.array(j)), **{n: pa.array(box[j, i]) for i, n in enumerate(("x1", "y1", "x2", "y2"))}, "weather": attrs["weather"].take(pa.array(r[j]))}
                if table == "labelled":
                    cols |= {"category": tape.texts(slots["category"][tok[j]]), "object_id": tape.texts(slots["id"][tok[j]])}
                yield rows[r[j]], cols
            elif table == "objects":
                cols = {"obj_path": paths, "parent_path": parents, "frame_path": frames, "depth": pa.array(np.full(len(tok), depth, np.int32))}
                yield rows[r], cols | {"category": tape.texts(slots["category"][tok]), "object_id": tape.texts(slots["id"][tok]), "weather": attrs["weather"].take(pa.array(r))}
            parts = slots["parts"][tok]
            has = np.flatnonzero(parts >= 0)
            rec, held = r[has], parts[has]
            frame, above = frames.take(pa.array(has)), paths.take(pa.array(has))
            path = _joined(above, ".parts")
            depth += 1
        if table == "records":
            cols = {"name": tape.texts(slots["name"][roots]), "timestamp": tape.texts(slots["timestamp"][roots]), **attrs}
            yield rows, cols | {"n_frames": pa.array(np.bincount(f_who, minlength=len(roots))), "n_objects": pa.array(n_objects)}


def flatten(df: DataFrame, table: str, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """One of the flat tables ``records``, ``frames``, ``objects``, ``boxes`` (usable boxes) and ``labelled`` (these with category and id) of the records in ``payload``."""
    schema = SCHEMAS[table]
    from pyspark.sql.types import StructType

    arrow = pa.schema([pa.field(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).cast(pa.binary()).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and stop - start < CHUNK_ROWS and (size < CHUNK_BYTES or stop == start):
                    size += len(texts[stop] or b"")
                    stop += 1
                for rows, cols in _flatten(texts[start:stop], table):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[start:stop][rows], pa.int64()), *(cols[f.name].cast(f.type) for f in list(arrow)[1:])], schema=arrow)
                start = stop

    src = df.where(F.col(record_id).isNotNull() & F.col(payload).isNotNull())
    return src.select(F.col(record_id).cast("long").alias("record_id"), F.col(payload).cast("string").alias("payload")).mapInArrow(run, schema)


def found_boxes(df: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """Distinct usable boxes of records whose weather is known (a string other than blank or ``undefined``)."""
    boxes = flatten(df, "boxes", record_id, payload)
    return boxes.where(known_key(F.col("weather"), "undefined").isNotNull()).dropDuplicates(["record_id", "obj_path"])


def reference_rows(texts: list[str | None]) -> list[tuple]:
    """Plain recursive reading of the same rules, for tests: (row, obj_path, box or None, weather)."""
    def number(x):
        if isinstance(x, bool) or x is None:
            return np.nan
        if isinstance(x, str):
            from skewline.operators.jsonindex import NUMBER

            return float(x) if NUMBER.fullmatch(x.encode()) else np.nan
        return float(x) if isinstance(x, (int, float)) else np.nan

    def strict(x):
        raise ValueError(x)

    def usable(b):
        xs = [number(b.get(k)) for k in ("x1", "y1", "x2", "y2")] if isinstance(b, dict) else [number(x) for x in b] if isinstance(b, list) and len(b) == 4 else []
        return xs if len(xs) == 4 and np.isfinite(xs).all() and xs[0] < xs[2] and xs[1] < xs[3] else None

    def load(s):
        while isinstance(s, str):
            try:
                s = json.loads(s, parse_constant=strict)
            except ValueError:
                return None
        return s

    out = []

    def walk(row, items, path, weather):
        for i, o in enumerate(items if isinstance(items, list) else [items] if isinstance(items, dict) else []):
            if isinstance(o, dict):
                g = o.get("geometry")
                out.append((row, f"{path}[{i}]", usable(o.get("box2d")) or (usable(g.get("box2d")) if isinstance(g, dict) else None), weather))
                walk(row, o.get("parts"), f"{path}[{i}].parts", weather)

    for row, text in enumerate(texts):
        r = load(text)
        if not isinstance(r, dict):
            continue
        a = load(r["attributes"]) if isinstance(r.get("attributes"), str) else r.get("attributes")
        if isinstance(a, list):
            a = {e["key"]: e.get("value") for e in a if isinstance(e, dict) and isinstance(e.get("key"), str)}
        w = a.get("weather") if isinstance(a, dict) else None
        w = w if isinstance(w, str) else None
        walk(row, r.get("labels"), "labels", w)
        fs = r.get("frames")
        for i, f in enumerate(fs if isinstance(fs, list) else [fs] if isinstance(fs, dict) else []):
            if isinstance(f, dict):
                walk(row, f.get("objects"), f"frames[{i}].objects", w)
    return out
