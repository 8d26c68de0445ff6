"""Detections against ground truth: matching, metrics per image and class, chip scores, feature joins."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.functions.boxes import at, is_valid
from skewline.functions.near import corners, gaps, leaves
from skewline.operators.ranks import dense
from skewline.session import cut


class DetectionTables(NamedTuple):
    """Metrics per image and class, and both inputs with how each row was matched."""

    metrics: DataFrame
    detections: DataFrame
    ground_truth: DataFrame


def _need(df: DataFrame, cols: tuple[str, ...], what: str) -> None:
    lost = [c for c in cols if c not in df.columns]
    if lost:
        raise ValueError(f"{what} lack the columns {lost}")


def _class_name(df: DataFrame, names: dict[int, str] | None) -> Column:
    if "class_name" in df.columns:
        return F.col("class_name")
    if not names:
        return F.lit(None).cast("string")
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(int(k)), F.lit(v))])
    return known[F.col("class_id").cast("int")]


def _prepare(df: DataFrame, what: str, id_col: str, prefix: str, order: str | None, names, detector_name=None, dataset_name=None) -> DataFrame:
    _need(df, ("image_id", "class_id", "bbox"), what)
    if order is None and id_col not in df.columns:
        raise ValueError(f"{what} need an {id_col} column or an order column")
    pos = F.col(order).cast("long") if order else F.xxhash64(id_col)
    if id_col not in df.columns:
        df = dense(df, [], order, "_number")
    given = F.col(id_col).cast("string") if id_col in df.columns else F.concat(F.lit(prefix), F.col("_number"))
    box = F.when(is_valid(F.col("bbox")), F.col("bbox").cast("array<double>")).otherwise(F.raise_error(F.lit("a box must have four values and positive sides")))
    cols = [F.col("image_id"), F.col("class_id").cast("int").alias("class_id"), _class_name(df, names).alias("class_name"), box.alias("bbox"), given.alias(id_col), pos.alias("ord")]
    if prefix == "det_":
        conf = F.expr("try_cast(confidence AS double)") if "confidence" in df.columns else F.lit(None).cast("double")
        cols.append(conf.alias("confidence"))
        cols.append((F.lit(detector_name) if detector_name else F.col("detector_name") if "detector_name" in df.columns else F.lit(None)).cast("string").alias("detector_name"))
    cols.append((F.lit(dataset_name) if dataset_name else F.col("dataset_name") if "dataset_name" in df.columns else F.lit(None)).cast("string").alias("dataset_name"))
    # keys that are null belong to no image or class
    return df.where(F.col("image_id").isNotNull() & F.col("class_id").isNotNull()).select(*cols)


def prepare_predictions(df: DataFrame, order: str | None = None, class_names: dict[int, str] | None = None, detector_name: str | None = None, dataset_name: str | None = None) -> DataFrame:
    """Typed detections with ids, places and confidence (what isn't a number is null)."""
    return _prepare(df, "predictions", "detection_id", "det_", order, class_names, detector_name, dataset_name)


def prepare_ground_truth(df: DataFrame, order: str | None = None, class_names: dict[int, str] | None = None, dataset_name: str | None = None) -> DataFrame:
    return _prepare(df, "ground truth", "gt_id", "gt_", order, class_names, None, dataset_name)


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(a[:, None, 2], b[:, 2]) - np.maximum(a[:, None, 0], b[:, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[:, 3]) - np.maximum(a[:, None, 1], b[:, 1]), 0, None)
    inter = w * h
    area = lambda m: (m[:, 2] - m[:, 0]) * (m[:, 3] - m[:, 1])
    union = area(a)[:, None] + area(b) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


#: pairs of a group that are compared as one matrix; boxes that one call matches, about
_MATRIX, _PACK = 4_000_000, 20_000


def greedy(det: np.ndarray, conf: np.ndarray, det_ord: np.ndarray, gt: np.ndarray, gt_ord: np.ndarray, gt_id: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gt of each detection or -1, its IoU, detection of each gt or -1, its IoU).

    Detections go by confidence descending, missing last, then place; each takes the free gt with the greatest IoU that
    reaches the threshold (ties: the later place). A detection without one keeps its greatest IoU over all gt, a gt
    without one its greatest over all detections. Ground truth rows of one id are free or taken together.
    """
    hit, own, back, best = np.full(len(det), -1), np.zeros(len(det)), np.full(len(gt), -1), np.zeros(len(gt))
    if not len(det) or not len(gt):
        return hit, own, back, best
    # a crowded group is gone through row by row, so memory stays at one side's size
    m = _iou_matrix(det, gt) if len(det) * len(gt) <= _MATRIX else None
    free, most = np.ones(len(gt), bool), np.zeros(len(gt))
    _, same = np.unique(gt_id.astype(str), return_inverse=True)
    by = np.lexsort((gt_ord, np.zeros(len(gt))))[::-1]  # later places first, so argmax prefers them
    for d in np.lexsort((det_ord, -np.nan_to_num(conf, nan=-np.inf))):
        all_ = m[d] if m is not None else _iou_matrix(det[d : d + 1], gt)[0]
        np.maximum(most, all_, out=most)
        row = np.where(free & (all_ >= threshold), all_, -1.0)[by]
        g = by[row.argmax()]
        if row.max() >= 0:
            hit[d], own[d] = g, all_[g]
            taken = same == same[g]
            back[taken], best[taken] = d, all_[g]
            free &= ~taken
        else:
            own[d] = all_.max()
    miss = back < 0
    best[miss] = most[miss]
    return hit, own, back, best


def match(det: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of both sides with side, key, status, other and iou: a fold over each (image, class), which are groups of boxes of one image.

    Only keys, boxes and confidences are shuffled. A call takes many groups, those of one hash, about ``_PACK`` boxes.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("iou_threshold must be in [0, 1]")
    side = lambda d, i, c: d.select("image_id", "class_id", F.col(i).alias("key"), "ord", c.alias("conf"), "bbox")
    a = side(det, "detection_id", F.col("confidence"))
    b = side(gt, "gt_id", F.lit(None).cast("double"))

    packs = max(1, -(-(det.count() + gt.count()) // _PACK))
    pack = F.pmod(F.xxhash64("image_id", "class_id"), F.lit(packs)).alias("pack")
    a, b = a.withColumn("pack", pack), b.withColumn("pack", pack)

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        codes: dict[tuple, int] = {}
        sides = []
        for t in (left, right):
            code = np.array([codes.setdefault(k, len(codes)) for k in zip(t.column("image_id").to_pylist(), t.column("class_id").to_pylist())], np.int64)
            order = np.lexsort((np.array(t.column("key").to_pylist(), str), t.column("ord").to_numpy(), code)) if len(code) else code
            t = t.take(pa.array(order))
            box = t.column("bbox").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4) if len(code) else np.zeros((0, 4))
            sides.append((t, code[order], box, t.column("ord").to_numpy(), np.array(t.column("key").to_pylist(), object)))
        (left, dc, dbox, dord, dk), (right, gc, gbox, gord, gk) = sides
        conf = left.column("conf").to_numpy().astype(float) if left.num_rows else np.zeros(0)
        every = np.arange(len(codes) + 1)
        da, ga = np.searchsorted(dc, every), np.searchsorted(gc, every)
        hit, own, back, best = np.full(len(dk), -1), np.zeros(len(dk)), np.full(len(gk), -1), np.zeros(len(gk))
        for g in range(len(codes)):
            d, q = slice(da[g], da[g + 1]), slice(ga[g], ga[g + 1])
            if d.start == d.stop or q.start == q.stop:
                continue
            h, own[d], b, best[q] = greedy(dbox[d], conf[d], dord[d], gbox[q], gord[q], gk[q], threshold)
            hit[d], back[q] = np.where(h >= 0, h + q.start, -1), np.where(b >= 0, b + d.start, -1)
        both = lambda c: pa.concat_arrays([left.column(c).combine_chunks(), right.column(c).combine_chunks()])
        return pa.table({
            "image_id": both("image_id"), "class_id": both("class_id"), "side": pa.array(["det"] * len(dk) + ["gt"] * len(gk)), "key": both("key"), "ord": both("ord"),
            "status": pa.array(np.concatenate([np.where(hit >= 0, "TP", "FP"), np.where(back >= 0, "TP", "FN")]).astype(object), pa.string()),
            "other": pa.array([gk[h] if h >= 0 else None for h in hit] + [dk[h] if h >= 0 else None for h in back], pa.string()),
            "iou": pa.array(np.concatenate([own, best])),
        })

    kind = dict(det.dtypes)["image_id"]
    return a.groupBy("pack").cogroup(b.groupBy("pack")).applyInArrow(fold, f"image_id {kind}, class_id int, side string, key string, ord long, status string, other string, iou double")


def enrich(det: DataFrame, gt: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Both tables with match_status, iou and the id of the match."""
    m = cut(match(det, gt, threshold), "matches")  # both sides read it: the fold runs once
    on = ["image_id", "class_id", "ord"]
    d = det.join(m.where("side = 'det'").select(*on, F.col("key").alias("detection_id"), F.col("status").alias("match_status"), F.col("other").alias("matched_gt_id"), "iou"), [*on, "detection_id"])
    g = gt.join(m.where("side = 'gt'").select(*on, F.col("key").alias("gt_id"), F.col("status").alias("match_status"), F.col("other").alias("matched_detection_id"), "iou"), [*on, "gt_id"])
    return d, g


def image_class_metrics(det: DataFrame, gt: DataFrame, low_precision: float = 0.5, low_recall: float = 0.5, detector_name: str | None = None, dataset_name: str | None = None) -> DataFrame:
    """One row per image and class of either side: counts, precision, recall, F1, failure flags, confidences, names."""
    keys = ["image_id", "class_id"]
    st = F.col("match_status")
    conf = F.col("confidence")
    lost = F.bool_or(conf.isNull() | F.isnan(conf))  # one missing confidence makes the group's unknown
    stat = lambda f: F.when(lost, F.lit(None)).otherwise(f(conf))
    d = det.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_detections"), F.count_if(st == "TP").alias("tp"), F.count_if(st == "FP").alias("fp"),
        stat(F.avg).alias("mean_detection_confidence"), stat(F.max).alias("max_detection_confidence"), stat(F.min).alias("min_detection_confidence"),
        F.min_by("class_name", F.when(F.col("class_name").isNotNull(), F.col("ord"))).alias("dn"), F.min_by("detector_name", F.when(F.col("detector_name").isNotNull(), F.col("ord"))).alias("det_name"), F.min_by("dataset_name", F.when(F.col("dataset_name").isNotNull(), F.col("ord"))).alias("dset"),
    )
    g = gt.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_gt"), F.count_if(st == "FN").alias("fn"), F.min_by("class_name", F.when(F.col("class_name").isNotNull(), F.col("ord"))).alias("gn"), F.min_by("dataset_name", F.when(F.col("dataset_name").isNotNull(), F.col("ord"))).alias("gset"))
    j = d.join(g, keys, "full_outer").fillna(0, ["num_detections", "tp", "fp", "num_gt", "fn"])
    p, r = F.try_divide("tp", "num_detections"), F.try_divide("tp", "num_gt")
    f1 = F.when(p.isNull() | r.isNull(), F.lit(None)).when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return j.select(
        *keys, F.coalesce("gn", "dn").alias("class_name"), "num_gt", "num_detections", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
        ((F.col("fp") > 0) | (F.col("fn") > 0)).alias("has_failure"), (F.col("fn") > 0).alias("missed_object"), (F.col("fp") > 0).alias("false_positive"),
        (p < F.lit(float(low_precision))).alias("low_precision"), (r < F.lit(float(low_recall))).alias("low_recall"),
        "mean_detection_confidence", "max_detection_confidence", "min_detection_confidence",
        (F.lit(detector_name) if detector_name is not None else F.col("det_name")).alias("detector_name"), (F.lit(dataset_name) if dataset_name is not None else F.coalesce("gset", "dset")).alias("dataset_name"),
    )


def evaluate_detection(pred: DataFrame, gt: DataFrame, iou_threshold: float = 0.5, backend: str = "simple", order: str | None = None, gt_order: str | None = None, class_names: dict[int, str] | None = None, detector_name: str | None = None, dataset_name: str | None = None, low_precision: float = 0.5, low_recall: float = 0.5) -> DetectionTables:
    """Prepare, match, aggregate. Backends other than ``simple`` and ``auto`` (the same here) are a ValueError."""
    if backend not in ("simple", "auto"):
        raise ValueError("backend must be simple or auto")
    if not 0 <= iou_threshold <= 1:
        raise ValueError("iou_threshold must be in [0, 1]")
    d, g = prepare_predictions(pred, order, class_names, detector_name, dataset_name), prepare_ground_truth(gt, gt_order, class_names, dataset_name)
    d, g = enrich(d, g, iou_threshold)
    return DetectionTables(image_class_metrics(d, g, low_precision, low_recall, detector_name, dataset_name), d, g)


def aggregate_chip_scores(det: DataFrame, score: str = "chip_ood_score") -> DataFrame:
    """Per image and class: mean, max, 90th percentile, deviation and number of the finite scores."""
    _need(det, ("image_id", "class_id", score), "detections")
    s = F.col(score).cast("double")
    d = det.where("image_id is not null and class_id is not null").select("image_id", F.col("class_id").cast("int").alias("class_id"), F.when(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")), s).alias("s"))
    return d.groupBy("image_id", "class_id").agg(F.avg("s").alias("chip_ood_mean"), F.max("s").alias("chip_ood_max"), F.percentile("s", 0.9).alias("chip_ood_p90"), F.stddev_pop("s").alias("chip_ood_std"), F.count("s").alias("num_chips"))


def attach_ood_features(metrics: DataFrame, global_scores: DataFrame | None = None, det: DataFrame | None = None, global_col: str = "global_ood_score", chip_col: str = "chip_ood_score", order: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Left joins of global scores (the first of each image by ``order``) and chip aggregates; missing chips count 0; constant name columns."""
    out = metrics
    if global_scores is not None:
        _need(global_scores, ("image_id", global_col), "global scores")
        first = F.min_by(global_col, order) if order else F.min(global_col)
        out = out.join(global_scores.groupBy("image_id").agg(first.cast("double").alias(global_col)), "image_id", "left")
    if det is not None:
        out = out.join(aggregate_chip_scores(det, chip_col), ["image_id", "class_id"], "left").withColumn("num_chips", F.coalesce("num_chips", F.lit(0).cast("long")))
    for k, v in (names or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


def detection_chips(det: DataFrame, images: DataFrame, order: str = "ord") -> DataFrame:
    """image_pos, image_id, image_path, boxes, labels, detection_ids: one row per image in order of first appearance; an image without a path is an error."""
    _need(images, ("image_id", "image_path"), "images")
    a = det.where("image_id is not null").groupBy("image_id").agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("bbox"), F.col("class_id"), F.col("detection_id")))).alias("r"))
    j = a.join(images.select("image_id", "image_path", *[c for c in ("image_width", "image_height") if c in images.columns]).dropDuplicates(["image_id"]), "image_id", "left")
    path = F.coalesce("image_path", F.raise_error(F.concat(F.lit("no path for image "), F.col("image_id").cast("string"))))
    return j.select("first", "image_id", path.alias("image_path"), F.col("r.bbox").alias("boxes"), F.col("r.class_id").alias("labels"), F.col("r.detection_id").alias("detection_ids"), *[c for c in ("image_width", "image_height") if c in images.columns])


def remap_classes(pred: DataFrame, mapping: DataFrame, name: str = "class_name") -> DataFrame:
    """Detections whose name is in the mapping (class_name, new_name, new_id), with the new names and ids."""
    return pred.drop("class_id").join(F.broadcast(mapping), name).drop(name).withColumnRenamed("new_name", name).withColumnRenamed("new_id", "class_id")


#: boxes that one call compares, about; pairs of boxes in one step; boxes of a leaf: chips, labels
_NEAR, _STEP, _CHIPS, _LABELS = 20_000, 1_000_000, 512, 64


def _sum4(d: np.ndarray) -> np.ndarray:
    return d[..., 0] + d[..., 1] + d[..., 2] + d[..., 3]


def _pair_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``functions.boxes.iou`` of rows of boxes."""
    w = np.maximum(np.fmin(a[:, 2], b[:, 2]) - np.fmax(a[:, 0], b[:, 0]), 0)
    h = np.maximum(np.fmin(a[:, 3], b[:, 3]) - np.fmax(a[:, 1], b[:, 1]), 0)
    inter = w * h
    area = lambda m: np.maximum(m[:, 2] - m[:, 0], 0) * np.maximum(m[:, 3] - m[:, 1], 0)
    union = area(a) + area(b) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=~(union <= 0))


def _same(image: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct image and box, by image; for each row the number of its own)."""
    bits = (box + 0.0).view(np.int64)
    order = np.lexsort((*bits.T, image))
    image, bits = image[order], bits[order]
    new = np.append(True, (image[1:] != image[:-1]) | (bits[1:] != bits[:-1]).any(1))[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _least(chip: np.ndarray, l1: np.ndarray, iou: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the best candidate of each chip: least distance, greatest IoU, least label."""
    order = np.lexsort((label, -iou, l1, chip))
    return order[np.append(True, np.diff(chip[order]) != 0)[: len(order)]]


def _nearest_of_all(a: np.ndarray, b: np.ndarray, got: tuple, chips: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Compares each of ``chips`` with its labels, those from ``start`` to ``end``."""
    n, done = end - start, 0
    while done < len(chips):
        upto = max(done + 1, np.searchsorted(np.cumsum(n[done:]), _STEP, "right") + done)
        if n[done] > _STEP:  # labels in steps as well: memory stays linear in them
            parts = [(np.full(min(_STEP, end[done] - s), chips[done]), np.arange(s, min(s + _STEP, end[done]))) for s in range(start[done], end[done], _STEP)]
        else:
            c, k = chips[done:upto], n[done:upto]
            parts = [(np.repeat(c, k), np.repeat(start[done:upto] - np.cumsum(k) + k, k) + np.arange(k.sum()))]
        for c, g in parts:
            _keep(got, c, g, _sum4(np.abs(a[c] - b[g])), _pair_iou(a[c], b[g]))
        done = upto


def _keep(got: tuple, chip: np.ndarray, label: np.ndarray, l1: np.ndarray, iou: np.ndarray) -> None:
    """Enters candidates where they are better than what a chip has."""
    best_label, best_l1, best_iou = got
    had = np.unique(chip)
    had = had[best_label[had] >= 0]
    chip, label, l1, iou = (np.concatenate(x) for x in ((chip, had), (label, best_label[had]), (l1, best_l1[had]), (iou, best_iou[had])))
    best = _least(chip, l1, iou, label)
    c = chip[best]
    best_label[c], best_l1[c], best_iou[c] = label[best], l1[best], iou[best]


def _nearest_by_leaf(a: np.ndarray, b: np.ndarray, got: tuple, chips: np.ndarray, labels: np.ndarray) -> None:
    """The same for the finite chips and labels of one image, without the leaves that lie farther than what is found."""
    groups = [labels[r] for r in leaves(b[labels], _LABELS)]
    low, high = corners(b, groups)
    for r in leaves(a[chips], _CHIPS):
        c = chips[r]
        best = np.full(len(c), np.inf)
        q = a[c]
        apart = _sum4(gaps(q.min(0), q.max(0), low, high))
        for v in np.argsort(apart, kind="stable"):
            if apart[v] > best.max():
                break
            near = np.flatnonzero(_sum4(gaps(q, q, low[v], high[v])) <= best)
            if not len(near):
                continue
            d = _sum4(np.abs(q[near][:, None] - b[groups[v]]))
            least = d.min(1)
            tie = (d == least[:, None]) & (least <= best[near])[:, None]
            i, j = np.nonzero(tie)
            best[near] = np.minimum(best[near], least)
            if len(i):
                i, j, l1 = c[near[i]], groups[v][j], d[i, j]
                _keep(got, i, j, l1, _pair_iou(a[i], b[j]))


def _boxes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Boxes and which of them have a null."""
    cols = [t.column(f"b{i}") for i in range(4)]
    return np.column_stack([c.to_numpy() for c in cols]).astype(float), np.any([c.is_null().to_numpy() for c in cols], axis=0)


def _numbers(c: pa.ChunkedArray) -> np.ndarray:
    """Equal values have equal numbers, null one of its own."""
    return c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)


def nearest(chip_image: np.ndarray, a: np.ndarray, label_image: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the nearest label or -1, its L1 distance, its IoU) of each chip; labels come in the order that decides ties.

    Equal boxes of an image are compared once. Where pairs are few all are compared, in crowded images leaf by leaf.
    """
    own, number = _same(chip_image, a)
    first, _ = _same(label_image, b)
    # of equal boxes the first stands for all; the others are in the order of their rows within an image
    first = first[np.lexsort((first, label_image[first]))]
    a, ci, b, li = a[own], chip_image[own], b[first], label_image[first]
    got = np.full(len(a), -1), np.full(len(a), np.nan), np.zeros(len(a))
    start, end = np.searchsorted(li, ci), np.searchsorted(li, ci, "right")
    fa, fb = np.isfinite(a).all(1), np.isfinite(b).all(1)
    good = np.append(0, np.cumsum(fb))
    # what isn't finite comes last in any order: only chips that have nothing else meet it
    plain = fa & (good[end] > good[start])
    labels_of = end - start
    images, at, chips_of = np.unique(ci, return_index=True, return_counts=True)
    crowded = np.zeros(len(a), bool)
    for p, n in zip(at, chips_of):
        if labels_of[p] > 4 * _LABELS and n * labels_of[p] > _STEP // 4:
            c = np.arange(p, p + n)[plain[p : p + n]]
            crowded[c] = True
            if len(c):
                _nearest_by_leaf(a, b, got, c, np.arange(start[p], end[p])[fb[start[p] : end[p]]])
    rest = np.flatnonzero(~crowded & (labels_of > 0))
    _nearest_of_all(a, b, got, rest, start[rest], end[rest])
    label, l1, iou = (x[number] for x in got)
    return np.where(label >= 0, first[np.maximum(label, 0)] if len(first) else -1, -1), l1, iou


def nearest_label(chips: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each chip the label of its image with the least L1 distance, then the greatest IoU, then the least label id.

    Each side is shuffled once; a call takes the boxes of many images, those of one hash, about ``_NEAR`` boxes.
    """
    side = lambda d, i: d.where("image_id is not null").select("image_id", i, *[at(F.col("box"), k).alias(f"b{k}") for k in range(4)])
    a, b = side(chips, "chip_idx"), side(labels, "label_id")
    packs = max(1, -(-(a.count() + b.count()) // _NEAR))
    pack = F.pmod(F.xxhash64("image_id"), F.lit(packs)).alias("pack")
    a, b = a.withColumn("pack", pack), b.withColumn("pack", pack)

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("label_id")
        both = pa.chunked_array([*left.column("image_id").chunks, *right.column("image_id").chunks], left.schema.field("image_id").type)
        code, n = _numbers(both), left.num_rows
        (box, lost), (label_box, label_lost) = _boxes(left), _boxes(right)
        label, l1, iou = nearest(code[:n], box, code[n:], label_box)
        # rows of one chip id in an image count as one chip
        found = np.flatnonzero(label >= 0)
        one = found[_least((code[:n] * (n + 1) + _numbers(left.column("chip_idx")))[found], l1[found], iou[found], label[found])]
        lost = lost[one] | label_lost[label[one]]
        return pa.table({
            "image_id": left.column("image_id").take(one), "chip_idx": left.column("chip_idx").take(one), "label_id": right.column("label_id").take(label[one]),
            "l1": pa.array(l1[one], mask=lost), "iou": pa.array(np.where(lost, 0.0, iou[one])),
        })

    of = lambda d, c: dict(d.dtypes)[c]
    return a.groupBy("pack").cogroup(b.groupBy("pack")).applyInArrow(fold, f"image_id {of(chips, 'image_id')}, chip_idx {of(chips, 'chip_idx')}, label_id {of(labels, 'label_id')}, l1 double, iou double")
