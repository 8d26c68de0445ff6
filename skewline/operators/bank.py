"""Score bank: one row per sample, one float column per detector, with labels, classes, groups and metrics beside."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.session import cut

ID, LABEL, CLASS, GROUP = "sample_id", "ood", "class_id", "grp"


@dataclass(frozen=True)
class ScoreBank:
    """A wide table with ``sample_id`` and the columns named here. Immutable: ``add`` gives a new bank."""

    df: DataFrame
    detectors: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    class_names: tuple[str, ...] | None = None

    @classmethod
    def of(cls, df: DataFrame, scores: dict[str, str] | None = None, metrics: dict[str, str] | None = None, sample_id: str = ID, ood: str | None = None, class_id: str | None = None, group: str | None = None, class_names: list[str] | None = None) -> ScoreBank:
        """A bank from columns of one table: scores and metrics by name, kept as floats; labels as ints."""
        cols = [F.col(sample_id).alias(ID)]
        if ood:
            cols.append(F.col(ood).cast("int").alias(LABEL))
        if class_id:
            cols.append(F.col(class_id).cast("int").alias(CLASS))
        if group:
            cols.append(F.col(group).cast("string").alias(GROUP))
        scores, metrics = scores or {}, metrics or {}
        cols += [F.col(c).cast("float").alias(n) for n, c in {**scores, **metrics}.items()]
        return cls(df.select(*cols), tuple(scores), tuple(metrics), tuple(class_names) if class_names else None)

    def _need(self, column: str, what: str) -> None:
        if column not in self.df.columns:
            raise ValueError(f"the bank has no {what}")

    def saved(self) -> ScoreBank:
        """The bank as a table in the shared folder: scores are computed once."""
        return replace(self, df=cut(self.df, "bank"))

    def _with(self, name: str, scores: DataFrame, column: str, sample_id: str) -> DataFrame:
        """The bank with a column more; every sample must have exactly one row (ValueError else)."""
        right = scores.select(F.col(sample_id).alias(ID), F.col(column).cast("float").alias(name))
        rows = right.groupBy(ID).agg(F.count(F.lit(1)).alias("_r"))
        odd = self.df.select(ID, F.lit(1).alias("_b")).join(rows, ID, "full_outer").where("_b is null or _r is null or _r > 1").limit(3).collect()
        if odd:
            raise ValueError(f"{name} must have one row for each sample: {[r[ID] for r in odd]} lack one or have others")
        return self.df.drop(name).join(right, ID)

    def add(self, name: str, scores: DataFrame, column: str = "score", sample_id: str = ID) -> ScoreBank:
        """Adds or replaces a detector's scores, joined on the sample."""
        return replace(self, df=self._with(name, scores, column, sample_id), detectors=tuple(dict.fromkeys((*self.detectors, name))))

    def add_metric(self, name: str, values: DataFrame, column: str = "value", sample_id: str = ID) -> ScoreBank:
        return replace(self, df=self._with(name, values, column, sample_id), metrics=tuple(dict.fromkeys((*self.metrics, name))))

    @property
    def n_samples(self) -> int:
        if not self.detectors and not self.metrics:
            raise ValueError("the bank is empty")
        return self.df.count()

    def classes(self) -> DataFrame:
        self._need(CLASS, "class labels")
        return self.df.select(CLASS).where(F.col(CLASS).isNotNull()).distinct().orderBy(CLASS)

    def groups(self) -> DataFrame:
        self._need(GROUP, "groups")
        return self.df.select(GROUP).where(F.col(GROUP).isNotNull()).distinct().orderBy(GROUP)

    def scores_for(self, name: str) -> DataFrame:
        if name not in self.detectors:
            raise KeyError(name)
        return self.df.select(ID, name)

    def metric_for(self, name: str) -> DataFrame:
        if name not in self.metrics:
            raise KeyError(name)
        return self.df.select(ID, name)

    def by_class(self, cls: int | str) -> ScoreBank:
        self._need(CLASS, "class labels")
        if isinstance(cls, str):
            if not self.class_names:
                raise ValueError("the bank has no class names")
            if cls not in self.class_names:
                raise KeyError(cls)
            cls = self.class_names.index(cls)
        return replace(self, df=self.df.where(F.col(CLASS) == int(cls)))

    def by_group(self, group: str) -> ScoreBank:
        self._need(GROUP, "groups")
        return replace(self, df=self.df.where(F.col(GROUP) == group))

    def subset(self, ids: list[int]) -> ScoreBank:
        """Gathers samples by id; order and repeats stay, and the new ``sample_id`` is the place in the list. A boolean mask is refused."""
        if any(isinstance(i, bool) for i in ids):
            raise ValueError("give sample ids, not a mask; filter with a condition instead")
        want = self.df.sparkSession.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "pos long, i long")
        got = F.broadcast(want).join(self.df, F.col("i") == F.col(ID)).drop("i", ID).withColumnRenamed("pos", ID)
        return replace(self, df=got.select(self.df.columns))

    def where(self, condition) -> ScoreBank:
        return replace(self, df=self.df.where(condition))

    def long(self, *keep: str) -> DataFrame:
        """(sample_id, detector, score, then ``keep`` or whatever labels there are)."""
        if not self.detectors:
            raise ValueError("the bank has no detectors")
        keep = tuple(k for k in keep if k != ID) if keep else tuple(c for c in (LABEL, CLASS, GROUP) if c in self.df.columns)
        return self.df.select(ID, *keep, *self.detectors).unpivot([ID, *keep], list(self.detectors), "detector", "score")

    def __repr__(self) -> str:
        return f"ScoreBank(detectors={list(self.detectors)}, metrics={list(self.metrics)}, columns={self.df.columns})"
