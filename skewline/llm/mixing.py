"""Mixing sources to target weights.

Contract: sources are equal by trimmed lower-case key; documents whose source is null, blank or not among the targets
take no part; a source is repeated at most ``max_repeats`` times (null: once); a source with no tokens reaches a share of
0; a share that is null or not positive asks for nothing; documents without tokens take the rate of their source like any
other. ``total_tokens`` is the size wanted (by default the tokens of all targeted sources): what capped sources can't
give is asked of the others in proportion to their targets. Repeated rows of a document are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.functions.keys import ref_key
from skewline.llm.tokens import TOKENIZERS, count_tokens
from skewline.session import cut

#: targets are a configuration: more rows than this are refused rather than collected
MAX_SOURCES = 100_000


def repetition_rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Rate of each source: the target over the tokens there are, at most the cap; a shortfall goes to the others."""
    open_ = {s for s, (share, cap) in targets.items() if share > 0 and cap > 0 and tokens.get(s, 0) > 0}
    left = float(sum(tokens.get(s, 0) for s in targets) if total is None else total)
    rates = dict.fromkeys(targets, 0.0)
    while open_:
        scale = left / sum(targets[s][0] for s in open_)
        full = {s for s in open_ if scale * targets[s][0] >= targets[s][1] * tokens[s]}
        if not full:
            rates |= {s: scale * targets[s][0] / tokens[s] for s in open_}
            break
        for s in full:
            rates[s] = float(targets[s][1])
            left -= targets[s][1] * tokens[s]
        open_ -= full
    return rates


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of each document with a source, written once: the corpus is tokenized a single time."""
    d = docs.select(F.col(doc_id).alias("doc_id"), ref_key(F.col(source)).alias("source"), F.col(text).alias("text")).where("source is not null and doc_id is not null")
    n = count_tokens(d, "text", ("doc_id", "source"), tokenizer, folder)
    return cut(n.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens"), "mix-sizes")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.select(ref_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    return {r["source"]: (r["share"] or 0.0, r["cap"]) for r in rows}


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None) -> DataFrame:
    want = _targets(targets)
    spark = sizes.sparkSession
    names = spark.createDataFrame([(s, float(x), int(c)) for s, (x, c) in want.items()], "source string, target_share double, max_repeats int")
    have = {r["source"]: r["n"] for r in sizes.join(F.broadcast(names.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rates = repetition_rates(have, want, total_tokens)
    return spark.createDataFrame([(s, float(x), int(c), int(have.get(s, 0)), float(rates[s])) for s, (x, c) in want.items()], "source string, target_share double, max_repeats int, tokens long, rate double")


def _emit(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    d = sizes.join(F.broadcast(plan.select("source", "rate", "max_repeats")), "source")
    copies = F.least(F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long"), F.col("max_repeats")).cast("int")
    return d.withColumn("copies", copies).where("copies > 0")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17, sizes: DataFrame | None = None, **kw) -> DataFrame:
    """(doc_id, copy_no, source, n_tokens): each drawn copy of each document."""
    sizes = sized(docs, **kw) if sizes is None else sizes
    d = _emit(sizes, _plan(sizes, targets, total_tokens), seed)
    return d.select("doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "source", "n_tokens")


def mix_report(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17, sizes: DataFrame | None = None, **kw) -> DataFrame:
    """Per source: target and reached share, tokens there and drawn, rate, cap."""
    sizes = sized(docs, **kw) if sizes is None else sizes
    plan = _plan(sizes, targets, total_tokens)
    got = _emit(sizes, plan, seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"))
    out = plan.join(F.broadcast(got), "source", "left").fillna(0, ["mixed_tokens", "documents"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    share = F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(F.lit(0.0))
    return out.select("source", "target_share", share.alias("reached_share"), "tokens", "mixed_tokens", "documents", "rate", "max_repeats")
