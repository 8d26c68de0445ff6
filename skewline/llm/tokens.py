"""Encoding of a corpus with a public byte-level BPE tokenizer through tables of distinct words.

Contract: an empty and a null text give an empty list; text is taken as it is, whole and untrimmed; special tokens'
strings are ordinary text; repeated rows give repeated results; extra columns are carried only if asked for.

``encode``: words are split in the JVM and written once; the table of distinct words is made from them, encoded once each,
and ids are joined back by position. The most frequent words, up to ``TABLE_WORDS``, are joined by broadcast; occurrences
of the others, if there are more, by a shuffle on the word. ``count_tokens`` needs lengths only and keeps a table in each
task instead.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.session import cut

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: words a task remembers between batches; words of the table that are broadcast, at most, and their bytes
KEEP, TABLE_WORDS, TABLE_BYTES = 500_000, 1_000_000, 32_000_000
_S = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: fixed value: the split pattern of the public byte-level BPE, with white space spelt out for Java
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def split_words(text: Column) -> Column:
    """array<string> of the words of a text; [] for null and empty."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class WordTable:
    """ids of distinct words, encoded once each."""

    def __init__(self, path: str):
        import tiktoken

        # a word is already one piece of the split, so the encoder's own pattern takes it whole
        self.one = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
        self.known: dict[str, list[int]] = {}

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the words of an array of distinct words."""
        if len(self.known) > KEEP:
            self.known.clear()
        known, one, out = self.known, self.one, []
        for w in words.to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = one(w)
            out.append(ids)
        offsets = np.zeros(len(out) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=offsets[1:])
        return offsets, np.fromiter((i for x in out for i in x), np.int32, offsets[-1])


def _lengths(table: WordTable, words: pa.ListArray) -> pa.Array:
    """Number of ids of each list of words."""
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    offsets, _ = table.encode(coded.dictionary)
    at = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(np.diff(offsets)[at] if len(at) else np.zeros(0, np.int64), out=ends[1:])
    return pa.array(np.diff(ends[bounds]), pa.int64())


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of the distinct words of a column ``_words``: counted in each task, then once in all, then encoded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([c.field(0), c.field(1)], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path)
        for b in batches:
            offsets, ids = table.encode(b.column(0))
            table.known.clear()  # every word comes once
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["word", "n", "ids"])

    distinct = words.select("_words").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(distinct.mapInArrow(run, "word string, n long, ids array<int>"), "word-table")


def _frequent(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(the words that are broadcast, whether these are all): the most frequent within ``most`` words and ``TABLE_BYTES``."""
    bits = table.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("w"), F.sum(F.octet_length("word") + 4 * F.size("ids")).alias("bytes")).orderBy(F.col("b").desc()).collect()  # at most 63 rows
    words = size = 0
    least, all_ = None, True
    for r in bits:
        words, size = words + r["w"], size + r["bytes"]
        if words > most or size > TABLE_BYTES:
            all_ = False
            break
        least = r["b"]
    if least is None:
        return table.limit(0), not bits
    return table.where(F.floor(F.log2("n")) >= least), all_


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, table_words: int = TABLE_WORDS) -> DataFrame:
    """``keep`` columns and ids (array<int>) of each row, through the table of distinct words."""
    keep_, n = list(keep), len(keep)
    spark = df.sparkSession
    words = cut(df.select(*[F.col(k) for k in keep_], split_words(F.col(text)).alias("_words"), F.monotonically_increasing_id().alias("_row")), "words")
    table = word_table(words, f"{folder}/{tokenizer}.tiktoken")
    often, all_ = _frequent(table, table_words)
    t = often.select("word", "ids").toArrow().combine_chunks()  # within TABLE_WORDS and TABLE_BYTES
    ids = t.column("ids").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32()))
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    word = t.column("word").combine_chunks() if t.num_rows else pa.array([], pa.string())
    word = word.chunk(0) if isinstance(word, pa.ChunkedArray) else word
    shared = spark.sparkContext.broadcast((word, np.asarray(ids.offsets) - (ids.offsets[0].as_py() if len(ids) else 0), ids.flatten().to_numpy()))
    src = words
    if not all_:

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value[0]
            for b in batches:
                lists = b.column(0)
                flat = lists.flatten()
                out = pc.is_null(pc.index_in(flat, value_set=known)).to_numpy(zero_copy_only=False).nonzero()[0]
                bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                row = np.searchsorted(bounds, out, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row)), pa.array(out - bounds[row], pa.int32()), flat.take(pa.array(out))], names=["_row", "pos", "word"])

        seldom = words.select("_words", "_row").mapInArrow(rare, "_row long, pos int, word string").join(table.select("word", "ids"), "word")
        src = words.join(seldom.groupBy("_row").agg(F.collect_list(F.struct("pos", "ids")).alias("_rare")), "_row", "left").select(*keep_, "_words", "_rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, flat_ids = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                lists = part.column(n)
                bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                coded = lists.flatten().dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False)
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, np.int64)
                pool, begin, length = flat_ids, np.where(place >= 0, start[place], 0), np.where(place >= 0, start[place + 1] - start[place], 0)
                if not all_:
                    own = part.column(n + 1)
                    items = own.flatten()
                    if len(items):
                        # positions of the rare words of each row, and their ids after those of the table
                        row = np.repeat(np.arange(part.num_rows), [0 if x is None else x for x in own.value_lengths().to_pylist()])
                        where = bounds[row] + items.field("pos").to_numpy()
                        more = items.field("ids")
                        pool = np.concatenate([flat_ids, more.flatten().to_numpy()])
                        off = np.asarray(more.offsets) - more.offsets[0].as_py()
                        begin[where], length[where] = len(flat_ids) + off[:-1], np.diff(off)
                ends = np.concatenate([[0], np.cumsum(length)])
                take = np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])
                out = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(pool[take], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [out], names=[*keep_, "ids"])

    src = src if not all_ else src.select(*keep_, "_words")
    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n]), "ids array<int>"]))


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and n_tokens of each row: words are encoded once a task."""
    keep_, path = list(keep), f"{folder}/{tokenizer}.tiktoken"
    src = df.select(*[F.col(k) for k in keep_], split_words(F.col(text)).alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(path)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep_))] + [_lengths(table, part.column(len(keep_)))], names=[*keep_, "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "n_tokens long"])
    return src.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and text: ids joined by position to the table of pieces (bounded by the vocabulary). Null ids give null; an id beyond the vocabulary is an error."""
    keep_, path = list(keep), f"{folder}/{tokenizer}.tiktoken"
    src = df.select(*[F.col(k) for k in keep_], F.col(ids).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for p, i in ranks.items():
            pieces[i] = p
        size = np.array([len(p) for p in pieces], np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        for b in batches:
            col = b.column(len(keep_))
            flat = col.flatten().to_numpy(zero_copy_only=False)
            n = size[flat]
            ends = np.concatenate([[0], np.cumsum(n)])
            data = raw[np.repeat(start[flat] - ends[:-1], n) + np.arange(ends[-1])].tobytes() if len(flat) else b""
            # flatten() leaves out the null lists, so bounds come from the lengths
            lengths = [0 if x is None else x for x in col.value_lengths().to_pylist()]
            bounds = ends[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
            texts = [None if null else data[a:z].decode("utf-8") for a, z, null in zip(bounds[:-1], bounds[1:], col.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep_))] + [pa.array(texts, pa.string())], names=[*keep_, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "text string"])
    return src.mapInArrow(run, schema)
