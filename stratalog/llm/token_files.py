"""Token-id files compressed by Re-Pair grammars, with random access.

Documents are range-partitioned by id. Each partition writes shards of a few MB in ascending id order. A shard's row holds:

* doc_ids (int64), doc_tokens (uint32) and doc_symbols (uint32): each document's id, its ids' count, its symbols' count;
* left, right (uint32) and rule_tokens (uint32): rule k replaces symbol base + k by left[k], right[k], which expand to
  rule_tokens[k] ids;
* symbols (uint32): the documents' symbols. No rule reaches across documents.

All arrays are little-endian. Repeatedly, all pairs of symbols that are frequent in the shard become nonterminals: in each
round those with at least a quarter of the most frequent pair's count, replaced from left to right without overlap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .textarrays import freeing, take_ranges, text_bytes
from .tokenizing import Encoder, blocks, with_end

SHARD_BYTES = 4 << 20
SHARD = "shard int, part int, base int, n_tokens long, doc_ids binary, doc_tokens binary, doc_symbols binary, `left` binary, `right` binary, rule_tokens binary, symbols binary"
_ARROW = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("base", pa.int32()), ("n_tokens", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "doc_tokens", "doc_symbols", "left", "right", "rule_tokens", "symbols"))])


def compress(ids: np.ndarray, first: np.ndarray, base: int, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the first symbol of each document, and the rules' left and right symbols.

    Stops when no pair comes `least` times, which trades size for time.
    """
    symbols = ids.astype(np.uint32)
    heads = np.zeros(len(ids) + 1, bool)
    heads[first] = True
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    n_rules = 0
    while True:
        if len(symbols) < 2:
            break
        pair = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
        bucket[heads[1 : len(symbols)]] = 0
        counts = np.bincount(bucket, minlength=1 << 20)
        counts[0] = 0
        often = max(least, int(counts.max()) // 4)
        some = np.flatnonzero(counts[bucket] >= often)
        if not len(some):
            break
        distinct, index, n = np.unique(pair[some], return_inverse=True, return_counts=True)
        if n.max() < often and often > least:  # pairs that share a count were taken for a frequent one
            some = np.flatnonzero(counts[bucket] >= least)
            distinct, index, n = np.unique(pair[some], return_inverse=True, return_counts=True)
        keep = n >= max(least, min(often, int(n.max()) // 4))
        some, index = some[keep[index]], (np.cumsum(keep) - 1)[index[keep[index]]]
        distinct = distinct[keep]
        if not len(some):
            break
        begins = np.ones(len(some), bool)
        begins[1:] = np.diff(some) > 1
        place = np.arange(len(some))
        even = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        at, rule = some[even], index[even]
        symbols[at] = base + n_rules + rule
        left.append((distinct >> np.uint64(32)).astype(np.uint32))
        right.append(distinct.astype(np.uint32))
        n_rules += len(distinct)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        heads = np.append(heads[: len(symbols)][stay], True)
        symbols = symbols[stay]
    starts = np.flatnonzero(heads[: len(symbols)]) if len(symbols) else np.zeros(0, np.int64)
    return symbols, np.append(starts, len(symbols)), np.concatenate(left), np.concatenate(right)


def rule_sizes(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to; a rule's symbols come before it."""
    sizes = np.zeros(len(left), np.int64)
    for k in range(len(left)):
        a, b = int(left[k]) - base, int(right[k]) - base
        sizes[k] = (sizes[a] if a >= 0 else 1) + (sizes[b] if b >= 0 else 1)
    return sizes


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids of the symbols."""
    while len(deep := np.flatnonzero(symbols >= base)):
        rule = symbols[deep] - base
        count = np.ones(len(symbols), np.int64)
        count[deep] = 2
        at = np.cumsum(count)
        symbols = np.repeat(symbols, count)
        symbols[at[deep] - 2], symbols[at[deep] - 1] = left[rule], right[rule]
    return symbols


def _read(row: dict[str, pa.Array], k: int) -> dict[str, np.ndarray | int]:
    kinds = {"doc_ids": np.int64}
    arrays = {n: np.frombuffer(row[n][k].as_buffer(), kinds.get(n, np.uint32)) for n in _ARROW.names[4:]}
    return arrays | {n: row[n][k].as_py() for n in _ARROW.names[:4]}


def slice_of_document(row: dict, doc: int, low: int, high: int) -> np.ndarray:
    """Ids low to high (exclusive) of the shard's document number `doc`, expanding only the symbols that hold them.

    row: a shard's row, its binary columns as numpy arrays.
    """
    ends = np.cumsum(row["doc_symbols"], dtype=np.int64)
    symbols = row["symbols"][ends[doc] - row["doc_symbols"][doc] : ends[doc]]
    size = np.ones(len(symbols), np.int64)
    deep = symbols >= row["base"]
    size[deep] = row["rule_tokens"][symbols[deep] - row["base"]]
    stop = np.cumsum(size)
    a, b = int(np.searchsorted(stop, low, side="right")), int(np.searchsorted(stop, high, side="left")) + 1
    before = int(stop[a - 1]) if a else 0
    return expand(symbols[a:b], row["left"], row["right"], row["base"])[low - before : high - before]


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int, base: int, id_column: str = "doc_id", text_column: str = "text", partition_bytes: int = 24 << 20) -> None:
    """Write the documents' shards as Parquet at `path`.

    base: the first nonterminal, above every id. A null text is empty, a null id comes first (and is read back as null).
    Rows of one id are separate documents in the order of their texts. An empty table writes no shard.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = source.repartitionByRange(max(1, -(-total // partition_bytes)), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    none = np.iinfo(np.int64).min

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.at(tokenizer), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([np.diff(h[2]) for h in held])
            symbols, starts, left, right = compress(ids, np.cumsum(lengths) - lengths, base)
            blobs = [np.concatenate([h[0] for h in held]), lengths.astype(np.uint32), np.diff(starts).astype(np.uint32), left, right, rule_sizes(left, right, base).astype(np.uint32), symbols]
            row = dict(zip(_ARROW.names, [TaskContext.get().partitionId(), part, base, len(ids), *(b.tobytes() for b in blobs)], strict=True))
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names = batch.column("id").fill_null(none).to_numpy(zero_copy_only=False)
            for low, high in blocks(offsets):
                ids, first = encoder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                held.append((names[low:high], *with_end(ids, first, end)))
                size += int(offsets[high] - offsets[low])
                if size >= SHARD_BYTES:
                    yield shard()
                    held, size, part = [], 0, part + 1
        if held:
            yield shard()

    ordered.mapInArrow(freeing(shards), SHARD).write.parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, decoded from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    places = running_totals(running_key(shards.select("shard", "part", "n_tokens")), "n_tokens", "before")
    none = np.iinfo(np.int64).min

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                row = _read(columns, k)
                ids = expand(row["symbols"], row["left"], row["right"], row["base"]).astype("<u4")
                edges = np.concatenate([[0], np.cumsum(row["doc_tokens"], dtype=np.int64)])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], mask=row["doc_ids"] == none), pa.array(edges[:-1] + columns["before"][k].as_py()), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return shards.join(places, ["shard", "part"]).select(*_ARROW.names, "before").mapInArrow(freeing(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def running_key(df: DataFrame) -> DataFrame:
    """Group 1,024 shards, so that no window holds all of them."""
    return df.withColumn("many", F.expr("shard div 1024"))


def running_totals(df: DataFrame, value: str, name: str) -> DataFrame:
    """The sum of `value` over all rows before, in the order of (many, shard, part): within each `many`, plus those before."""
    past = (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("many").orderBy("shard", "part").rowsBetween(*past)), F.lit(0))
    whole = df.groupBy("many").agg(F.sum(value).alias("all")).select(F.col("many").alias("of"), F.coalesce(F.sum("all").over(Window.orderBy("many").rowsBetween(*past)), F.lit(0)).alias("earlier"))
    return df.withColumn("inside", inside).join(whole, F.col("many") == F.col("of")).select("shard", "part", (F.col("inside") + F.col("earlier")).alias(name))
