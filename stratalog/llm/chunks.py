"""Corpus-wide facts about every word, n-gram or window, without a row for each.

Documents are packed into chunks of a few MB, one row each, in a table in the shared folder. Each chunk sends the hashes of
its distinct items, sorted, with one small value each, as byte blobs dealt over buckets of the hash range. A bucket sees
all chunks' values for its items and answers each chunk. A chunk that holds an item many times sends it once, so a common
item weighs no more on a bucket than one entry for each chunk. Beyond 4,096 buckets (about 31 GB of text) chunks are merged
in slices on the way, level by level, so neither the messages of a chunk nor a bucket grow with the corpus. The answers then
join the chunk's row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .tables import written
from .textarrays import freeing, release

CHUNK_BYTES = 6 << 20
CHUNK_DOCS = 50_000
#: Entries of about one task's group.
BUCKET_ENTRIES = 1_500_000
#: A row sends to at most 2**FAN_BITS groups.
FAN_BITS = 12
_REPLIES = "chunk long, bucket long, n long, blobs array<binary>, extra array<double>"


def pack(docs: DataFrame, columns: list[str], text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A table of chunks: chunk id, number of documents, bytes of text, and the zstd-compressed Arrow table of its documents.

    columns: the columns kept besides the text. A document is never cut, so a chunk may exceed chunk_bytes by one document.
    """
    docs = docs.select(*columns, F.col(text).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        pressed = zstandard.ZstdCompressor(level=1)
        held, size, count = [], 0, 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            blob = pressed.compress(sink.getvalue())
            return pa.RecordBatch.from_pydict({"chunk": [int.from_bytes(os.urandom(8), "little", signed=True)], "n_docs": [count], "n_bytes": [size], "docs": pa.array([blob], pa.binary())}, schema=schema)

        for batch in batches:
            lengths = np.diff(text_offsets(batch))
            ends, at = np.cumsum(lengths), 0
            while at < batch.num_rows:
                room = chunk_bytes - size
                stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, side="right"))
                stop = min(max(stop, at + (not held)), at + CHUNK_DOCS - count, batch.num_rows)
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    size += int(lengths[at:stop].sum())
                    count += stop - at
                    at = stop
                if at < batch.num_rows:
                    yield chunk()
                    held, size, count = [], 0, 0
        if held:
            yield chunk()

    schema = pa.schema([("chunk", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("docs", pa.binary())])
    return written(docs.mapInArrow(freeing(rows), "chunk long, n_docs long, n_bytes long, docs binary"))


def text_offsets(batch: pa.RecordBatch) -> np.ndarray:
    from .textarrays import text_bytes

    return text_bytes(batch.column("text"))[1]


def unpack(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_buffer())).read_all()


def _shrink(values: np.ndarray) -> bytes:
    """An integer array in the narrowest type, the type's size first; mostly small values as bytes, the others after mark 9; equal ones once, after mark 10."""
    top = int(values.max()) if len(values) else 0
    if len(values) and top == values.min():
        return b"\x0a" + len(values).to_bytes(4, "little") + top.to_bytes(8, "little")
    if top > 255 and len(large := np.flatnonzero(values >= 255)) * 16 < len(values):
        return b"\x09" + len(large).to_bytes(4, "little") + values[large].astype("<u8").tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes()
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _grow(blob: memoryview | bytes) -> np.ndarray:
    if blob[0] == 10:
        value = int.from_bytes(blob[5:13], "little")
        return np.full(int.from_bytes(blob[1:5], "little"), value, np.uint64 if value >> 32 else np.uint32)
    if blob[0] != 9:
        return np.frombuffer(blob, f"<u{blob[0]}", offset=1)
    n = int.from_bytes(blob[1:5], "little")
    values = np.frombuffer(blob, np.uint8, offset=5 + 8 * n).astype(np.uint64)
    values[values == 255] = np.frombuffer(bytes(blob[5 : 5 + 8 * n]), "<u8")
    return values


def _pack_values(values: np.ndarray) -> list[bytes]:
    """Non-negative numbers as one blob; 64-bit ids of any sign as their distinct ones and indexes into them."""
    if values.dtype != np.int64:
        return [_shrink(values)]
    ids, at = np.unique(values, return_inverse=True)
    return [_shrink(at), ids.tobytes()]


def _unpack_values(blobs: list[bytes]) -> np.ndarray:
    values = _grow(blobs[0])
    return np.frombuffer(blobs[1], np.int64)[values] if len(blobs) > 1 else values.astype(np.uint32 if values.itemsize < 8 else np.uint64)


def _tops(bits: int) -> int:
    """How many top bits of the keys of one bucket are written as counts."""
    return max(16, -(-bits // 8) * 8)


def _encode(keys: np.ndarray, bits: int, kept_bits: int) -> bytes:
    """Sorted keys that share their top `bits` bits: counts by the bits after these, then the bytes below, up to kept_bits bits."""
    top = _tops(bits)
    sub = ((keys >> np.uint64(64 - top)) & np.uint64((1 << (top - bits)) - 1)).astype(np.int64)
    counts = _shrink(np.bincount(sub, minlength=1 << (top - bits)))
    low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 8 - kept_bits // 8 : 8 - top // 8]
    return len(counts).to_bytes(4, "little") + counts + low.tobytes()


def _decode(blob: memoryview, bucket: int, bits: int, kept_bits: int) -> np.ndarray:
    top = _tops(bits)
    size = int.from_bytes(blob[:4], "little")
    counts = _grow(blob[4 : 4 + size]).astype(np.int64)
    low = np.frombuffer(blob, np.uint8, offset=4 + size).reshape(-1, (kept_bits - top) // 8)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, 8 - kept_bits // 8 : 8 - top // 8] = low
    heads = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) | np.uint64(bucket << (top - bits))
    return full.view(np.uint64).ravel() | (heads << np.uint64(64 - top))


class Merge(NamedTuple):
    """What is known of an item in many chunks, from what each of them knows.

    merge(index, n, values): the values of n items, each from all entries whose index it is; any grouping gives the same.
    reply(values, whole): the answers to entries, from their own values and those of the item in the whole corpus.
    report(keys, values): numbers of one bucket of the whole corpus's items, to be summed over the buckets.
    kept_bits: with less than 64, only so many bits of a hash count, for figures that need not be exact.
    """

    merge: Callable[[np.ndarray, int, dict[str, np.ndarray]], dict[str, np.ndarray]]
    reply: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], list[np.ndarray]]
    report: Callable[[np.ndarray, dict[str, np.ndarray]], list[float]] = lambda keys, values: []
    kept_bits: int = 64


def _sum(index: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(index, weights=values, minlength=n).astype(np.uint64)


def summed(index: np.ndarray, n: int, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A merge of counts."""
    return {name: _sum(index, n, v) for name, v in values.items()}


def answers(chunks: DataFrame, items: Callable[[pa.Table], tuple[np.ndarray, dict[str, np.ndarray]]], how: Merge) -> DataFrame:
    """For each chunk and bucket: the answers to the chunk's items, as a list of blobs, and `extra`, numbers the bucket reports once.

    items(table): the chunk's distinct hashes, sorted, and named values of the same length: none negative, or int64 ids.
    """
    entries = (chunks.agg(F.sum("n_bytes")).first()[0] or 0) // 5 + 1

    def read(batch: pa.RecordBatch, k: int):
        return items(unpack(batch.column("docs")[k]))

    return _level(chunks.select("chunk", "docs"), read, how, 0, max(0, int(np.ceil(np.log2(max(1, entries / BUCKET_ENTRIES))))), entries)


def _level(rows: DataFrame, read: Callable, how: Merge, above: int, bits: int, entries: int) -> DataFrame:
    """Answers to the items of rows (chunk, docs). The items of a row share their top `above` bits; buckets take `bits` bits.

    A row sends at most 2**FAN_BITS messages. Where more buckets are needed, the messages of a coarse bucket meet in slices
    of bounded size. A slice merges what its chunks say of an item, asks the next level as if it were a chunk, and answers
    its chunks. So an item of all chunks is one entry for each slice of the level above, and no group grows with the corpus.
    """
    now = min(bits, above + FAN_BITS)
    slices = max(1, -(-entries // (BUCKET_ENTRIES << now))) if now < bits else 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, values = read(batch, k)
                out = {name: [] for name in sent.names}
                chunk = batch.column("chunk")[k].as_py()
                first = int(keys[0] >> np.uint64(64 - above)) << (now - above) if above and len(keys) else 0
                starts = np.arange(first, first + (1 << (now - above)), dtype=np.uint64) << np.uint64(64 - now) if now else np.zeros(1, np.uint64)
                edges = np.append(np.searchsorted(keys, starts), len(keys))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    low, high = edges[b], edges[b + 1]
                    out["bucket"].append(first + b)
                    out["slice"].append((chunk * 0x9E3779B1 >> 16) % slices)
                    out["chunk"].append(chunk)
                    out["keys"].append(_encode(keys[low:high], now, how.kept_bits))
                    out["vals"].append([_pack_values(v[low:high]) for v in values.values()])
                    out["names"].append(list(values))
                    if len(out["keys"]) >= 64:
                        yield pa.RecordBatch.from_pydict(out, schema=sent)
                        out = {name: [] for name in out}
                if out["keys"]:
                    yield pa.RecordBatch.from_pydict(out, schema=sent)

    def gathered(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]):
        """The chunks of a group, their numbers of items, the distinct items, each entry's index into them, and the values."""
        chunk, keys, values, sizes = [], [], {}, []
        for batch in batches:
            for k in range(batch.num_rows):
                part = _decode(memoryview(batch.column("keys")[k].as_buffer()), key[0].as_py(), now, how.kept_bits)
                blobs = batch.column("vals")[k].values
                for j, name in enumerate(batch.column("names")[k].as_py()):
                    values.setdefault(name, []).append(_unpack_values([memoryview(b.as_buffer()) for b in blobs[j].values]))
                chunk.append(batch.column("chunk")[k].as_py())
                keys.append(part)
                sizes.append(len(part))
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        return chunk, sizes, distinct, index, {name: np.concatenate(v) for name, v in values.items()}

    def replies(bucket: int, chunk: list[int], sizes: list[int], found: list[np.ndarray], extra: list[float]) -> Iterator[pa.RecordBatch]:
        edges = np.cumsum([0, *sizes])
        for k in range(len(chunk)):
            blobs = [(b"\0" + np.packbits(f[edges[k] : edges[k + 1]]).tobytes()) if f.dtype == bool else _shrink(f[edges[k] : edges[k + 1]]) for f in found]
            yield pa.RecordBatch.from_pydict({"chunk": [chunk[k]], "bucket": [bucket], "n": [sizes[k]], "blobs": [blobs], "extra": [[float(x) for x in extra] if not k else []]}, schema=replied)

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sizes, distinct, index, values = gathered(key, batches)
        whole = how.merge(index, len(distinct), values)
        extra = how.report(distinct, whole)
        yield from replies(key[0].as_py(), chunk, sizes, how.reply(values, {name: v[index] for name, v in whole.items()}), extra)
        release()

    sent = pa.schema([("bucket", pa.int64()), ("slice", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("vals", pa.list_(pa.list_(pa.binary()))), ("names", pa.list_(pa.string()))])
    replied = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("blobs", pa.list_(pa.binary())), ("extra", pa.list_(pa.float64()))])
    messages = rows.mapInArrow(freeing(send), "bucket long, slice int, chunk long, keys binary, vals array<array<binary>>, names array<string>")
    if now == bits:
        return messages.groupBy("bucket").applyInArrow(settle, _REPLIES)

    def hold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sizes, distinct, index, values = gathered(key, batches)
        whole = how.merge(index, len(distinct), values)
        edges = np.cumsum([0, *sizes])
        name = key[0].as_py() * slices + key[1].as_py()
        for k in range(len(chunk)):
            mine = {"names": list(values), "vals": [_pack_values(v[edges[k] : edges[k + 1]]) for v in values.values()], "index": _shrink(index[edges[k] : edges[k + 1]])}
            asked = {"keys": distinct.tobytes() if not k else None, "whole": [_pack_values(v) for v in whole.values()] if not k else None}
            yield pa.RecordBatch.from_pydict({f: [v] for f, v in ({"slice": name, "chunk": chunk[k], "bucket": key[0].as_py(), "n": sizes[k]} | mine | asked).items()}, schema=held)
        release()

    held = pa.schema([("slice", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("names", pa.list_(pa.string())), ("vals", pa.list_(pa.list_(pa.binary()))), ("index", pa.binary()), ("keys", pa.binary()), ("whole", pa.list_(pa.list_(pa.binary())))])
    members = written(messages.groupBy("bucket", "slice").applyInArrow(hold, "slice long, chunk long, bucket long, n long, names array<string>, vals array<array<binary>>, index binary, keys binary, whole array<array<binary>>"))

    def read_slice(batch: pa.RecordBatch, k: int):
        names, blobs = batch.column("names")[k].as_py(), batch.column("whole")[k].as_py()
        return np.frombuffer(batch.column("docs")[k].as_py(), np.uint64), {name: _unpack_values(b) for name, b in zip(names, blobs, strict=True)}

    asking = members.where("keys is not null").select(F.col("slice").alias("chunk"), F.col("keys").alias("docs"), "names", "whole")
    up = how._replace(reply=lambda values, whole: [v.view(np.uint64) if v.dtype == np.int64 else v for v in whole.values()])
    answered = written(_level(asking, read_slice, up, now, bits, entries))
    reports = answered.where(F.size("extra") > 0).select(F.lit(-1).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"), F.array().cast("array<binary>").alias("blobs"), "extra")

    def tell(key: tuple[pa.Scalar, ...], mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("bucket")
        parts = [[_read(memoryview(b.as_buffer()), n) for b in row.values] for row, n in zip(theirs.column("blobs"), theirs.column("n").to_pylist(), strict=True)]
        whole = [np.concatenate(p) for p in zip(*parts, strict=True)]
        out = []
        for k in range(mine.num_rows):
            names, blobs = mine.column("names")[k].as_py(), mine.column("vals")[k].as_py()
            index = _grow(mine.column("index")[k].as_py())
            values = {name: _unpack_values(b) for name, b in zip(names, blobs, strict=True)}
            found = how.reply(values, {name: w[index].astype(np.uint64).view(values[name].dtype.type if values[name].dtype == np.int64 else np.uint64) for name, w in zip(names, whole, strict=True)})
            out += replies(mine.column("bucket")[k].as_py(), [mine.column("chunk")[k].as_py()], [mine.column("n")[k].as_py()], found, [])
        return pa.Table.from_batches(out, schema=replied)

    told = members.drop("keys", "whole").groupBy("slice").cogroup(answered.withColumnRenamed("chunk", "slice").select("slice", "bucket", "n", "blobs").groupBy("slice")).applyInArrow(tell, _REPLIES)
    return told.unionByName(reports)


def with_answers(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each chunk's row with its answers, in the order of its sorted hashes."""
    whole = replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "blobs"))).alias("answers")).withColumnRenamed("chunk", "of")
    return chunks.join(whole, F.col("chunk") == F.col("of"), "left").select("chunk", "docs", "answers")


def each_with_answers(chunks: DataFrame, replies: DataFrame, run: Callable[[pa.Table, list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(documents, answers) of each chunk, one chunk at a time in a task: neither side is gathered in rows of many chunks."""
    given = to_arrow_schema(_parse_datatype_string(schema))

    def one(mine: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("bucket")
        parts: list[list[np.ndarray]] = []
        for blobs, n in zip(told.column("blobs").to_pylist(), told.column("n").to_pylist(), strict=True):
            parts = parts or [[] for _ in blobs]
            for part, blob in zip(parts, blobs, strict=True):
                part.append(_read(memoryview(blob), n))
        out = pa.Table.from_batches(run(unpack(mine.column("docs")[0]), [np.concatenate(p) for p in parts])).cast(given)
        release()
        return out

    return chunks.select("chunk", "docs").groupBy("chunk").cogroup(replies.select("chunk", "bucket", "n", "blobs").groupBy("chunk")).applyInArrow(one, schema)


def _read(blob: memoryview, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=1), count=n).astype(bool) if blob[0] == 0 else _grow(blob)


def read_answers(column: pa.Array, k: int) -> list[np.ndarray]:
    """The answer arrays of row k; an empty list where the chunk had no items."""
    rows = column[k]
    if not rows.is_valid:
        return []
    parts: list[list[np.ndarray]] = []
    for row in rows.values:
        n = row["n"].as_py()
        for j, b in enumerate(row["blobs"].values):
            if len(parts) <= j:
                parts.append([])
            parts[j].append(_read(memoryview(b.as_buffer()), n))
    return [np.concatenate(p) for p in parts]
