"""Packing of documents into as few sequences as can be found, by bin completion.

Only how many pieces have each length matters to a packing, so the search runs over these counts: one for each length up to
the capacity, whatever the corpus's size. A step fills a sequence around the largest length left and says how many sequences
take that filling. Fillings are enumerated depth first; dominated ones are dropped: a filling that leaves room for a piece
still left, and one in which a larger piece still left could take the place of some pieces. Branch and bound runs over the
steps: fillings of least waste first, each as often as the counts allow and then less often, back from a partial plan whose
sequences and lower bound for the rest don't beat the incumbent. Best-fit plans are the first incumbents.
Small tables are solved exactly. For others the effort is bounded and the result is the best incumbent: after the first
branch, further ones start with another filling at one of the first steps, since going back changes the last steps first.
Spark numbers the pieces of each length, and a piece's number gives its sequence and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered, written
from .textarrays import freeing, text_bytes
from .tokenizing import Encoder, blocks, with_end


Filling = list[tuple[int, int]]


def _dominated(chosen: Filling, room: int, left: dict[int, int], all_left: int) -> bool:
    """Whether a piece still left could replace some pieces of the filling: one larger than them that fits, or as large as several.

    Sums and lengths are bits of integers. all_left: the lengths left.
    """
    sums, single = 1, 0
    for size, n in chosen:
        single |= 1 << size
        if left[size] == n:
            all_left &= ~(1 << size)
        part = 1
        while n:
            sums |= sums << (size * min(part, n))
            n, part = n - min(part, n), part * 2
    sums &= ~1
    if all_left & sums & ~single:
        return True
    larger, reach = sums << 1, 1  # sums, made larger by 1 to `reach`
    while reach < room:
        step = min(reach, room - reach)
        larger |= larger << step
        reach += step
    return bool(room and all_left & larger)


def fillings(room: int, lengths: list[int], left: dict[int, int], all_left: int, nodes: int) -> tuple[list[Filling], bool]:
    """Undominated fillings of `room` from the lengths left (sorted, and as bits), and whether these are all.

    A node chooses how many pieces of a length to take. The first filling (best-fit decreasing) is always completed and comes
    first; `nodes` bounds the search for others, which follow with least waste first.
    """
    found: list[tuple[int, Filling]] = []
    first: list[Filling] = []
    budget = nodes

    def deeper(room: int, high: int, skipped: int, chosen: Filling) -> bool:
        """Whether the search has been cut. skipped: the least length of which pieces were left out."""
        nonlocal budget
        k = bisect_right(lengths, room, 0, high) - 1
        while k >= 0:
            size = lengths[k]
            for n in range(min(left[size], room // size), 0, -1):
                if budget <= 0 and first:
                    return True
                budget -= 1
                chosen.append((size, n))
                cut = deeper(room - n * size, k, size if n < left[size] else skipped, chosen)
                chosen.pop()
                if cut:
                    return True
            skipped = size
            k -= 1
        if room < skipped:
            if not first:
                first.append(chosen.copy())
            if not _dominated(chosen, room, left, all_left):
                found.append((room, chosen.copy()))
        return False

    cut = deeper(room, len(lengths), room + 1, [])
    others = [f for _, f in sorted(found, key=lambda x: x[0])]
    return first + [f for f in others if f != first[0]], not cut


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum of lengths, and by how pieces over half the capacity meet shorter ones."""
    if not counts:
        return 0
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    size = np.arange(capacity + 1)
    many, whole = np.cumsum(n), np.cumsum(n * size)
    half = capacity // 2
    k = np.arange(half + 1)  # pieces shorter than k are left out; those above capacity - k stand alone
    alone = many[-1] - many[capacity - k]
    large = many[capacity - k] - many[half]
    below = np.where(k > 0, whole[np.maximum(k - 1, 0)], 0)
    free = large * capacity - (whole[capacity - k] - whole[half])
    rest = np.maximum(0, whole[half] - below - free)
    return max(-(-int(whole[-1]) // capacity), int((alone + large + -(-rest // capacity)).max()))


def search(counts: dict[int, int], capacity: int, nodes: int = 300, steps: int = 400, branches: int = 2) -> list[tuple[list[int], int]]:
    """Fillings, each with how many sequences take it. counts: pieces of each length, at most `capacity`.

    nodes: of each enumeration of fillings; steps: of each branch after its first plan; branches: after the first. Tables
    that the first branch goes through within its steps are solved exactly.
    """
    counts = {k: n for k, n in counts.items() if n}
    bound = lower_bound(counts, capacity)
    best: list[tuple[Filling, int]] = []
    fewest = sum(counts.values()) + 1 if counts else 0

    def options(left: dict[int, int], lengths: list[int], all_left: int, before: list[Filling], best_fit: bool) -> tuple[Iterator[tuple[Filling, int]], bool]:
        """Fillings around the largest length (for best_fit the first only), each with a number of sequences; not those in `before`."""
        largest = lengths[-1]
        left[largest] -= 1
        found, every = fillings(capacity - largest, lengths if left[largest] else lengths[:-1], left, all_left if left[largest] else all_left ^ 1 << largest, 0 if best_fit else nodes)
        left[largest] += 1
        if len(found) > 1 and _sum(found[1]) > _sum(found[0]):
            found[0], found[1] = found[1], found[0]
        whole = []
        for f in found:
            f = [(largest, 1 + f[0][1]), *f[1:]] if f and f[0][0] == largest else [(largest, 1), *f]
            if f not in before:
                whole.append((f, min(left[k] // n for k, n in f)))
        fewer = ((f, t) for f, most in whole for t in range(most - 1, 0, -1))
        return chain(whole, fewer), every

    def branch(turn: int, best_fit: bool = False) -> bool:
        """Depth-first search from the empty plan; its first plan takes the second filling at step `turn`, and ends a best-fit one.

        Returns whether all was searched.
        """
        nonlocal best, fewest
        left, lengths, all_left, used, rest = dict(counts), sorted(counts), sum(1 << k for k in counts), 0, sum(k * n for k, n in counts.items())
        plan: list[tuple[Filling, int]] = []
        frames: list[Iterator[tuple[Filling, int]]] = []
        complete, descending, budget = True, True, steps

        def move(f: Filling, times: int) -> None:
            """Take (times > 0) or give back the pieces of `times` sequences."""
            nonlocal used, rest, all_left
            for k, n in f:
                had, left[k] = left[k], left[k] - n * times
                if not left[k]:
                    lengths.pop(bisect_left(lengths, k))
                    all_left ^= 1 << k
                elif not had:
                    insort(lengths, k)
                    all_left ^= 1 << k
                rest -= k * n * times
            used += times

        while True:
            if not lengths:
                if used < fewest:
                    best, fewest = plan.copy(), used
                descending = False
                if best_fit:
                    return False
            elif used + -(-rest // capacity) < fewest and (descending or used + lower_bound({k: left[k] for k in lengths}, capacity) < fewest):
                same = [f for f, _ in plan if f[0][0] == lengths[-1]] if len(plan) < 64 else []
                choices, every = options(left, lengths, all_left, same, best_fit)
                complete &= every
                if descending and len(frames) == turn:
                    head = next(choices, None)
                    choices = chain(islice(choices, 1), [head] if head else [], choices)
                frames.append(choices)
            else:
                descending = False
            choice = None
            while frames and choice is None:
                if len(plan) == len(frames):
                    move(plan[-1][0], -plan.pop()[1])
                if (choice := next(frames[-1], None)) is None:
                    frames.pop()
            if choice is None or fewest == bound:
                return complete
            if not descending:
                budget -= 1
                if budget < 0:
                    return False
            plan.append(choice)
            move(*choice)

    if counts:
        branch(-1, best_fit=True)
        for turn in range(-1, branches):
            if fewest == bound or branch(turn) and turn < 0:
                break
    return [([k for k, n in f for _ in range(n)], times) for f, times in best]


def _sum(f: Filling) -> int:
    return sum(k * n for k, n in f)


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Only documents of more than `capacity` ids are cut."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in blocks(offsets):
                ids, first = with_end(*encoder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]), end)
                view = memoryview(ids.astype("<u4").tobytes())
                size = np.diff(first)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(low, high), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[doc - low] - start)
                at = first[doc - low] + start
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=schema)
        encoder.rest()

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(freeing(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    A null or empty text is the end id alone. Rows that share an id are packed as separate documents. A null id stays
    null. An empty table gives an empty one. Other columns are ignored.
    """
    found = written(token_pieces(docs, tokenizer, end, capacity, id_column, text_column))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    begin: list[tuple[int, int, int, int]] = []
    taken: dict[int, int] = {}
    base = 0
    for filling, times in search(counts, capacity):
        offset = 0
        for k in filling:
            begin.append((k, taken.get(k, 0), base, offset))
            taken[k] = taken.get(k, 0) + times
            offset += k
        base += times
    table = np.array(sorted(begin), np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = numbered(found, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    return ranked.mapInArrow(freeing(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
