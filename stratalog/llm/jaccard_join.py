"""Near-duplicate documents by the Jaccard similarity of their word n-gram sets, exactly but for hash clashes.

Equal sets form a class, and only classes are compared. Each class's n-grams are ordered rarest first, by how many
documents have them (counted over the corpus, chunks.py). Two similar sets share one of their first n - ceil(t * n) + 1
n-grams; n-grams of a single document are left out there. Candidates are joined on these prefix n-grams, filtered by length,
by the place of the first shared n-gram, and by how many n-grams the sets have in each part between fixed pivots of the
order of hashes (a suffix filter); what is left is verified once for each pair.

Pairs within a component need no check. So each prefix n-gram's classes are first compared only with a centre, the class
with the fewest n-grams of its own; most of a large group of near copies is linked to its centre at once. Then all pairs
of classes of different components are compared, those of the centre's component only with the others. No link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Merge, answers, each_with_answers, pack, summed
from .components import components
from .tables import with_row_key, written
from .textarrays import WHITESPACE, freeing, mix, salted, take_ranges, text_bytes, windows, words

_NO_ID = -(1 << 63)
_PARTS = 16
#: Row keys, of 16 bytes each, that may be broadcast.
_FEW = 1_000_000
#: Documents of a token for each of its blocks.
_BLOCK = 200
_SALTS = 16
_CLASS_BLOCK = 1000


def _packed(grams: np.ndarray) -> bytes:
    """The top 48 bits of sorted hashes. Within two sets of a thousand each, two n-grams share them with a chance of 4e-9."""
    return np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(blob: pa.Buffer) -> np.ndarray:
    low = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, 2:] = low
    return full.view(np.uint64).ravel()


def _sets(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) pairs: document numbers and hashes; and the number of n-grams of each document."""
    found = words(*text_bytes(table.column("text")), WHITESPACE, lower=True)
    hashes, at = windows(found.hash, found.first, width)
    size = np.diff(found.first)
    docs, grams = [found.doc[at]], [hashes]
    for k in range(1, width):
        short = np.flatnonzero(size == k)
        if len(short):
            rows = found.hash[take_ranges(found.first[short], size[short])]
            docs.append(short)
            grams.append(windows(rows, np.arange(len(short) + 1) * k, k)[0])
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    _, at = np.unique(mix(gram ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    doc, gram = doc[at], gram[at]
    return doc, gram, np.bincount(doc, minlength=len(size))


def _document_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs: (id, text), ids of any kind. Per document: id, n (n-grams), class (a hash of the set), most (in how many
    documents its rarest n-gram is), and for candidates that are the first of their class in their chunk: tokens (prefix
    n-grams, rarest first), places, often (in how many documents each token is), parts (n-grams by pivot), grams (sorted
    n-grams that another document has)."""
    chunks = pack(docs, ["id"], chunk_bytes=3 << 20)

    def items(table: pa.Table):
        _, gram, _ = _sets(table, width)
        keys, counts = np.unique(gram, return_counts=True)
        return keys, {"n": counts.astype(np.uint32)}

    def build(table: pa.Table, known: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, gram, n = _sets(table, width)
        _, index = np.unique(gram, return_inverse=True)
        often = known[0][index].astype(np.int64) if known else np.zeros(0, np.int64)
        del index
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, doc, salted(gram, 7))
        key = mix(total + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
        rare = np.bincount(doc[often == 1], minlength=len(n))
        prefix = n - (percent * n + 99) // 100 + 1
        wanted = (n > 0) & (rare < prefix)
        most = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(most, doc, often)
        firsts = np.zeros(len(n), bool)
        firsts[np.unique(np.where(wanted, key, 0), return_index=True)[1]] = True
        wanted &= firsts | (key == 0)
        mine = np.flatnonzero(wanted[doc])
        doc, gram, often = doc[mine], gram[mine], often[mine]
        order = np.lexsort((gram, often, doc))
        edges = np.searchsorted(doc[order], np.arange(len(n) + 1))
        yield from _rows(table.column("id").combine_chunks(), n, key, most, prefix, rare, wanted, gram[order], often[order], edges)

    def _rows(ids, n, key, most, prefix, rare, wanted, gram, often, edges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", ids.type), ("n", pa.int64()), ("class", pa.int64()), ("most", pa.int64()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("often", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("grams", pa.binary())])
        for low in range(0, len(ids), 2000):
            high = min(low + 2000, len(ids))
            out: dict[str, list] = {name: [] for name in schema.names[4:]}
            for d in range(low, high):
                row = (None,) * 5
                if wanted[d]:
                    grams, front = gram[edges[d] : edges[d + 1]], slice(rare[d], prefix[d])
                    parts = np.bincount((grams >> np.uint64(60)).astype(np.int64), minlength=_PARTS)
                    row = (grams[front].view(np.int64), np.arange(rare[d], prefix[d], dtype=np.int32), often[edges[d] : edges[d + 1]][front], parts.astype(np.int32), _packed(np.sort(grams[rare[d] :])))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            columns = [pa.array(v, schema.field(name).type) for name, v in out.items()]
            yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(n[low:high], pa.int64()), pa.array(key[low:high]), pa.array(most[low:high]), *columns], schema=schema)

    replies = answers(chunks, items, Merge(summed, lambda mine, whole: [whole["n"]], kept_bits=48))
    kind = docs.schema["id"].dataType.simpleString()
    return written(each_with_answers(chunks, replies, build, f"id {kind}, n long, class long, most long, tokens array<long>, places array<int>, often array<long>, parts array<int>, grams binary"))


def _needed(percent: int) -> Column:
    """The least shared number of n-grams of two similar sets: ceil(percent * (n_x + n_y) / (100 + percent))."""
    return F.expr(f"(({percent} * (n_x + n_y)) + {99 + percent}) div {100 + percent}")


def _verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y, linked) of all pairs (x, y, n_x, n_y)."""
    parts = nodes.select("class", "parts")
    near = pairs.join(parts.withColumnsRenamed({"class": "x", "parts": "p"}), "x").join(parts.withColumnsRenamed({"class": "y", "parts": "q"}), "y")
    shared = F.aggregate(F.zip_with("p", "q", lambda p, q: F.least(p, q)), F.lit(0), lambda a, b: a + b)
    near = near.where(shared >= _needed(percent)).select("x", "y", "n_x", "n_y")
    sets = nodes.select("class", "grams")
    full = near.join(sets.withColumnsRenamed({"class": "x", "grams": "s"}), "x").join(sets.withColumnsRenamed({"class": "y", "grams": "t"}), "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, bool)
            total = batch.column("n_x").to_numpy() + batch.column("n_y").to_numpy()
            for k in range(batch.num_rows):
                s, t = (_unpacked(batch.column(c)[k].as_buffer()) for c in ("s", "t"))
                shared = len(np.intersect1d(s, t, assume_unique=True))
                out[k] = 100 * shared >= percent * (total[k] - shared)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(out)], names=["x", "y", "linked"])

    tested = full.select("x", "y", "n_x", "n_y", "s", "t").mapInArrow(freeing(test), "x long, y long, linked boolean")
    return tested.where("linked").select("x", "y")


def _possible(percent: int) -> str:
    """Different components, and the length and positional filters, for a pair that meets at an n-gram.

    What two sets can share is bounded by what is left of either from the first n-gram they share. A similar pair meets at
    that one, where the bound holds; at a later one it may fail, which only spares a repetition of the pair.
    """
    shared = "least(n_x - place_x, n_y - place_y)"
    return f"label_x != label_y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) and {100 + percent} * ({shared}) >= {percent} * (n_x + n_y)"


def _distinct(joined: DataFrame) -> DataFrame:
    """Each candidate pair once, however many n-grams it meets at."""
    return joined.select("x", "y", "n_x", "n_y").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, class (hash of its set) and component_id, the least id reachable by links.

    Words are parted by white space, A-Z in lower case. A set holds the distinct n-grams of `width` words; fewer words are
    one n-gram; a document without words (or with a null text) has an empty set and is linked with nothing. Two documents
    link when 100 * shared >= percent * union. A null id counts as the least one. Rows that share an id are separate
    documents. An empty table gives an empty one. Other columns are ignored.
    """
    found = _groups(docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_column).alias("text")), width, percent)
    given = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(given("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class", given("least").alias("component_id"))


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, class, least) of docs (id, text); ids are of any kind that has an order."""
    every = _document_sets(docs, width, percent)
    labels = _class_labels(every, percent)
    classes = every.where("n > 0").groupBy("class").agg(F.min("id").alias("least"), F.first("most").alias("most"))
    # A component's least id is told to its classes over salted keys, for one component may hold most classes.
    linked = classes.join(labels, F.col("class") == F.col("node")).select("class", "label", "least", F.pmod(F.xxhash64("class"), F.lit(_SALTS)).alias("salt"))
    told = linked.groupBy("label").agg(F.min("least").alias("component")).select(F.col("label").alias("part"), "component", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("part_salt"))
    named = linked.join(told.hint("merge"), F.expr("label = part and salt = part_salt")).select(F.col("class").alias("named"), "component")
    # A class has at most as many documents as its rarest n-gram. Those of a large class are dealt over blocks.
    blocks = F.expr(f"(most + {_CLASS_BLOCK - 1}) div {_CLASS_BLOCK}")
    classes = classes.join(named, F.col("class") == F.col("named"), "left").select(F.col("class").alias("of"), F.coalesce("component", "least").alias("least"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("in"))
    rows = every.where("n > 0").select("id", "n", "class", F.pmod(F.xxhash64("id"), blocks).alias("block"))
    out = rows.join(classes.hint("merge"), F.expr("class = of and block = in")).select("id", "n", "class", "least")
    return out.unionByName(every.where("n = 0").select("id", "n", "class", F.col("id").alias("least")))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each component the row with the least id (of several, one), with its columns as they were; other rows go.

    A null id counts as greater than all others. Documents without words, with an empty or a null text stay: they are
    linked with nothing. Repeated rows are copies, so one of them stays. An empty table gives an empty one.
    """
    keyed = with_row_key(docs, "_key")
    found = _groups(keyed.select(F.col("_key").alias("id"), F.col(f"`{text_column}`").alias("text")), width, percent)
    groups = written(found.where("least != id").select("least", F.col("id").alias("_member")))
    members = groups.unionByName(groups.select("least", F.col("least").alias("_member")).distinct())
    ids = members.join(keyed.select("_key", F.col(f"`{id_column}`").alias("_id")), F.col("_member") == F.col("_key"))
    first = ids.groupBy("least").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_member")).alias("first"))
    gone = written(members.join(first.select(F.col("first._member").alias("_kept")), F.col("_member") == F.col("_kept"), "left_anti").select("_member"))
    gone = F.broadcast(gone) if gone.count() <= _FEW else gone  # else both sides are shuffled
    return keyed.join(gone, F.col("_key") == F.col("_member"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _class_labels(every: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all classes that have a link to another class.

    A token's classes are dealt over blocks, by how many documents have the token, so that no task holds a frequent token's.
    """
    first = every.where("grams is not null").groupBy("class").agg(F.first(F.struct("n", "tokens", "places", "often", "parts", "grams")).alias("s"))
    nodes = written(first.select("class", "s.*"))
    blocks = F.expr(f"cast((often + {_BLOCK - 1}) div {_BLOCK} as int)")
    flat = nodes.select("class", "n", F.col("places")[0].alias("own"), F.explode(F.arrays_zip("tokens", "places", "often")).alias("t")).select("class", "n", "own", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"), F.col("t.often").alias("often"))
    flat = flat.select("class", "n", "own", "token", "place", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    names = ("class", "n", "place", "label")
    x, y = ([F.col(c).alias(v if c == "class" else f"{c}_{v}") for c in names] for v in "xy")
    single = flat.withColumn("label", F.col("class"))
    # Per token: its centre (the class with the fewest n-grams of its own), told to each of its blocks.
    centre = _by_token(single, F.min(F.struct("own", F.struct(*y).alias("y"))).alias("c"), F.count(F.lit(1)).alias("holders"))
    centre = centre.groupBy("token").agg(F.min("c").alias("c"), F.sum("holders").alias("holders"), F.first("blocks").alias("blocks")).where("holders > 1")
    centres = centre.select(F.col("token").alias("of"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("in"), "c.y.*")
    entries = written(single.select("token", "blocks", "block", "own", *x).join(centres.hint("merge"), F.expr("token = of and block = in")))
    pairs = _distinct(entries.where(_possible(percent)))
    links = written(_verify(pairs, nodes, percent))
    labels = written(_labels_of(links))

    now = entries.select("token", "blocks", "block", "own", F.col("x").alias("class"), F.col("n_x").alias("n"), F.col("place_x").alias("place"))
    now = written(now.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")))
    major = _by_token(now, F.min(F.struct("own", "class", "label")).alias("major"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("holders"))
    major = major.groupBy("token").agg(F.min("major")["label"].alias("major"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("holders").alias("holders"), F.first("blocks").alias("blocks")).where("low < high")
    sides = F.expr(f"cast((holders + {_BLOCK - 1}) div {_BLOCK} as int)").alias("sides")
    majors = major.select(F.col("token").alias("of"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("in"), "major", sides)
    open_entries = written(now.join(majors.hint("merge"), F.expr("token = of and block = in")).drop("of", "in"))
    # A token's outer rows of one side meet its inner rows of one side in one task, never all of its pairs.
    side, all_sides = F.pmod(F.xxhash64("class"), F.col("sides")), F.explode(F.expr("sequence(0L, cast(sides - 1 as long))"))
    inner = open_entries.select(F.col("token").alias("of"), side.alias("inner_of"), all_sides.alias("outer_of"), (F.col("label") == F.col("major")).alias("central"), *y)
    outer = open_entries.where("label != major").select("token", side.alias("outer_side"), all_sides.alias("inner_side"), *x)
    same = "token = of and inner_side = inner_of and outer_side = outer_of"
    pairs = _distinct(outer.join(inner.hint("merge"), F.expr(f"{same} and (central or x < y) and {_possible(percent)}")))
    return written(_labels_of(links.unionByName(written(_verify(pairs, nodes, percent)))))


def _by_token(entries: DataFrame, *facts: Column) -> DataFrame:
    return entries.groupBy("token", "block", "blocks").agg(*facts)


def _labels_of(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
