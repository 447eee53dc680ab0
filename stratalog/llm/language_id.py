"""Language identification by a string kernel.

Two texts are as similar as the sets of their character n-grams (1 to `longest` characters: a blended spectrum, presence only):
the size of the intersection over the geometric mean of the sizes. Some labelled texts of each language are landmarks. The
Nyström map of a text is its kernel with the landmarks, times the inverse square root of the landmarks' kernel matrix; ridge
regression of +1 / -1 for each language against the rest is solved in that space.

A text's scores are x L W / |x|, with its presence vector x, the landmarks' vectors L and the weights W of both steps. L W, a
small table of n-grams by languages, is multiplied once; a batch of texts is then one product of its presence matrix with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import freeing, mix

#: n-grams are numbered by a hash of so many bits; those that share a number count as one.
GRAM_BITS = 18
_APART = re.compile(r"[\W\d_]+")
_BATCH = 256


def grams(text: str, longest: int = 4) -> np.ndarray:
    """The numbers of the n-grams of a text, each once, in lower case with one space for all between letters."""
    codes = np.frombuffer(f" {_APART.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    found, rolled = [], np.zeros(len(codes), np.uint64)
    for n in range(min(longest, len(codes))):
        rolled = rolled[: len(codes) - n] * np.uint64(0xD6E8FEB86659FD93) + codes[n:]
        found.append(mix(rolled + np.uint64(n)) >> np.uint64(64 - GRAM_BITS))
    return np.concatenate(found).astype(np.int64)


def distinct(numbers: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Each number once, by the place where it is last found. slots: scratch space with a place for every number."""
    places = np.arange(len(numbers), dtype=slots.dtype)
    slots[numbers] = places
    return numbers[slots[numbers] == places]


class Model(NamedTuple):
    """languages; weights: n-gram numbers by languages (float32); bias of each language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray


def kernel(sets: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """The kernel of each set of n-grams with each landmark."""
    known, columns = np.unique(np.concatenate(landmarks), return_inverse=True)
    presence = np.zeros((len(known) + 1, len(landmarks)), np.float32)  # the last row: n-grams of no landmark
    presence[columns, np.repeat(np.arange(len(landmarks)), [len(s) for s in landmarks])] = 1
    row = np.full(1 << GRAM_BITS, len(known), np.int64)
    row[known] = np.arange(len(known))
    shared = np.array([presence[row[s]].sum(axis=0) for s in sets], np.float64)
    return shared / np.sqrt(np.outer([len(s) for s in sets], [len(s) for s in landmarks]))


def fit(sets: list[np.ndarray], labels: list[str], per_language: int, ridge: float = 1e-3) -> Model:
    """The model learnt from sets of n-grams and their languages, with the first `per_language` of each as landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << GRAM_BITS, 0), np.float32), np.zeros(0))
    of = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(of == k)[:per_language] for k in range(len(languages))])
    landmarks = [sets[k] for k in chosen]
    sizes, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    kept = sizes > 1e-7 * sizes[-1]
    to_space = vectors[:, kept] / np.sqrt(sizes[kept])
    space = kernel(sets, landmarks) @ to_space
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1 / np.bincount(of))[of]  # each language counts alike
    weight /= weight.sum()
    middle, level = weight @ space, weight @ target
    centred = (space - middle) * np.sqrt(weight)[:, None]
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(space.shape[1]), centred.T @ ((target - level) * np.sqrt(weight)[:, None]))
    by_landmark = to_space @ solved
    weights = np.zeros((1 << GRAM_BITS, len(languages)))
    for s, w in zip(landmarks, by_landmark):
        weights[s] += w / np.sqrt(len(s))
    return Model(languages, weights.astype(np.float32), level - middle @ solved)


def scores(model: Model, sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set of n-grams, a column for each language; near 1 for the text's language, -1 for the others."""
    sizes = np.array([len(s) for s in sets])
    sums = np.add.reduceat(model.weights[np.concatenate(sets)], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
    return sums / np.sqrt(sizes)[:, None] + model.bias


def _sample(labelled: DataFrame, rows: int) -> tuple[list[np.ndarray], list[str]]:
    """n-gram sets and languages of up to `rows` labelled texts, as many of each language as there are, in the order of a hash."""
    from pyspark.sql import Window

    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    if len(counts) > rows // 4:
        raise ValueError(f"{len(counts)} languages are too many for a sample of {rows} texts")
    each = rows // len(counts)
    # Few more rows than needed of each language reach the window: a hash lets pass about twice as many, and 200 more.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * each + 200) / n))])
    order = F.xxhash64("id", "text")
    passed = labelled.withColumn("order", order).where((F.pmod("order", F.lit(1 << 30)) / float(1 << 30)) <= F.get(F.array(share), F.lit(0))[F.col("lang")])
    first = passed.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))).where(F.col("k") <= each)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                present = np.zeros(1 << GRAM_BITS, bool)
                present[grams(batch.column("text")[k].as_py())] = True
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(k, 1), batch.column("k").slice(k, 1), pa.array([np.packbits(present).tobytes()], pa.binary())], names=["lang", "k", "present"])

    found = first.select("lang", "k", "text").mapInArrow(freeing(sets), "lang string, k int, present binary").collect()  # at most `rows` of 32 KB
    found.sort(key=lambda r: (r.lang, r.k))
    return [np.flatnonzero(np.unpackbits(np.frombuffer(r.present, np.uint8))) for r in found], [r.lang for r in found]


def identify_languages(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows: int = 1600, landmarks: int = 320) -> DataFrame:
    """Per document: doc_id, held_out (not `learn`), lang_pred and score (0 to 1, from the winning language's regression).

    Learns from texts with a letter and a language where `learn` holds: from at most `rows` of them, as many of each
    language, `landmarks` of which are landmarks. Whole texts are read, of the sample and of all documents. A null text and one
    without a letter are `und` with score 0, and so are all texts if there is nothing to learn from. Ties go to the language
    that sorts first. Rows that share an id are taken apart; a null id stays null. An empty table gives an empty one. Other
    columns are ignored.
    """
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.col(lang_column).cast("string").alias("lang"), F.coalesce(learn, F.lit(False)).alias("learn"))
    sets, labels = _sample(source.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")), rows)
    model = fit(sets, labels, max(1, landmarks // max(1, len(set(labels)))))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # 1 MB for each language
    id_type = docs.schema[id_column].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slots = shared.value, np.zeros(1 << GRAM_BITS, np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                texts = batch.column("text").to_pylist()
                spoken = [k for k, t in enumerate(texts) if model.languages and any(map(str.isalpha, t))]
                names, sure = ["und"] * len(texts), np.zeros(len(texts))
                if spoken:
                    found = scores(model, [distinct(grams(texts[k]), slots) for k in spoken])
                    best = found.argmax(axis=1)
                    for k, b in zip(spoken, best):
                        names[k] = model.languages[b]
                    sure[spoken] = np.clip((found.max(axis=1) + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names), pa.array(sure), batch.column("learn")], names=["doc_id", "lang_pred", "score", "learn"])

    found = source.select("id", "text", "learn").mapInArrow(freeing(predict), f"doc_id {id_type}, lang_pred string, score double, learn boolean")
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "lang_pred", "score")
