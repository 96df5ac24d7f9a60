"""Language-model scores from Brown classes: class transitions and word emissions.

Words that occur ``MIN_COUNT`` times or more in the training texts, however large these are,
are put in ``CLASSES`` classes by batched reassignment: every word has counts of what stands left
and right of it, and all words move at once, round after round, to the class under whose context
distribution their own contexts are likeliest. This is not Brown's exchange: no move is valued by
the likelihood of the class bigrams, which is not watched either. Contexts are
counted by the neighbours' *forms* (the last letters or marks of a word). Rarer and unknown
words are in the class of their form. A text's probability is the product over its tokens of

    P(class | class before) * P(word | class)

with the transitions smoothed by the class frequencies. Within a form's class each known
word gives up ``DISCOUNT`` occurrences to the unknown word of that class; the words of a
class therefore sum to one.

All counts cover all training documents, and nothing of the vocabulary's size is broadcast
or collected. The texts are read once and packed: a *batch* of some ``BATCH`` tokens of one
scan task holds its documents as numbers of the batch's own word list. Word lists are
summed over batches by word (one row per word and batch, so the most frequent word has as
many rows as there are batches) and the sums go back to their batches. Batches are stored
bucketed, so meeting their sums again moves only the sums. Collected are the class tables,
whose size is fixed.

Defined results: null text is empty and is one token, the end. A null ``doc_id`` is taken as
the empty text for the held-out rule, that is for training. Repeated rows count and are
scored one by one. Other columns are not read. Without training documents every word is
unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.session import shared_folder, stored_table

CLASSES, FORMS = 64, 32
MIN_COUNT = 5
_ENTRY = np.dtype([("at", "u1"), ("n", "<u4")])  # of a sparse context vector
ROUNDS = 8
DISCOUNT = 0.75
PRIOR = 10.0  # weight of the class frequencies in a transition row
BATCH = 2_000_000
_END = CLASSES + FORMS  # class of the end token
_MARKS = b"#*$&%!"
_LETTERS = 24


def form(word: bytes) -> int:
    """Class of a word by its ending: a mark, a digit, or its last two bytes."""
    mark = _MARKS.find(word[-1:])
    if mark >= 0:
        return _LETTERS + mark
    core = word.rstrip(b".,;:?)\"'|")
    if not core:
        return FORMS - 1
    if core[-1:].isdigit():
        return FORMS - 2
    return crc32(core[-2:]) % _LETTERS


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


PACKED = (
    "batch long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary,"
    " words array<binary>, counts array<int>, forms array<tinyint>"
)


def _packed(batch, docs, held, ids, numbers) -> pa.RecordBatch:
    sizes = np.array([len(i) for i in ids], np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    train = flat[np.repeat(~np.array(held, bool), sizes)]
    counts = np.bincount(train, minlength=len(numbers)).astype(np.int32)
    words = list(numbers)
    columns = {
        "batch": pa.array([batch], pa.int64()),
        "doc_ids": pa.array([docs], pa.list_(pa.int64())),
        "held": pa.array([held], pa.list_(pa.bool_())),
        "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "ids": pa.array([flat.astype("<i4").tobytes()], pa.binary()),
        "words": pa.array([words], pa.list_(pa.binary())),
        "counts": pa.array([counts], pa.list_(pa.int32())),
        "forms": pa.array([np.fromiter(map(form, words), np.int8, len(words))], pa.list_(pa.int8())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _pack_batches(limit: int):
    def run(batches):
        task = TaskContext.get().partitionId() << 24
        made = held_tokens = 0
        docs, held, ids, numbers = [], [], [], _Numbers()
        for batch in batches:
            rows = zip(batch.column("doc_id"), batch.column("held"), batch.column("text"))
            for doc, out, text in rows:
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = data.lower().split()
                ids.append(
                    np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                )
                docs.append(doc.as_py())
                held.append(out.as_py())
                held_tokens += len(words) + 1
                if held_tokens >= limit:
                    yield _packed(task + made, docs, held, ids, numbers)
                    made, held_tokens = made + 1, 0
                    docs, held, ids, numbers = [], [], [], _Numbers()
        if docs:
            yield _packed(task + made, docs, held, ids, numbers)

    return run


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """Write by batch into buckets in the shared folder: later joins on batch move nothing."""
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    # More than shuffles have, so that a task seldom holds two batches.
    buckets = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 50_000)
    writer = df.write.bucketBy(buckets, "batch").option("compression", "zstd")
    writer.option("path", f"{shared_folder(spark)}/{unique}").saveAsTable(unique)
    return spark.table(unique)


def pack(docs: DataFrame, limit: int = BATCH) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.crc32(key.cast("binary")) % 7 == 2).alias("held"),
        "text",
    )
    return _bucketed(narrow.mapInArrow(_pack_batches(limit), PACKED), "packed_texts")


def vocabulary(packed: DataFrame) -> DataFrame:
    """(batch, pos, word, form, total, first): a row per word and batch, stored.

    ``total`` counts a word in all training documents; ``first`` marks one row of each word.
    """
    listed = packed.select("batch", F.posexplode(F.arrays_zip("words", "counts", "forms")))
    rows = listed.select(
        "batch",
        "pos",
        F.col("col.words").alias("word"),
        F.col("col.forms").alias("form"),
        F.col("col.counts").alias("n"),
    )
    of_word = Window.partitionBy("word")
    summed = rows.select(
        "batch",
        "pos",
        "word",
        "form",
        F.sum("n").over(of_word).alias("total"),
        (F.min("batch").over(of_word) == F.col("batch")).alias("first"),
    )
    return stored_table(summed, "vocabulary")


def _list_batches(batches):
    """Pack the (batch, pos, value) rows of a batch, which come in order."""
    batch, places, values = None, [], []

    def row():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([batch], pa.int64()),
                pa.array([np.concatenate(places).astype("<i4").tobytes()], pa.binary()),
                pa.array([np.concatenate(values).astype("<i8").tobytes()], pa.binary()),
            ],
            names=["batch", "places", "values"],
        )

    for part in batches:
        keys = part.column("batch").to_numpy()
        pos, value = part.column("pos").to_numpy(), part.column("value").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if batch is not None and batch != keys[a]:
                yield row()
                places, values = [], []
            batch = int(keys[a])
            places.append(pos[a:b])
            values.append(value[a:b])
    if places:
        yield row()


def _by_batch(rows: DataFrame, name: str) -> DataFrame:
    """(batch, <name>_places, <name>): values of a batch's words as packed numbers."""
    ordered = rows.repartition("batch").sortWithinPartitions("batch", "pos")
    lists = ordered.mapInArrow(_list_batches, "batch long, places binary, values binary")
    named = lists.toDF("batch", f"{name}_places", name)
    return _bucketed(named, name)


def _numbers(value, kind) -> np.ndarray:
    return np.frombuffer(value if value is not None else b"", kind)


class _Batch:
    """A packed batch with what is known about its words."""

    def __init__(self, columns, i):
        def numbers(name):
            return columns[name][i].values.to_numpy(zero_copy_only=False)

        self.words = columns["words"][i].values if "words" in columns else None
        self.sizes = numbers("sizes").astype(np.int64)
        self.held = numbers("held").astype(bool)
        self.docs = columns["doc_ids"][i].values
        self.forms = numbers("forms")
        self.ids = _numbers(columns["ids"][i].as_py(), "<i4")
        self.totals = np.zeros(len(self.forms), np.int64)
        places = _numbers(columns["totals_places"][i].as_py(), "<i4")
        self.totals[places] = _numbers(columns["totals"][i].as_py(), "<i8")
        self.classes = self.forms.astype(np.int32) + CLASSES
        if "classes" in columns:
            places = _numbers(columns["classes_places"][i].as_py(), "<i4")
            self.classes[places] = _numbers(columns["classes"][i].as_py(), "<i8")

    def with_ends(self, of_word: np.ndarray, end: int) -> np.ndarray:
        """A value per token, the ends of the documents included."""
        return np.insert(of_word[self.ids], np.cumsum(self.sizes), end)

    def train_tokens(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes + 1)


def _rows(batches, names):
    for batch in batches:
        columns = {n: batch.column(n) for n in names}
        for i in range(batch.num_rows):
            yield _Batch(columns, i)


_TEXT = ["doc_ids", "held", "sizes", "ids", "forms", "totals_places", "totals"]
_WORDED = [*_TEXT, "words"]
_CLASSED = [*_TEXT, "classes_places", "classes"]


def _sparse(counts: np.ndarray) -> list[bytes]:
    """The entries that are not zero of every row."""
    rows, at = np.nonzero(counts)
    entries = np.empty(len(rows), _ENTRY)
    entries["at"], entries["n"] = at, counts[rows, at]
    ends = np.cumsum(np.bincount(rows, minlength=len(counts))) * _ENTRY.itemsize
    data = entries.tobytes()
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _dense(vectors: list[bytes]) -> np.ndarray:
    entries = np.frombuffer(b"".join(vectors), _ENTRY)
    sizes = [len(v) // _ENTRY.itemsize for v in vectors]
    counts = np.zeros((len(vectors), 2 * (FORMS + 1)), np.int64)
    counts[np.repeat(np.arange(len(vectors)), sizes), entries["at"]] = entries["n"]
    return counts


def _context_batches(least: int):
    def run(batches):
        for batch in _rows(batches, _WORDED):
            chosen = np.flatnonzero(batch.totals >= least)
            slot = np.full(len(batch.forms), -1, np.int32)
            slot[chosen] = np.arange(len(chosen))
            own = batch.with_ends(slot, -1)
            forms = batch.with_ends(batch.forms, FORMS)
            use = np.flatnonzero(batch.train_tokens() & (own >= 0))
            own = own[use].astype(np.int64) * (2 * (FORMS + 1))
            # Documents start behind an end; a chosen word is never last.
            before = np.where(use > 0, forms[use - 1], FORMS)
            size = len(chosen) * 2 * (FORMS + 1)
            counts = np.bincount(own + before, minlength=size)
            counts += np.bincount(own + (FORMS + 1) + forms[use + 1], minlength=size)
            counts = counts.reshape(len(chosen), 2 * (FORMS + 1))
            seen = counts.any(axis=1)
            vectors = _sparse(counts[seen])
            yield pa.RecordBatch.from_arrays(
                [batch.words.take(pa.array(chosen[seen])), pa.array(vectors, pa.binary())],
                names=["word", "vector"],
            )

    return run


def _sum_batches(batches):
    """Sum the vectors of each word. Rows come sorted by word; the last word of a batch waits."""
    last, held = None, None
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        starts = [i for i, w in enumerate(words) if not i or w != words[i - 1]]
        vectors = _dense(batch.column("vector").to_pylist())
        sums = np.add.reduceat(vectors, starts, axis=0, dtype=np.int64)
        names = [words[i] for i in starts]
        if last == names[0]:
            sums[0] += held
        elif last is not None:
            names, sums = [last, *names], np.concatenate((held[None], sums))
        last, held = names[-1], sums[-1]
        yield _sum_rows(names[:-1], sums[:-1])
    if last is not None:
        yield _sum_rows([last], held[None])


def _sum_rows(words, sums):
    vectors = pa.array([v.astype("<i8").tobytes() for v in sums], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), vectors], names=["word", "vector"])


def _vectors(batch) -> np.ndarray:
    kinds = batch.column("vector").to_pylist()
    return np.frombuffer(b"".join(kinds), "<i8").reshape(len(kinds), -1)


def _assign(batch, log_q: np.ndarray | None) -> np.ndarray:
    """Class of each word: the likeliest, at first one by its form."""
    if log_q is None:
        words = batch.column("word").to_pylist()
        return np.array([form(w) * (CLASSES // FORMS) + crc32(w) % (CLASSES // FORMS) for w in words])
    return (_vectors(batch).astype(np.float64) @ log_q.T).argmax(axis=1)


def _class_batches(log_q):
    def run(batches):
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch)
            if sums is None:
                sums = np.zeros((CLASSES, vectors.shape[1]), np.int64)
            np.add.at(sums, _assign(batch, log_q), vectors)
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(CLASSES)),
                    pa.array(sums.tolist(), pa.list_(pa.int64())),
                ],
                names=["class", "sums"],
            )

    return run


def _word_batches(log_q):
    def run(batches):
        for batch in batches:
            classes = _assign(batch, log_q).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(classes, pa.int64())], names=["word", "class"]
            )

    return run


def exchange(contexts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(word, class) after some rounds; a round fetches one row of counts per class."""
    log_q = None
    for _ in range(rounds):
        parts = contexts.mapInArrow(_class_batches(log_q), "class long, sums array<long>")
        one = parts.select("class", F.posexplode("sums").alias("at", "n"))
        counts = np.zeros((CLASSES, 2 * (FORMS + 1)))
        for c, at, n in one.groupBy("class", "at").agg(F.sum("n")).collect():
            counts[c, at] = n
        overall = counts.sum(axis=0) + 1
        smooth = counts + overall / overall.sum()
        log_q = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return contexts.mapInArrow(_word_batches(log_q), "word binary, class long")


def _transition_batches(batches):
    sums = np.zeros((_END + 1) ** 2, np.int64)
    for batch in _rows(batches, _CLASSED):
        classes = batch.with_ends(batch.classes, _END)
        before = np.concatenate((np.array([_END], np.int32), classes[:-1]))
        pairs = before * np.int32(_END + 1) + classes
        sums += np.bincount(pairs[batch.train_tokens()], minlength=len(sums))
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])


class Model:
    """Log10 tables of the class model; their size does not depend on the corpus."""

    def __init__(self, pairs: np.ndarray, types: np.ndarray, tokens: int, known: int, docs: int):
        """``types``: known rare words by form; ``known``: distinct training tokens."""
        share = pairs.sum(axis=0) + 1e-3
        share /= share.sum()
        rows = pairs + PRIOR * share
        self.transition = np.log10(rows / rows.sum(axis=1, keepdims=True))
        self.class_count = pairs.sum(axis=0)
        self.tokens, self.known, self.docs = tokens, known, docs
        given = DISCOUNT * types
        with np.errstate(divide="ignore", invalid="ignore"):
            unknown = given / self.class_count[CLASSES:_END]
        unknown[~(unknown > 0)] = 1.0  # no known word in this class
        self.unknown = np.log10(unknown)

    def emissions(self, batch: _Batch) -> np.ndarray:
        counts = batch.totals.astype(np.float64)
        rare = batch.classes >= CLASSES
        counts[rare] -= DISCOUNT
        of_class = self.class_count[batch.classes]
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log10(counts / of_class)
        return np.where(batch.totals > 0, known, self.unknown[batch.forms])

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.known + 1))


def _score_batches(model: Model):
    def run(batches):
        for batch in _rows(batches, _CLASSED):
            sizes = batch.sizes + 1
            starts = np.cumsum(sizes) - sizes
            classes = batch.with_ends(batch.classes, _END)
            before = np.concatenate((np.array([_END], np.int32), classes[:-1]))
            each = model.transition[before, classes]
            each = each + batch.with_ends(model.emissions(batch), 0.0)
            base = batch.with_ends(model.base(batch.totals), model.base(np.array(model.docs)))
            known = batch.with_ends(batch.totals > 0, model.docs > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.docs,
                    pa.array(batch.held),
                    pa.array(sizes),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.full(len(sizes), model.tokens)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(each, starts)),
                ],
                names=[
                    "doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                    "base_score", "score",
                ],
            )

    return run


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double"
)


def score(docs: DataFrame, least: int = MIN_COUNT, limit: int = BATCH) -> DataFrame:
    """Every document's base score and class-model score."""
    packed = pack(docs, limit)
    held = F.size(F.filter("held", lambda h: ~h)).cast("long")
    inner = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    n_docs, n_words = (n or 0 for n in packed.agg(F.sum(held), F.sum(inner)).first())
    words = vocabulary(packed)
    totals = words.select("batch", "pos", F.col("total").alias("value"))
    known = packed.join(_by_batch(totals, "totals"), "batch", "left")

    contexts = known.select(*_WORDED).mapInArrow(
        _context_batches(least), "word binary, vector binary"
    )
    contexts = contexts.repartition("word").sortWithinPartitions("word")
    contexts = contexts.mapInArrow(_sum_batches, "word binary, vector binary")
    contexts = stored_table(contexts, "contexts")
    classes = exchange(contexts)
    frequent = words.filter(F.col("total") >= least).select("batch", "pos", "word")
    classed = frequent.join(classes, "word").select("batch", "pos", F.col("class").alias("value"))
    known = known.join(_by_batch(classed, "classes"), "batch", "left").select(*_CLASSED)

    counts = known.mapInArrow(_transition_batches, "pair long, n long")
    pairs = np.zeros((_END + 1) ** 2)
    for at, n in counts.groupBy("pair").agg(F.sum("n")).collect():  # class pairs at most
        pairs[at] = n
    rare = (F.col("total") > 0) & (F.col("total") < least)
    one = words.filter("first")
    types = np.zeros(FORMS)
    distinct = 0
    for f, n, r in one.groupBy("form").agg(F.count_if(F.col("total") > 0), F.count_if(rare)).collect():
        types[f], distinct = r, distinct + n
    model = Model(
        pairs.reshape(_END + 1, _END + 1),
        types,
        n_words + n_docs,
        distinct + (n_docs > 0),
        n_docs,
    )
    return known.mapInArrow(_score_batches(model), SCORES)


def op6_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op6_class_model": op6_class_model}
ORACLES: dict[str, str] = {}
