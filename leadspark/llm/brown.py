"""Class-based n-gram scoring with Brown classes found by the exchange algorithm.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)). Every word of the training texts has a class by its
neighbours. First the core: the FREQUENT most frequent words, units of their own, and the rest in BUCKETS units by
their last three bytes, are assigned to classes by exchange: each in turn moves to the class that most raises the likelihood
of all unit bigrams, until a round moves none. Then every other word, however many there are, is taken out of its bucket and
moved by the same criterion, from the counts of the classes before and after it in all training texts, with the core's classes held.

Texts are cut into words twice: once to count them, and once to be written as numbers of words, from which all later
steps work on whole slices. They are then written as sequences of classes, and class bigrams counted on those of the training texts. Transitions
are smoothed towards class frequencies, emissions by adding one, with one more place for unknown words:
(c(w) + 1) / (N(class) + V(class) + 1). Only words never seen in training go by their last bytes. The words of highest
count travel with the tasks; all others' classes and counts come by a join on the word, never a collected vocabulary.

Defined results: a null text is empty, and an empty text is one end token; a null doc_id counts as the empty text
in the split and so trains; a very long text is scored whole; a word that fits several classes equally has the first;
repeated rows give one result row each; other columns of the documents are ignored. Without training texts every
probability is that of the smoothing alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import little_disk, map_batches, materialise, record, remainder, short_batches

#: Units of frequent words, units of the rest, classes besides that of the end token, rounds of exchange at most.
FREQUENT, BUCKETS, CLASSES, ROUNDS = 1023, 512, 48, 12
#: Words whose counts travel with the tasks, the end token included; their numbers are written in two bytes.
LOCAL = 1 << 16
#: A task hands on its counts when it holds so many bytes of words, about.
HELD = 48_000_000
#: The end token: no word holds white space.
END = b"\n"
#: What is counted of each row.
COUNTED = "n_tokens long, n_known long, logs double"


def suffix_bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


#: By byte: whether it is white space, what it is in lower case (A-Z alone change), and its step of crc32.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries, one after another, and where each begins and the last ends. Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The binaries whose bytes stand in data one after another; ends: where each begins and the last ends, in items of data."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, as words_of() gives them for each, and how many each text has."""
    data, ends = flat(column)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(data))]  # no word goes on in the next text
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    words = binaries(LOWER[data[inside]], np.concatenate(([0], np.cumsum(last - first + 1))))
    return words, np.diff(np.searchsorted(first, ends))


def suffix_buckets(words: pa.Array) -> np.ndarray:
    """suffix_bucket() of each word."""
    data, ends = flat(words)
    length, crc = np.diff(ends), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        has = length >= back
        crc[has] = _CRC[(crc[has] ^ data[ends[1:][has] - back]) & 255] ^ (crc[has] >> 8)
    return (~crc % BUCKETS).astype(np.uint16)


def word_counts(documents: DataFrame, train: Column) -> DataFrame:
    """word (binary), n: the tokens of the training texts, the end token included."""

    def make():
        held: list[pa.Array] = []
        size = texts = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            held.clear()
            size = 0
            return record(word=found.field("values"), n=found.field("counts"))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nonlocal size, texts
            words, _ = split(batch.column("text"))
            held.append(words)
            size += words.nbytes + 16 * len(words)
            texts += batch.num_rows
            return flush() if size > HELD else None

        def finish() -> pa.RecordBatch | None:
            if not texts:
                return None
            held.append(pa.array([END] * texts, pa.binary()))
            return flush()

        return each, finish

    counted = map_batches(documents.where(train).select(F.col("text").cast("string").alias("text")), make, "word binary, n long")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "brown-words")


def mark(documents: DataFrame, is_train: Column, local: list[bytes], counts: np.ndarray) -> DataFrame:
    """row (a number of its own), doc_id, train, n_tokens, and of its local words n_known, logs (the sum of log10(c + 1)) for
    each row of documents, and its words: classes (for now two bytes a word, its place in `local` or 0, without the end), rare (the other words, each once),
    ends (two bytes each, their suffix buckets) and uses (four bytes for each 0, a place in rare)."""
    shared = documents.sparkSession.sparkContext.broadcast((local, np.log10(counts + 1.0), counts > 0))

    def make():
        local, logs, known = shared.value
        local, row = pa.array(local, pa.binary()), TaskContext.get().partitionId() << 40
        end_logs, end_known = logs[0], int(known[0])
        logs = np.concatenate(([0.0], logs[1:]))  # 0 now is a word that isn't there

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            rows, (words, sizes) = batch.num_rows, split(batch.column("text"))
            at = pc.index_in(words, value_set=local).fill_null(0).to_numpy()
            owner, elsewhere = np.repeat(np.arange(rows), sizes), np.flatnonzero(at == 0)
            others = words.take(pa.array(elsewhere)).dictionary_encode()
            listed, use = np.unique(owner[elsewhere] * max(len(others.dictionary), 1) + others.indices.to_numpy(), return_inverse=True)
            begins = np.searchsorted(listed, np.arange(rows + 1) * max(len(others.dictionary), 1))
            listed %= max(len(others.dictionary), 1)
            used = np.concatenate(([0], np.cumsum(np.bincount(owner[elsewhere], minlength=rows))))
            numbers = pa.array(np.arange(row, row + rows))
            row += rows
            return record(
                row=numbers, doc_id=batch.column("doc_id"), train=batch.column("train"), n_tokens=sizes + 1, n_known=np.bincount(owner[at > 0], minlength=rows) + end_known,
                logs=np.bincount(owner, logs[at], rows) + end_logs, classes=binaries(at.astype(np.uint16), np.concatenate(([0], np.cumsum(sizes)))),
                rare=pa.ListArray.from_arrays(pa.array(begins, pa.int32()), others.dictionary.take(pa.array(listed))), ends=binaries(suffix_buckets(others.dictionary)[listed], begins),
                uses=binaries((use - begins[owner[elsewhere]]).astype(np.int32), used),
            )

        return each

    docs = documents.select("doc_id", is_train.alias("train"), F.col("text").cast("string").alias("text"))
    return materialise(map_batches(docs, make, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, train boolean, {COUNTED}, classes binary, rare array<binary>, ends binary, uses binary"), "brown-marked")


class _Words:
    """The words of a slice of mark(): at (place in local or 0), and for each 0 `elsewhere`, its place among all words
    listed in the slice, whose buckets are `ends`; begins: where each row's listed words begin."""

    def __init__(self, batch: pa.RecordBatch):
        self.at = flat(batch.column("classes"))[0].view(np.uint16)
        ends, begins = flat(batch.column("ends"))
        uses, used = flat(batch.column("uses"))
        self.ends, self.begins = ends.view(np.uint16), begins // 2
        self.used = np.diff(used) // 4
        self.elsewhere = uses.view(np.int32) + np.repeat(self.begins[:-1], self.used)
        self.inner = np.ones(1 + len(self.at) + batch.num_rows, bool)
        self.inner[np.concatenate(([0], np.cumsum(batch.column("n_tokens").to_numpy())))] = False

    def spread(self, local: np.ndarray, listed: np.ndarray) -> np.ndarray:
        """What local has by place, and listed by listed word, for each word; a 0 stands first and after each text."""
        of = local[self.at]
        of[self.at == 0] = listed[self.elsewhere]
        out = np.zeros(len(self.inner), local.dtype)
        out[self.inner] = of
        return out


def unit_bigrams(marked: DataFrame, core: int, local: list[bytes]) -> np.ndarray:
    """Counts of adjacent units, a square of core + BUCKETS; core: how many of `local` have a unit of their own, END first."""
    n = core + BUCKETS
    units = np.concatenate((np.arange(core), core + suffix_buckets(pa.array(local[core:], pa.binary())).astype(np.int64)))
    shared = marked.sparkSession.sparkContext.broadcast(units)

    def make():
        units = shared.value
        total = np.zeros(n * n, np.int64)

        def each(batch: pa.RecordBatch) -> None:
            words = _Words(batch)
            u = words.spread(units, words.ends + np.int64(core))
            np.add.at(total, u[:-1] * n + u[1:], 1)

        def finish() -> pa.RecordBatch:
            found = np.flatnonzero(total)
            return record(pair=found, n=total[found])

        return each, finish

    rows = map_batches(marked.where("train").select("n_tokens", "classes", "ends", "uses"), make, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most n * n rows
    out = np.zeros(n * n)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit; unit 0 (the end token) alone has class 0. Maximises the sum of f(N(c, d)) less those of
    f(N(c, .)) and f(N(., d)), with f(x) = x log x."""
    n, k = len(bigrams), classes + 1
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = [int(u) for u in np.argsort(-weight, kind="stable") if u != 0]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % classes
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # unit by class of its successor, of its predecessor
    table = member.T @ right
    diagonal = np.arange(k)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = of[u], bigrams[u, u]
            r, l = right[u].copy(), left[u].copy()  # noqa: E741
            table[a] -= r
            table[:, a] -= l
            table[a, a] += own
            r[a] -= own
            l[a] -= own
            f = _xlogx(table)
            by_row, by_column = _xlogx(table + r) - f, _xlogx(table + l[:, None]) - f
            gain = by_row.sum(axis=1) - by_row[diagonal, diagonal] + by_column.sum(axis=0) - by_column[diagonal, diagonal]
            own_cell = table[diagonal, diagonal]
            gain += _xlogx(own_cell + r + l + own) - f[diagonal, diagonal]
            out, into = table.sum(axis=1), table.sum(axis=0)
            gain -= _xlogx(out + r.sum() + own) - _xlogx(out) + _xlogx(into + l.sum() + own) - _xlogx(into)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            b = a if gain[b] <= gain[a] + 1e-9 else b
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                right[:, a] -= bigrams[:, u]
                right[:, b] += bigrams[:, u]
                left[:, a] -= bigrams[u]
                left[:, b] += bigrams[u]
        if not moved:
            break
    unseen = np.flatnonzero(weight == 0)
    unseen = unseen[unseen != 0]
    if len(unseen) and len(unseen) < n - 1:
        rare = np.bincount(of[order], weights=np.minimum(weight[order], 1), minlength=k)
        of[unseen] = int(np.argmax(rare[1:])) + 1
    return of


def criterion(classes: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """By slot (class before, then class after) and class: what each such neighbour of a word adds to the likelihood
    when the word has the class. classes: by unit. A word's gain is the sum over its neighbours, log N(c, d) - log N(c)
    - log N(d), as in the exchange, with half a count added everywhere. The end token's class is closed."""
    k = CLASSES + 1
    member = np.zeros((len(classes), k))
    member[np.arange(len(classes)), classes] = 1
    table = member.T @ bigrams @ member + 0.5
    gain = np.log(table) - np.log(table.sum(axis=1, keepdims=True)) - np.log(table.sum(axis=0, keepdims=True))
    out = np.concatenate([gain, gain.T])
    out[:, 0] = -np.inf
    return out


def assign(marked: DataFrame, core: int, local: list[bytes], classes: np.ndarray, gains: np.ndarray) -> DataFrame:
    """word, n, class: every word of the training texts outside the core, its count, and its best class by `gains`.

    Tasks count the neighbours' classes of their words and hand them on packed, a row a word: a byte for each slot, four
    for its count. These are dealt out by word and summed where they arrive, a sorted run at a time."""
    slots = 2 * (CLASSES + 1)
    shared = marked.sparkSession.sparkContext.broadcast((local, by_place(classes, core, local), classes[core:].astype(np.uint8)))

    def count():
        local, of, buckets = shared.value
        total = np.zeros(len(local) * slots, np.int64)  # of local words, which are known; others are found
        words: list[pa.Array] = []
        found: list[np.ndarray] = []  # a word's place in `words` and a slot
        size = listed = 0

        def counted() -> tuple[pa.Array, np.ndarray, np.ndarray]:
            nonlocal size, listed
            coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
            place, slot = np.divmod(np.concatenate([np.zeros(0, np.int64), *found]), slots)
            words.clear()
            found.clear()
            size = listed = 0
            keys, times = np.unique(coded.indices.to_numpy()[place] * np.int64(slots) + slot, return_counts=True)
            return coded.dictionary, keys, times

        def packed(names: pa.Array, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            begins = np.searchsorted(keys, np.arange(len(names) + 1) * slots)
            return record(word=names, slots=binaries((keys % slots).astype(np.uint8), begins), times=binaries(times.astype(np.uint32), begins))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nonlocal size, listed
            got = _Words(batch)
            c = got.spread(of, buckets[got.ends]).astype(np.int64)
            at = np.flatnonzero(got.inner)
            before, after = c[at - 1], c[at + 1] + slots // 2
            own, far = got.at >= core, got.at == 0
            for slot in (before, after):
                np.add.at(total, got.at[own] * np.int64(slots) + slot[own], 1)
                found.append((got.elsewhere + np.int64(listed)) * slots + slot[far])
            words.append(batch.column("rare").flatten())
            listed += len(words[-1])
            size += 16 * len(got.elsewhere) + words[-1].nbytes + 60 * len(words[-1])
            return packed(*counted()) if size > HELD else None

        def finish() -> pa.RecordBatch:
            names, keys, times = counted()
            more = np.flatnonzero(total)
            used, place = np.unique(more // slots, return_inverse=True)
            own = pa.array(local, pa.binary()).take(pa.array(used))
            return packed(pa.concat_arrays([names, own]), np.concatenate((keys, (len(names) + place) * slots + more % slots)), np.concatenate((times, total[more])))

        return each, finish

    thin = marked.where("train").select("n_tokens", "classes", "rare", "ends", "uses")
    rows = map_batches(thin, count, "word binary, slots binary, times binary").repartition("word").sortWithinPartitions("word")
    before = slots // 2  # slots of the class before: one for each occurrence
    gains = np.maximum(gains, -1e300)

    def best():
        held: list = [None, None]  # the last word, which may go on in the next slice, and its counts

        def out(words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            return record(word=words, n=counts[:, :before].sum(axis=1).astype(np.int64), **{"class": np.argmax(counts @ gains, axis=1).astype(np.int32)})

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ws = batch.column("word")
            new = np.concatenate(([True], pc.not_equal(ws[1:], ws[:-1]).to_numpy(zero_copy_only=False)))
            words = ws.filter(pa.array(new))
            slot, begins = flat(batch.column("slots"))
            at = np.repeat((np.cumsum(new) - 1) * slots, np.diff(begins)) + slot
            counts = np.bincount(at, flat(batch.column("times"))[0].view(np.uint32), len(words) * slots).reshape(-1, slots)
            if held[0] is not None and held[0][0] == words[0]:
                counts[0] += held[1]
            elif held[0] is not None:
                words, counts = pa.concat_arrays([held[0], words]), np.concatenate((held[1][None], counts))
            held[0], held[1] = words[-1:], counts[-1]
            return out(words[:-1], counts[:-1]) if len(words) > 1 else None

        def finish() -> pa.RecordBatch | None:
            return out(held[0], held[1][None]) if held[0] is not None else None

        return each, finish

    return materialise(map_batches(rows, best, "word binary, n long, class int"), "brown-classes")


def by_place(classes: np.ndarray, core: int, local: list[bytes]) -> np.ndarray:
    """The core's class of each local word: its own, or that of its bucket. classes: by unit."""
    return np.concatenate((classes[:core], classes[core:][suffix_buckets(pa.array(local[core:], pa.binary()))])).astype(np.uint8)


@dataclass
class Model:
    marked: DataFrame  # the documents' words as mark() writes them
    rest: DataFrame  # word, n, class of the training words outside the core
    n_tokens: int
    n_words: int
    local: list[bytes]  # words whose counts travel, END first, most frequent first
    class_of: np.ndarray  # by place: local words, then suffix buckets, for words never seen
    emission: np.ndarray  # log10 of N(class) + V(class) + 1
    tokens: np.ndarray  # N(class)


def train(documents: DataFrame, is_train: Column) -> Model:
    """The words' classes and counts; the transitions come of transitions()."""
    counts = word_counts(documents, is_train)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(max(LOCAL - 1, FREQUENT)).toArrow()
    ends = counts.where(F.col("word") == F.lit(END)).first()
    local = [END, *(bytes(w) for w in top["word"].to_pylist())]
    local_counts = np.array([ends["n"] if ends else 0, *top["n"].to_pylist()], np.int64)
    core = min(1 + FREQUENT, len(local))
    marked = mark(documents, is_train, local, local_counts)
    bigrams = unit_bigrams(marked, core, local)
    of = exchange(bigrams)
    rest = assign(marked, core, local, of, criterion(of, bigrams))
    more = rest.orderBy(F.desc("n"), "word").limit(len(local) - core).toArrow()  # the rest of local, in the same order
    class_of = np.concatenate([of[:core], more["class"].to_numpy(), of[core:]]).astype(np.int64)
    tokens, words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    np.add.at(tokens, of[:core], local_counts[:core])
    np.add.at(words, of[:core], local_counts[:core] > 0)
    for c, n, v in rest.groupBy("class").agg(F.sum("n"), F.count("*")).collect():  # a row a class
        tokens[c] += n
        words[c] += v
    return Model(marked, rest, int(total), int(distinct), local, class_of, np.log10(tokens + words + 1), tokens)


def sequences(model: Model) -> DataFrame:
    """doc_id, train, n_tokens, n_known, logs (the sum of log10(c + 1)) and classes (a byte a token, the end's last) for
    each row. Each text's list of words that don't travel joins the classes word by word, comes back to its text, without
    words, by the number that its row was written with, and is filled in; a word never seen has the class of its ending."""
    marked, n_local = model.marked, len(model.local)
    shared = marked.sparkSession.sparkContext.broadcast((model.class_of[:n_local].astype(np.uint8), model.class_of[n_local:].astype(np.uint8)))
    asked = marked.select("row", F.posexplode("rare").alias("p", "word"))
    answers = asked.join(model.rest, "word").groupBy("row").agg(F.collect_list(F.struct("p", "n", "class")).alias("found"))  # no more than the text's words
    filled = marked.drop("rare").join(answers, "row", "left").drop("row")

    def fill():
        class_of, buckets = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            """All rows at once: what is listed, used and marked in them follows one order."""
            got, rows, found = _Words(batch), batch.num_rows, batch.column("found")
            of, count = buckets[got.ends], np.zeros(len(got.ends), np.int64)  # a listed word is known if it is found
            answers, sizes = found.flatten(), np.nan_to_num(pc.list_value_length(found).to_numpy(zero_copy_only=False)).astype(np.int64)
            at = np.repeat(got.begins[:-1], sizes) + answers.field("p").to_numpy()
            of[at], count[at] = answers.field("class").to_numpy(), answers.field("n").to_numpy()
            owner, times = np.repeat(np.arange(rows), got.used), count[got.elsewhere]
            known = batch.column("n_known").to_numpy() + np.bincount(owner, times > 0, rows).astype(np.int64)
            logs = batch.column("logs").to_numpy() + np.bincount(owner, np.log10(times + 1.0), rows)
            seqs = binaries(got.spread(class_of, of)[1:], np.concatenate(([0], np.cumsum(batch.column("n_tokens").to_numpy()))))
            return record(doc_id=batch.column("doc_id"), train=batch.column("train"), n_tokens=batch.column("n_tokens"), n_known=known, logs=logs, classes=seqs)

        return each

    kind = dict(marked.dtypes)["doc_id"]
    return materialise(map_batches(filled, fill, f"doc_id {kind}, train boolean, {COUNTED}, classes binary"), "brown-sequences")


def transitions(written: DataFrame, model: Model) -> np.ndarray:
    """log10 P(class | class before), from all class bigrams of the training texts; an end token stands before each."""
    k = CLASSES + 1

    def make():
        total = np.zeros(k * k)

        def each(batch: pa.RecordBatch) -> None:
            joined = np.concatenate((np.zeros(1, np.int64), flat(batch.column("classes"))[0]))
            total[:] += np.bincount(joined[:-1] * k + joined[1:], minlength=k * k)

        def finish() -> pa.RecordBatch:
            found = np.flatnonzero(total)
            return record(pair=found, n=total[found])

        return each, finish

    rows = map_batches(written.where("train").select("classes"), make, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most k * k rows
    table = np.zeros(k * k)
    table[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    table = table.reshape(k, k)
    overall = (model.tokens + 1) / (model.tokens + 1).sum()
    return np.log10((table + k * overall) / (table.sum(axis=1, keepdims=True) + k))


def score(written: DataFrame, model: Model, transition: np.ndarray) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score for each row of sequences()."""
    shared = written.sparkSession.sparkContext.broadcast((transition, model.emission))

    def make():
        transition, emission = shared.value
        step = (transition - emission).ravel()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, ends = flat(batch.column("classes"))
            c = np.concatenate((np.zeros(1, np.int64), data))  # an end stands before each text
            out = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(ends)), step[c[:-1] * len(emission) + c[1:]], batch.num_rows)
            return record(doc_id=batch.column("doc_id"), train=batch.column("train"), n_tokens=batch.column("n_tokens"), n_known=batch.column("n_known"), logs=batch.column("logs"), model=out)

        return each

    kind = dict(written.dtypes)["doc_id"]
    rows = map_batches(written, make, f"doc_id {kind}, train boolean, n_tokens long, n_known long, logs double, model double")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(model.n_tokens + model.n_words + 1))
    return rows.select("doc_id", "train", "n_tokens", "n_known", base.alias("base_score"), (F.col("logs") + F.col("model")).alias("score"))


def perplexity(scored: DataFrame) -> DataFrame:
    """scored with the perplexity of each text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def report(documents: DataFrame) -> DataFrame:
    train_row = remainder(F.col("doc_id"), 7) != 2
    with short_batches(documents.sparkSession), little_disk(documents.sparkSession):
        model = train(documents, train_row)
        written = sequences(model)
        transition = transitions(written, model)
    scored = score(written, model, transition)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
