"""Language-model scores from a Brown class-based bigram model.

A word's probability after a word of class d is P(c | d) * P(w | c), c its class.
The corpus is read once into chunks: a chunk holds some documents as indices into
its own list of distinct words (64-bit hashes).  From then on

* the core, words that make up at least ``min_share`` of all training tokens and so
  at most 1 / min_share of them, is assigned to classes by exchange in rounds: tasks
  count each such word's left and right neighbours by class, the counts are summed by
  blocks of words, and each block moves half of its words to the class with the best
  likelihood, given the class bigrams so far;
* every other word seen twice or more is exchanged once, into the class that its own
  left and right neighbours make likeliest.  Their counts meet by word hash, one row a
  chunk and distinct word, so no word is a hot key, and a chunk gets back counts and
  classes of its own words only.  So the clustered vocabulary grows with the corpus;
* words seen once or never have no neighbours to speak of: they belong to classes by
  their shape, and each such class keeps room for words not seen;
* class bigrams are counted again with the classes of all words, and a last pass
  scores every document.

Only tables whose size the parameters bound (core, classes) reach the driver or are
sent to tasks whole.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, dropped, file_system, scratch, stored, write_atomically

#: Tokens of a chunk, at least one document.
CHUNK_TOKENS = 1_000_000
#: Share of the training tokens from which a word takes part in every round; others are exchanged once, after the rounds.
MIN_SHARE = 1e-5
CLASSES, ROUNDS, SMOOTHING = 64, 4, 0.1
#: Shapes of words seen once or never, each a class.
SHAPES = 32
#: Core words that one row of summed neighbour counts covers, and tasks whose rows one first sum takes.
WORD_BLOCK, TASKS_SUMMED = 512, 64
#: Words outside the core that one step exchanges: times all neighbour classes and all classes, in doubles.
WORDS_AT_ONCE = 64
#: A word's place in one number, for cheap sorts: the task, its chunk, and the word among the chunk's.
CHUNK_BITS, WORD_BITS = 12, 31
#: A word's neighbours as they travel: class (after the word: plus the number of classes) and count.
_PAIR = np.dtype([("k", "u1"), ("n", "<u4")])
#: The end token's hash, which word_hash gives to no word.
END = 0


def word_hash(word: bytes) -> int:
    """64 bits of xxh3; 0 stands for the end token, so a word never gets it."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) or 1


def shape(word: bytes) -> int:
    """Class of a rare word, 0..SHAPES-1: how it ends in punctuation, and a bucket of its last two letters."""
    last = word[-1:]
    tail = 1 if last in b".!?" else 2 if last in b",;:" else 3 if not (last.isalnum() or last >= b"\x80") else 0
    return 8 * tail + zlib.crc32(word.rstrip(b".!?,;:")[-2:]) % 8


def chunked(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows (chunk, ids, held, starts, hashes, shapes, counts, local).

    ``ids`` and ``held`` (bit 0: held out, bit 1: null id) list the documents, ``starts`` where their
    tokens begin in ``local`` (deflated), which indexes ``hashes``; every document ends with
    the end token.  ``counts``: training tokens of each distinct word.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0

        def row():
            lengths = np.array([len(x) for x in local], np.int64)
            flat = np.concatenate(local)
            train = np.repeat(np.array(held) & 1 == 0, lengths)
            counts = np.bincount(flat[train], minlength=len(table)).astype(np.uint32)
            keys = list(table)
            hashes = np.array([END] + [word_hash(w) for w in keys[1:]], np.uint64)
            shapes = np.array([0] + [shape(w) for w in keys[1:]], np.uint8)
            data = [[(task << CHUNK_BITS) + part], [np.array(ids, np.int64).tobytes()], [np.array(held, np.uint8).tobytes()], [(np.cumsum(lengths) - lengths).astype(np.uint32).tobytes()], [hashes.tobytes()], [shapes.tobytes()], [counts.tobytes()], [zlib.compress(flat.astype(np.uint32).tobytes(), 1)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(data, schema)], schema=schema)

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            words[b""]  # the end token is number 0; no word is empty
            return words, [], [], [], 0

        schema = pa.schema([("chunk", pa.int64())] + [(c, pa.binary()) for c in ("ids", "held", "starts", "hashes", "shapes", "counts", "local")])
        table, ids, held, local, tokens = fresh()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):  # texts become objects one by one
                words = (text.as_py() or b"").lower().split()  # bytes: lowers A-Z, splits at ASCII blanks
                numbers = np.fromiter(map(table.__getitem__, words), np.int32, len(words))
                ids.append(doc or 0)
                held.append(3 if doc is None else int(zlib.crc32(str(doc).encode()) % 10 == 0))
                local.append(np.append(numbers, np.int32(0)))
                tokens += len(words) + 1
                if tokens >= chunk_tokens << (part >> CHUNK_BITS - 3):  # a task of very many chunks has larger ones
                    yield row()
                    part += 1
                    table, ids, held, local, tokens = fresh()
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk long, ids binary, held binary, starts binary, hashes binary, shapes binary, counts binary, local binary")


class Exchange:
    """One round of exchange over a block of words, given class bigrams."""

    def __init__(self, bigrams: np.ndarray):
        self.n = bigrams.astype(float)
        self.left, self.right = self.n.sum(axis=0), self.n.sum(axis=1)  # as successor, as predecessor

    @staticmethod
    def _x(v):
        return np.where(v > 0, v * np.log(np.maximum(v, 1e-300)), 0.0)

    def best(self, before: np.ndarray, after: np.ndarray, own: int, classes: int) -> int:
        """The class in 0..classes-1 that serves the word best.

        before[d]: how often class d comes just before the word; after[d]: just
        after.  The likelihood in classes is sum N(d,c) log N(d,c) - sum N(c)
        log N(c) over both sides; the word's own counts leave its class first.
        """
        n, x = self.n.copy(), self._x
        before, after = before.astype(float), after.astype(float)
        n[:, own] = np.maximum(n[:, own] - before, 0)
        n[own] = np.maximum(n[own] - after, 0)
        column, row = self.left.copy(), self.right.copy()
        column[own] = max(column[own] - before.sum(), 0)
        row[own] = max(row[own] - after.sum(), 0)
        gain = (x(n[:, :classes] + before[:, None]) - x(n[:, :classes])).sum(axis=0) + (x(n[:classes] + after) - x(n[:classes])).sum(axis=1)
        gain -= x(column[:classes] + before.sum()) - x(column[:classes]) + x(row[:classes] + after.sum()) - x(row[:classes])
        top = int(np.argmax(gain))
        return top if gain[top] > gain[own] + 1e-9 else own

    def join(self, counts: np.ndarray, classes: int) -> np.ndarray:
        """For words that are in no class yet the class in 0..classes-1 that serves each best.

        counts (words, 2 * all classes): ``before`` and then ``after`` of each, as in
        :meth:`best`.  Ties go to the lower class.
        """
        x, every = self._x, self.n.shape[0]
        word, k = np.nonzero(counts)
        n = counts[word, k][:, None].astype(float)
        near = np.where((k < every)[:, None], self.n[k % every, :classes], self.n[:classes, k % every].T)
        gain = np.zeros((len(counts), classes))
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        if len(word):
            gain[word[starts]] = np.add.reduceat(x(near + n) - x(near), starts, axis=0)
        before, after = counts[:, :every].sum(axis=1)[:, None].astype(float), counts[:, every:].sum(axis=1)[:, None].astype(float)
        column, row = self.left[:classes], self.right[:classes]
        return np.argmax(gain - (x(column + before) - x(column) + x(row + after) - x(row)), axis=1)


class Core:
    """The words that take part in every round: hashes in order, and by rank counts and classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, class_of: np.ndarray, end_count: int):
        self.order = np.argsort(hashes, kind="stable")
        self.keys, self.counts, self.class_of, self.end_count = hashes[self.order], counts, class_of, end_count

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash its rank, -1 for the end token and -2 for words outside."""
        out = np.full(len(hashes), -2, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            out[hit] = self.order[at[hit]]
        out[hashes == END] = -1
        return out


def _indices(local: bytes) -> np.ndarray:
    """A chunk's tokens as indices into its words; they travel deflated, as the JVM holds several chunks at a time."""
    return np.frombuffer(zlib.decompress(local), np.uint32)


def _contexts(kind: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and after it; an end token also opens the next text."""
    edge = np.array([end], kind.dtype)
    return np.concatenate([edge, kind[:-1]]), np.concatenate([kind[1:], edge])


def _training(held: bytes, starts: bytes, tokens: int) -> np.ndarray:
    begin = np.frombuffer(starts, np.uint32)
    return np.repeat(np.frombuffer(held, np.uint8) & 1 == 0, np.diff(np.append(begin, tokens)))


def _rows(batch, *names):
    """The rows of a batch, as views: chunks are large, and are not copied."""
    import pyarrow as pa

    columns = [batch.column(c) for c in names]
    for i in range(batch.num_rows):
        yield tuple(memoryview(c[i].as_buffer()) if pa.types.is_binary(c.type) else c[i].as_py() for c in columns)
    pa.default_memory_pool().release_unused()


def core_words(chunks: DataFrame, min_share: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training tokens, end tokens among them, and hashes and counts of the words with at least ``min_share`` of them.

    A word with that share keeps half of its uses in chunks where its share is half
    of that, so words are asked for among those only; at most 2 / min_share of them
    can be that frequent, and these are then counted everywhere.
    """

    def locally(batches):
        import pyarrow as pa

        for batch in batches:
            for hashes, counts in _rows(batch, "hashes", "counts"):
                h, n = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)
                often = (n >= min_share / 2 * n.sum()) & (n > 0) & (h != END)
                yield pa.RecordBatch.from_arrays([pa.array([*h[often], END]), pa.array([*n[often], n.sum()])], ["hash", "n"])

    sums = stored(chunks.select("hashes", "counts").mapInArrow(locally, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "core")
    total = (sums.where(f"hash = {END}").agg(F.sum("n")).first()[0]) or 0
    # at most 2 / min_share rows
    candidates = np.array([END] + [r["hash"] for r in sums.where(F.col("hash") != END).where(F.col("n") >= min_share / 2 * total).select("hash").collect()], np.int64)
    dropped(sums)
    keys = np.sort(candidates)
    sent = chunks.sparkSession.sparkContext.broadcast(keys)

    def everywhere(batches):
        import pyarrow as pa

        keys = sent.value
        out = np.zeros(len(keys), np.int64)
        for batch in batches:
            for hashes, counts in _rows(batch, "hashes", "counts"):
                h = np.frombuffer(hashes, np.int64)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[at[hit]] += np.frombuffer(counts, np.uint32)[hit]
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(out[some])], ["hash", "n"])

    counted = chunks.select("hashes", "counts").mapInArrow(everywhere, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).collect()  # as many
    sent.destroy()
    least = max(2, int(np.ceil(min_share * total)))
    core = sorted((-r["n"], r["hash"]) for r in counted if r["hash"] != END and r["n"] >= least)
    ends = next((r["n"] for r in counted if r["hash"] == END), 0)
    return total, ends, np.array([h for _, h in core], np.int64), np.array([-n for n, _ in core], np.int64)


def exchanged(chunks: DataFrame, core: Core, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the core words after ``rounds`` rounds of exchange, and the class bigrams with all other words in their shapes."""
    spark = chunks.sparkSession
    n_classes, end, size = classes + SHAPES + 1, classes + SHAPES, len(core.keys)

    def neighbours(core: Core):
        """Map side of a round: for blocks of words the counts of classes before and after, summed over the task."""
        current = np.concatenate([core.class_of, np.arange(classes, n_classes)]).astype(np.int16)

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            counts = np.zeros((size + SHAPES + 1) * n_classes * 2, np.int64)
            for batch in batches:
                for held, starts, hashes, shapes, local in _rows(batch, "held", "starts", "hashes", "shapes", "local"):
                    code = core.ranks(np.frombuffer(hashes, np.int64))
                    code = np.where(code == -2, size + np.frombuffer(shapes, np.uint8).astype(np.int64), np.where(code == -1, size + SHAPES, code)).astype(np.int32)
                    flat = code[_indices(local)]
                    train = _training(held, starts, len(flat))
                    previous, following = _contexts(current[flat], end)
                    inner = train & (flat != size + SHAPES)
                    counts += np.bincount(flat[train] * np.int64(2 * n_classes) + previous[train], minlength=len(counts))
                    counts += np.bincount(flat[inner] * np.int64(2 * n_classes) + n_classes + following[inner], minlength=len(counts))
            table, part = counts.reshape(-1, 2 * n_classes), TaskContext.get().partitionId() // TASKS_SUMMED
            for a in range(0, len(table), WORD_BLOCK):
                some = table[a : a + WORD_BLOCK]
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array([a // WORD_BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], ["block", "part", "counts"])

        return run

    def summed(pdf):
        import pandas as pd

        out = 0
        for raw in pdf["counts"]:
            out = out + np.frombuffer(zlib.decompress(raw), np.int64).reshape(-1, 2 * n_classes)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [0], "counts": [zlib.compress(out.tobytes(), 1)]})

    def bigrams_of(table: DataFrame, class_of: np.ndarray) -> np.ndarray:
        current = np.concatenate([class_of, np.arange(classes, n_classes)])

        def run(batches):
            import pyarrow as pa

            n = np.zeros((n_classes, n_classes), np.int64)
            for batch in batches:
                for block, raw in _rows(batch, "block", "counts"):
                    part = np.frombuffer(zlib.decompress(raw), np.int64).reshape(-1, 2 * n_classes)
                    kinds = current[block * WORD_BLOCK : block * WORD_BLOCK + len(part)]
                    for c in np.unique(kinds):
                        n[:, c] += part[kinds == c, :n_classes].sum(axis=0)
            yield _cells(n)

        return _square(table.mapInArrow(run, "cell int, n long"), n_classes)

    def moves(current: np.ndarray, step: Exchange, turn: int):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for block, raw in _rows(batch, "block", "counts"):
                    part, first = np.frombuffer(zlib.decompress(raw), np.int64).reshape(-1, 2 * n_classes), block * WORD_BLOCK
                    words = [w for w in range(first, min(size, first + len(part))) if turn == 0 or w % 2 == turn % 2]
                    to = [step.best(part[w - first, :n_classes], part[w - first, n_classes:], int(current[w]), classes) for w in words]
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(to, pa.int64())], ["word", "to"])

        return run

    columns, kind = chunks.select("held", "starts", "hashes", "shapes", "local"), "block int, part int, counts binary"
    for turn in range(rounds + 1):
        first = columns.mapInArrow(neighbours(core), kind).groupBy("block", "part").applyInPandas(summed, kind)
        table = stored(first.groupBy("block").applyInPandas(summed, kind), "neighbours")
        bigrams = bigrams_of(table, core.class_of)
        if turn < rounds and size:
            class_of = core.class_of.copy()
            for r in table.mapInArrow(moves(class_of, Exchange(bigrams), turn), "word long, to long").collect():  # at most the core
                class_of[r["word"]] = r["to"]
            core.class_of = class_of
        dropped(table)
        if not size:
            break
    return core.class_of, bigrams


def _cells(n: np.ndarray):
    import pyarrow as pa

    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n.ravel()[some])], ["cell", "n"])


def _square(cells: DataFrame, n_classes: int) -> np.ndarray:
    out = np.zeros((n_classes, n_classes), np.int64)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # n_classes ** 2 rows
        out[divmod(r["cell"], n_classes)] = r["n"]
    return out


def other_words(chunks: DataFrame, core: Core, bigrams: np.ndarray, classes: int) -> DataFrame:
    """(place, c, class, first): training count and class of each chunk's distinct words outside the core; ``first`` marks one row a word."""
    n_classes, end = classes + SHAPES + 1, classes + SHAPES

    def seen(batches):
        import pyarrow as pa

        names = ["place", "hash", "shape", "n", "near"]
        for batch in batches:
            for chunk, held, starts, hashes, shapes, counts, local in _rows(batch, "chunk", "held", "starts", "hashes", "shapes", "counts", "local"):
                h, kinds = np.frombuffer(hashes, np.int64), classes + np.frombuffer(shapes, np.uint8).astype(np.int16)
                rank = core.ranks(h)
                kinds[rank >= 0] = core.class_of[rank[rank >= 0]]
                kinds[rank == -1] = end
                flat = _indices(local)
                mine = (rank == -2)[flat] & _training(held, starts, len(flat))
                previous, following = (x[mine] for x in _contexts(kinds[flat], end))
                key = flat[mine] * np.int64(2 * n_classes)
                key = np.concatenate([key + previous, key + n_classes + following])
                key, times = np.unique(key, return_counts=True)
                pairs = np.empty(len(key), _PAIR)
                pairs["k"], pairs["n"] = key % (2 * n_classes), times
                at = np.flatnonzero(rank == -2)
                cut = np.searchsorted(key, np.append(at, len(h)) * (2 * n_classes))
                n, s, place = np.frombuffer(counts, np.uint32)[at].astype(np.int64), np.frombuffer(shapes, np.uint8)[at].astype(np.int32), (chunk << WORD_BITS) + at
                for a in range(0, len(at), 50_000):
                    b = min(len(at), a + 50_000)
                    near = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((cut[a : b + 1] - cut[a]) * _PAIR.itemsize).astype(np.int32).tobytes()), pa.py_buffer(pairs[cut[a] : cut[b]].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(place[a:b]), pa.array(h[at[a:b]]), pa.array(s[a:b]), pa.array(n[a:b]), near], names)

    step = Exchange(bigrams)

    def decided(held):
        """Rows of whole words, in order of hash -> their counts and classes."""
        import pyarrow as pa

        place, h, shape, n, near = held
        first = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(first) - 1
        c = np.bincount(group, weights=n).astype(np.int64)
        kind = classes + shape[first].astype(np.int64)
        pairs = np.frombuffer(b"".join(near), _PAIR)
        owner = np.repeat(group, [len(x) // _PAIR.itemsize for x in near])
        for a in range(0, len(c), WORDS_AT_ONCE):
            b = min(len(c), a + WORDS_AT_ONCE)
            x, y = np.searchsorted(owner, (a, b))
            counts = np.bincount((owner[x:y] - a) * (2 * n_classes) + pairs["k"][x:y], weights=pairs["n"][x:y], minlength=(b - a) * 2 * n_classes).reshape(b - a, -1)
            often = np.flatnonzero(c[a:b] > 1)
            kind[a + often] = step.join(counts[often], classes)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (place, c[group], kind[group].astype(np.int32), first)], ["place", "c", "class", "first"])

    def decide(batches):
        held = None
        for batch in batches:
            new = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "hash", "shape", "n")), np.array(batch.column("near").to_pylist(), object)]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            cut = int(np.searchsorted(held[1], held[1][-1])) if len(held[1]) else 0  # the last hash may go on
            if cut:
                yield decided([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held and len(held[1]):
            yield decided(held)

    rows = chunks.mapInArrow(seen, "place long, hash long, shape int, n long, near binary")
    return stored(rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(decide, "place long, c long, class int, first boolean"), "words")


def _deal(words: DataFrame, folder: str) -> None:
    """Write counts and classes of a chunk's words outside the core, in their order, as one file a chunk."""

    def write(batches):
        chunk, parts = None, []

        def close():
            c, kind = (np.concatenate(x) for x in zip(*parts))
            write_atomically(f"{folder}/{chunk}", lambda out: out.write(c.astype("<i8").tobytes() + kind.astype(np.uint8).tobytes()))

        for batch in batches:
            keys, c, kind = (batch.column(x).to_numpy() for x in ("place", "c", "class"))
            keys = keys >> WORD_BITS
            for part in np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1):
                if not len(part):
                    continue
                if parts and keys[part[0]] != chunk:
                    close()
                    parts = []
                chunk = int(keys[part[0]])
                parts.append((c[part], kind[part]))
        if parts:
            close()
        yield from ()

    words.select("place", "c", "class").repartition(F.shiftright("place", WORD_BITS)).sortWithinPartitions("place").mapInArrow(write, "chunk long").write.format("noop").mode("overwrite").save()


def score_documents(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, min_share: float = MIN_SHARE, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from documents whose crc32(doc_id as text) mod 10 is not 0 (a null id
    counts as empty text, crc32 0: held out).  Null and empty texts are their end
    token alone.  Rows that repeat an id are documents of their own.  Without
    training tokens every count is 0 and each score is that of the smoothing.
    An empty table gives no rows.  Other columns are not read.

    Words are told apart by 64-bit hashes.  Classes 0..classes-1 are exchanged, then
    come the shapes and the end token.
    """
    spark = docs.sparkSession
    if classes + SHAPES + 1 > 128:
        raise ValueError(f"at most {127 - SHAPES} classes")
    chunks, folder = stored(chunked(docs, chunk_tokens), "chunks"), scratch(spark, "chunk-words")
    n_classes, end = classes + SHAPES + 1, classes + SHAPES
    total, ends, hashes, counts = core_words(chunks, min_share)
    share = np.cumsum(counts.astype(float))
    label = np.minimum(classes - 1, share / max(1.0, share[-1] if len(share) else 1.0) * classes).astype(np.int64)  # equal token shares to begin with
    core = Core(hashes, counts, label, ends)
    core.class_of, bigrams = exchanged(chunks, core, classes, rounds)
    words = other_words(chunks, core, bigrams, classes)
    spread = words.where("first and c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # n_classes rows
    _deal(words, folder)
    dropped(words)

    # sizes of the classes in tokens and in distinct training words
    tokens, types = np.zeros(n_classes), np.zeros(n_classes)
    np.add.at(tokens, core.class_of, counts.astype(float))
    np.add.at(types, core.class_of, 1)
    for r in spread:
        tokens[r["class"]] += r["c"]
        types[r["class"]] += r["v"]
    known = int(types.sum()) + (ends > 0)
    tokens[end], types[end] = ends, 1
    sent = spark.sparkContext.broadcast(core)

    def local_words(core: Core, chunk: int, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Counts and classes of a chunk's distinct words."""
        rank = core.ranks(np.frombuffer(hashes, np.int64))
        c, kind = np.full(len(rank), core.end_count, np.int64), np.full(len(rank), end, np.int16)
        c[rank >= 0], kind[rank >= 0] = core.counts[rank[rank >= 0]], core.class_of[rank[rank >= 0]]
        others = np.flatnonzero(rank == -2)
        if len(others):
            system, path = file_system(f"{folder}/{chunk}")
            with system.open_input_file(path) as f:
                raw = f.read()
            c[others], kind[others] = np.frombuffer(raw, "<i8", len(others)), np.frombuffer(raw, np.uint8, offset=8 * len(others))
        return c, kind

    def follow(batches):
        n = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for chunk, held, starts, hashes, local in _rows(batch, "chunk", "held", "starts", "hashes", "local"):
                kind = local_words(sent.value, chunk, hashes)[1][_indices(local)]
                train = _training(held, starts, len(kind))
                n += np.bincount(_contexts(kind, end)[0][train] * np.int64(n_classes) + kind[train], minlength=len(n))
        yield _cells(n)

    bigrams = _square(chunks.select("chunk", "held", "starts", "hashes", "local").mapInArrow(follow, "cell int, n long"), n_classes)
    a = SMOOTHING
    # the words of an exchanged class have all been seen; a shape has one word for all unseen ones, the end token stands alone
    unseen = np.concatenate([np.zeros(classes), np.ones(SHAPES), [0.0]])
    transition = np.log10((bigrams + a) / (bigrams.sum(axis=1, keepdims=True) + a * n_classes))
    emission = np.log10(np.maximum(tokens + a * (types + unseen), a))
    base_of = float(np.log10(total + a * (known + 1)))

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, ids, held, starts, hashes, local in _rows(batch, "chunk", "ids", "held", "starts", "hashes", "local"):
                c, kinds = local_words(sent.value, chunk, hashes)
                flat, begin = _indices(local), np.frombuffer(starts, np.uint32).astype(np.int64)
                own, kind = np.log10(c + a), kinds[flat]
                word = np.where(kinds == end, 0.0, own - emission[kinds])  # P(end | its class) is 1
                held = np.frombuffer(held, np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(ids, np.int64), mask=held > 1), pa.array(held & 1 == 1), pa.array(np.diff(np.append(begin, len(flat)))), pa.array(np.add.reduceat((c > 0)[flat].astype(np.int64), begin)),
                        pa.array(np.full(len(held), total, np.int64)), pa.array(np.add.reduceat((own - base_of)[flat], begin)), pa.array(np.add.reduceat(word[flat] + transition[_contexts(kind, end)[0], kind], begin)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    scored = chunks.select("chunk", "ids", "held", "starts", "hashes", "local").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = stored(scored, "scores")
    dropped(chunks)
    delete(spark, folder)
    return out


def op8_class_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
