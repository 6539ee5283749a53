"""Token-ID files: patched frame-of-reference blocks.

A shard holds the ids of a run of documents, in ascending doc_id order.  Ids go
into blocks of 4,096.  A block subtracts its minimum, packs what is left at the
width that holds a given percentile of its values, and lists the rest as
exceptions (position, value).  The footer indexes the block starts and holds the
documents' ids and lengths, so one document can be read without the others.

Layout, little-endian::

    "WLPF0001"
    block*   base u32, width u8, pad u8, exceptions u16, count u32,
             packed u32[width * 128], positions u16[], values u32[]
    footer   block starts u64[], doc ids i64[], null flags u8[], lengths u32[]
    trailer  blocks u64, documents u64, ids u64, footer start u64, "WLPFEND1"

Packing is vertical: a block is 32 rows of 128 lanes and each lane packs its 32
values into ``width`` words, which numpy does for many blocks at a time.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, scratch, stored, write_atomically

BLOCK, LANES = 4096, 128
MAGIC, END = b"WLPF0001", b"WLPFEND1"
_HEAD, _TAIL = struct.Struct("<IBBHI"), struct.Struct("<QQQQ8s")
#: Blocks that are packed together: a megabyte of ids or so.
GROUP = 256


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 32, lanes) of values below 2**width -> (blocks, width, lanes)."""
    out = np.zeros((len(values), width, LANES), np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, word] |= values[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= values[:, i] >> np.uint32(32 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`pack`."""
    out = np.zeros((len(words), 32, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, i] = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            out[:, i] |= words[:, word + 1] << np.uint32(32 - shift)
        out[:, i] &= mask
    return out


def encode_blocks(ids: np.ndarray, percentile: float = 95.0) -> list[bytes]:
    """uint32 ids -> blocks; only the last may hold fewer than BLOCK ids."""
    n = len(ids)
    count = -(-n // BLOCK)
    full = np.zeros(count * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[(count - 1) * BLOCK]
    grid = full.reshape(count, BLOCK)
    base = grid.min(axis=1, keepdims=True) if count else np.zeros((0, 1), np.uint32)
    rest = grid - base
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    widths = np.frompyfunc(int.bit_length, 1, 1)(np.partition(rest, at, axis=1)[:, at].astype(object)).astype(int) if count else np.zeros(0, int)
    out: list[bytes] = [b""] * count
    for width in np.unique(widths):
        which = np.flatnonzero(widths == width)
        part = rest[which]
        over = part >> np.uint32(width) != 0 if width < 32 else np.zeros(part.shape, bool)
        words = pack(np.where(over, np.uint32(0), part).reshape(-1, 32, LANES), int(width))
        for k, b in enumerate(which):
            places = np.flatnonzero(over[k])
            head = _HEAD.pack(int(base[b, 0]), int(width), 0, len(places), min(BLOCK, n - b * BLOCK))
            out[b] = b"".join((head, words[k].tobytes(), places.astype("<u2").tobytes(), part[k][places].astype("<u4").tobytes()))
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    heads = [_HEAD.unpack_from(b) for b in blocks]
    grid = np.zeros((len(blocks), BLOCK), np.uint32)
    for width in {h[1] for h in heads}:
        which = [i for i, h in enumerate(heads) if h[1] == width]
        words = np.stack([np.frombuffer(blocks[i], "<u4", width * LANES, _HEAD.size).reshape(width, LANES) for i in which])
        grid[which] = unpack(words, width).reshape(-1, BLOCK)
    for i, (base, width, _, over, _) in enumerate(heads):
        if over:
            at = _HEAD.size + 4 * width * LANES
            grid[i, np.frombuffer(blocks[i], "<u2", over, at)] = np.frombuffer(blocks[i], "<u4", over, at + 2 * over)
        grid[i] += np.uint32(base)
    return np.concatenate([grid[i, : h[4]] for i, h in enumerate(heads)]) if heads else np.zeros(0, np.uint32)


def write_shard(out, documents: Iterable[tuple[int | None, bytes]], percentile: float = 95.0) -> tuple[int, int]:
    """(doc id, ids as little-endian uint32 bytes) in order -> documents, ids written."""
    starts, docs, lengths, buffer, held, at = [], [], [], [], 0, len(MAGIC)
    out.write(MAGIC)

    def flush(last: bool) -> None:
        nonlocal buffer, held, at
        ids = np.frombuffer(b"".join(buffer), "<u4")
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, cut, GROUP * BLOCK):
            for block in encode_blocks(ids[k : min(cut, k + GROUP * BLOCK)], percentile):
                starts.append(at)
                out.write(block)
                at += len(block)
        buffer, held = [ids[cut:].tobytes()], len(ids) - cut

    for doc, ids in documents:
        docs.append(doc)
        lengths.append(len(ids) // 4)
        buffer.append(ids)
        held += len(ids) // 4
        if held >= GROUP * BLOCK:
            flush(False)
    flush(True)
    for a in (np.array(starts, "<u8"), np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), np.array(lengths, "<u4")):
        out.write(a.tobytes())
    out.write(_TAIL.pack(len(starts), len(docs), sum(lengths), at, END))
    return len(docs), sum(lengths)


class Shard:
    """A shard that is open for reading."""

    def __init__(self, file):
        self.file, size = file, file.size()
        blocks, docs, self.n_ids, self.footer, end = _TAIL.unpack(file.read_at(_TAIL.size, size - _TAIL.size))
        if end != END or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token shard")
        raw, at = file.read_at(size - _TAIL.size - self.footer, self.footer), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes
            return a

        self.starts = np.append(take("<u8", blocks), np.uint64(self.footer)).astype(np.int64)
        ids, nulls, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), nulls.tolist())]

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first..last-1."""
        raw, base = self.file.read_at(int(self.starts[last] - self.starts[first]), int(self.starts[first])), int(self.starts[first])
        cuts = [int(s) - base for s in self.starts[first : last + 1]]
        return decode_blocks([raw[a:b] for a, b in zip(cuts, cuts[1:])])

    def ids(self, doc: int) -> np.ndarray:
        """The ids of the shard's doc-th document; reads only its blocks."""
        start, n = int(self.lengths[:doc].sum(dtype=np.int64)), int(self.lengths[doc])
        first, last = start // BLOCK, -(-(start + n) // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK : start - first * BLOCK + n] if n else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc id, start in the shard, length, crc32 of the ids) with a group of blocks in memory."""
        doc, done, crc, start, n_blocks = 0, 0, 0, 0, len(self.starts) - 1
        lengths = self.lengths.tolist()
        for first in range(0, n_blocks, GROUP):
            data = memoryview(self.blocks(first, min(n_blocks, first + GROUP)).astype("<u4").tobytes())
            at = 0
            while doc < len(lengths):
                take = min(4 * (lengths[doc] - done), len(data) - at)
                crc = zlib.crc32(data[at : at + take], crc)
                at += take
                done += take // 4
                if done < lengths[doc]:
                    break
                yield self.doc_ids[doc], start, lengths[doc], crc
                start, doc, done, crc = start + lengths[doc], doc + 1, 0, 0
        for d in range(doc, len(lengths)):
            yield self.doc_ids[d], start, 0, 0


#: A blank or line end between two of these starts a piece of the byte-level pattern, whatever stands around it.
_SOLID = "!-~\xa1-ɏ"
_ODD = re.compile(f"(?:^|[^{_SOLID}])[ \n]|[ \n](?:[^{_SOLID}]|$)")
_CUT = re.compile(f"(?<=[{_SOLID}]) (?=[{_SOLID}])")
_BLANK = re.compile(r"\s")
#: The solid characters of Latin-1, the blank and the line end.
_LATIN = bytes(range(0x21, 0x7F)) + bytes(range(0xA1, 0x100)) + b" \n"


def _is_odd(text: str) -> bool:
    """Whether a blank or line end of the text may lack a solid neighbour on either side."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
        return True
    try:
        return bool(text.encode("latin-1").translate(None, _LATIN))
    except UnicodeEncodeError:
        return bool(_ODD.search(text))


#: Marks that never share a piece with a letter before them.
_MARKS = ".,;:!?#$%&*|"


class WordEncoder:
    """Byte-level BPE of whole texts by way of a bounded table of words.

    The tokenizer splits before every single blank between two solid characters,
    and on both sides of such a line end.  So a text's ids are those of its first
    word, of the later words with the blank before them, and of the words that
    open a line with the line end before them.  Only words that the table lacks
    reach the tokenizer, thousands in one call, a line each; a full table is
    emptied, which costs time and changes nothing.
    """

    def __init__(self, path: str, room: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.room, self.first, self.later = room, {}, {}
        self.line_end = self._ids("\n")

    def _ids(self, text: str) -> list[int]:
        # the variant that leaves out the ids' places in the text
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _lines(self, words: list[str], blank: str):
        """The ids of each word, as bytes: one call, cut at the line ends."""
        ids = np.array(self._ids("\n".join([blank + w for w in words])), "<u4")
        cuts = np.flatnonzero(ids == self.line_end[0]).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]

    def _learn(self, table: dict, new: set, blank: str) -> None:
        """Put the words, none of which is in ``table``, there."""
        # marks after a word's last letter are pieces of their own: the word without them is learnt once
        cut = {w: base for w in new if (base := w.rstrip(_MARKS)) != w and base[-1:].isalpha()}
        plain = {*new.difference(cut), *cut.values()}
        if len(table) + len(new) + len(plain) > self.room:
            table.clear()
        self._learn_plain(table, [w for w in plain if w not in table], blank)
        marks = {}
        for w, base in cut.items():
            tail = w[len(base) :]
            if tail not in marks:
                marks[tail] = np.array(self._ids(tail), "<u4").tobytes()
            table[w] = table[base] + marks[tail]

    def _learn_plain(self, table: dict, new: list, blank: str) -> None:
        end = np.array(self.line_end, "<u4").tobytes()
        opening = [w for w in new if w[:1] == "\n"]
        plain = [w for w in new if w[:1] != "\n"]
        for part, lead, cut, head in ((plain, blank, 0, b""), (opening, "", 1, end)):
            # a word that is empty or holds any blank would blur the cuts
            odd = {w for w in part if len(w) == cut or _BLANK.search(w, cut)}
            for w in odd:
                table[w] = np.array(self._ids((blank if not cut else "") + w), "<u4").tobytes()
            part = [w for w in part if w not in odd] if odd else part
            for a in range(0, len(part), 4096):
                some = part[a : a + 4096]
                ids = self._lines([w[cut:] for w in some], lead)
                if len(ids) != len(some):
                    raise ValueError("the tokenizer merged a line end into a word")
                table.update(zip(some, [head + x for x in ids] if head else ids))

    def _codes(self, table: dict, split: list[list[str]], blank: str) -> list[list[bytes]]:
        got = [list(map(table.get, words)) for words in split]
        lacking = [k for k, g in enumerate(got) if None in g]
        if lacking:
            self._learn(table, {w for k in lacking for w, x in zip(split[k], got[k]) if x is None}, blank)
            for k in lacking:
                got[k] = [table[w] if x is None else x for w, x in zip(split[k], got[k])]
        return got

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        ends = np.cumsum([len(t) for t in texts]) // 4_000_000
        for _, group in itertools.groupby(range(len(texts)), ends.__getitem__):
            split = [_CUT.split(t) if _is_odd(t) else t.replace("\n", " \n").split(" ") for t in map(texts.__getitem__, group)]
            opening = self._codes(self.first, [[words.pop(0)] for words in split], "")
            for head, rest in zip(opening, self._codes(self.later, split, " ")):
                yield head[0] + b"".join(rest)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, percentile: float = 95.0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards to ``folder``; returns the manifest.

    The manifest (shard, path, n_docs, n_ids, first_id) lists shards in doc_id
    order; first_id is the number of ids before the shard.  Documents are dealt
    by ranges of (doc_id, hash of the text), so no id is too frequent for it.
    Null text is empty; a null doc_id comes first; rows with the same doc_id
    stand together, each a document of its own; an empty table gives no shard
    with documents.  Columns besides doc_id and text are not read.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path, totals, encoder, end = f"{folder}/shard-{shard:06d}.wlpf", [], _encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def documents():
            for batch in batches:
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                    yield doc, ids + end

        write_atomically(path, lambda out: totals.extend(write_shard(out, documents(), percentile)))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [totals[0]], "n_ids": [totals[1]]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stored(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "token-manifest")
    # one row a shard: what is gathered for the running sum is the list of files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.where("n_docs > 0").withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the shards."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist()):
                system, name = file_system(path)
                with system.open_input_file(name) as file:
                    rows = []
                    for doc, start, n, crc in Shard(file).documents():
                        rows.append((doc, first + start, n, crc))
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    spark = manifest.sparkSession
    shards = max(1, manifest.count())
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    return manifest.select("shard", "path", "first_id").repartitionByRange(tasks, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, scratch(spark, "tokens"), tokenizer))
