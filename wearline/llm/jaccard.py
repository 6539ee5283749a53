"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification.

1.  A document becomes its set of five-word shingles (64-bit hashes).  Documents
    with equal sets are one class from here on, stood for by the smallest id.
2.  Every class has ``TREES`` labels of ``DEPTH`` min-hashes each.  A tree is a
    prefix trie: its labels in sorted order, with the length of the prefix that each
    shares with the label before it.  Classes below one node are a run of labels;
    each links to the first of the longest run that it joins, so n classes give n - 1
    links of the trie however many there are.
3.  The search begins with whole labels, the deepest nodes.  Classes that meet are
    verified by their whole shingle sets.  Then prefixes are shortened, and only pairs
    that meet newly are verified.
4.  How far to shorten is learnt from what was found.  A pair of similarity s meets at
    depth d in some tree with probability p = 1 - (1 - s**d)**trees, so each verified
    link stands for (1 - p) / p links that were missed (Horvitz-Thompson; at the
    threshold p is 0.975 even at full depth, so that all links show).  A band of set
    sizes is done when the missed are less than 1 - recall of all; one link at the
    threshold itself is assumed beside those found.  Prefixes go to the depth at which
    every band would be done, and the estimate is made again.  Shortening ends at the latest
    where p reaches the recall for every similarity above the threshold.
5.  Connected components of the verified links are the near-duplicate classes.

Groups of meeting classes that fit a task are verified whole, so pairs within them
never come up again.  Larger groups are written once, in trie order, as blocks of
bounded size; only pairs of blocks that share a node are compared, by tasks that read
the two files.  What leaves a task is a class's number of links, the first class that it
is connected with and a histogram, not the pairs.  No bucket, group or partner list has a cap.
"""

from __future__ import annotations

import functools
import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, delete, dropped, file_system, scratch, stored, write_atomically

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.9995
#: A block of a large group, and what one task verifies of small ones: so many classes or shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 500_000
#: Bins of similarity from the threshold to 1, and bands of set size (powers of two).
BINS, BANDS = 64, 48
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def unfinished(found: np.ndarray, level: int, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> np.ndarray:
    """The bands that the links found at ``level`` leave below the recall; ``found``: links by (band, bin of similarity)."""
    s = threshold + (1 - threshold) * np.arange(found.shape[1]) / found.shape[1]  # a bin counts as its least
    p = 1 - (1 - s**level) ** trees
    missed = (found * (1 - p) / p).sum(axis=1) + (1 - p[0]) / p[0]
    return np.flatnonzero(missed > (1 - recall) * ((found / p).sum(axis=1) + 1 / p[0]))


@functools.cache
def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


class Words(dict):
    """word -> 64-bit hash, in a table that is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle; no word, no shingle."""
    found = text.split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    count = max(1, n - SHINGLE + 1)
    s = np.full(count, np.uint64(min(n, SHINGLE)))
    with np.errstate(over="ignore"):
        for k in range(min(n, SHINGLE)):
            s = (s ^ h[k : k + count]) * _P[k]
            s ^= s >> np.uint64(29)
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])]


def signature(s: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hashes of a shingle set, 16 bits of each."""
    a, b = _coefficients(count)
    out, x = np.full(count, np.uint32(2**32 - 1)), (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(x), 512):  # keeps the products in cache
        part = x[start : start + 512]
        np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    # mixed before the cut, since minima are small numbers
    with np.errstate(over="ignore"):
        return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def signed(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_hash, set_key (128-bit hash of the shingle set; null without words), n, labels (binary)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        words = Words()
        for batch in batches:
            keys, sizes, labels = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py() or b"", words)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                labels.append(signature(s, trees * depth).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.binary())], ["doc_id", "text_hash", "set_key", "n", "labels"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, text_hash long, set_key binary, n long, labels binary")


class Forest:
    """Classes of one task that links connect: a union-find over their places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class Verifier:
    """Similarities among the shingle sets of one task, and what follows from them."""

    def __init__(self, sets: list[np.ndarray], copies: np.ndarray, threshold: float = THRESHOLD):
        n = len(sets)
        self.sizes, self.copies, self.threshold = np.array([len(s) for s in sets], np.int64), copies, threshold
        # shingles of one set only cannot meet; the others get small numbers
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        number = np.empty(len(flat), np.int64)
        number[order] = np.cumsum(first) - 1
        often = np.bincount(number)[number] > 1
        new = np.cumsum(np.bincount(number) > 1) - 1
        owner = np.repeat(np.arange(n), self.sizes)[often]
        self.shared = new[number[often]]
        self.starts = np.searchsorted(owner, np.arange(n + 1))
        self.mark = np.zeros(int(new[-1]) + 1 if len(new) else 0, bool)
        self.links, self.forest, self.found = np.zeros(n, np.int64), Forest(n), np.zeros((BANDS, BINS), np.int64)

    def check(self, a: int, who: np.ndarray) -> None:
        """Compare set ``a`` with the sets ``who``, each pair once in all."""
        sizes, starts, t = self.sizes, self.starts, self.threshold
        # an exact comparison in whole numbers would need the threshold as a ratio; 1e-9 is far below 1 / union
        who = who[np.minimum(sizes[who], sizes[a]) >= t * np.maximum(sizes[who], sizes[a]) - 1e-9]
        if not len(who):
            return
        mine = self.shared[starts[a] : starts[a + 1]]
        self.mark[mine] = True
        spans = starts[who + 1] - starts[who]
        common = np.zeros(len(who), np.int64)
        full = np.flatnonzero(spans)
        if len(full):
            offsets = np.cumsum(spans[full]) - spans[full]
            at = np.repeat(starts[who[full]] - offsets, spans[full]) + np.arange(int(spans[full].sum()))
            common[full] = np.add.reduceat(self.mark[self.shared[at]], offsets, dtype=np.int64)
        self.mark[mine] = False
        union = sizes[a] + sizes[who] - common
        near = np.flatnonzero(common >= t * union - 1e-9)
        if len(near):
            alike, least = common[near] / union[near], np.minimum(sizes[a], sizes[who[near]])
            near = who[near]
            self.links[a] += self.copies[near].sum()
            self.links[near] += self.copies[a]
            bins = np.clip(((alike - t) / max(1e-9, 1 - t) * BINS).astype(np.int64), 0, BINS - 1)
            np.add.at(self.found, (np.minimum(BANDS - 1, np.log2(least).astype(np.int64)), bins), 1)
            for b in near.tolist():
                self.forest.link(a, b)

    def rows(self, keys: list[bytes]) -> list[tuple]:
        """(set_key, links, near, bin, pairs): numbers of links, the first of all that links connect, links by band and bin."""
        out = [(keys[k], int(self.links[k]), None, None, None) for k in np.flatnonzero(self.links)]
        out += [(keys[root], None, keys[k], None, None) for k in range(len(keys)) if (root := self.forest.find(k)) != k]
        return out + [(None, None, None, int(k), int(self.found.ravel()[k])) for k in np.flatnonzero(self.found)]


_VERIFIED = "set_key binary, links long, near binary, bin int, pairs long"


def _verified_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["set_key", "links", "near", "bin", "pairs"])


def node_hashes(labels: np.ndarray, level: int) -> np.ndarray:
    """(classes, trees): a hash of each label's first ``level`` values; a clash only adds a candidate."""
    out = np.zeros(labels.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(level):
            out = (out ^ labels[:, :, k]) * _P[k % 5]
            out ^= out >> np.uint64(31)
    return out


def trie_links(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b, depth): b shares ``depth`` >= ``least`` values with the label before it in a tree, and a is the first of the run that does.

    Links of a depth or more connect what stands below one node of that depth.  Range partitions cut a hot node anywhere; the first and last label of each
    partition, two rows a task, meet on the driver.
    """
    labels = classes.select("set_key", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("labels", t * (2 * depth) + 1, 2 * depth))).alias("tree", "label"))

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.cumprod(x == y, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)

    def neighbours(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names, last, heads, part = ["a", "b", "depth", "part", "tree", "label"], None, [b""] * (depth + 1), TaskContext.get().partitionId()
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

        def ends(row):
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((row[0], None, None, part, row[1], row[2]), kinds)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, tree = batch.column("set_key").to_pylist(), batch.column("tree").to_numpy()
            raw = batch.column("label").to_pylist()
            if last is None:
                yield ends((keys[0], int(tree[0]), raw[0]))
                heads = [keys[0]] * (depth + 1)
            else:
                keys, tree, raw = [last[0], *keys], np.append(np.int32(last[1]), tree), [last[2], *raw]
            last = (keys[-1], int(tree[-1]), raw[-1])
            label = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), depth)
            both = np.where(tree[1:] == tree[:-1], shared(label[1:], label[:-1]), 0)
            found, place = [], np.arange(1, len(keys))
            for d in range(least, depth + 1):  # the first label of the run of depth d in which each stands; 0: the run goes on from before
                first = np.maximum.accumulate(np.where(both < d, place, 0)) if len(place) else place
                found += [(i, keys[first[i - 1]] if first[i - 1] else heads[d]) for i in place[both == d].tolist()]
                if len(place) and first[-1]:
                    heads[d] = keys[first[-1]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for _, a in found], kinds[0]), pa.array([keys[i] for i, _ in found], kinds[1]), pa.array(both[[i - 1 for i, _ in found]].astype(np.int32)), *(pa.nulls(len(found), k) for k in kinds[3:])], names)
        if last is not None:
            yield ends(last)

    ordered = labels.repartitionByRange("tree", "label", "set_key").sortWithinPartitions("tree", "label", "set_key")
    table = stored(ordered.mapInArrow(neighbours, "a binary, b binary, depth int, part int, tree int, label binary"), "trie")
    rows = [(r["part"], r["tree"], bytes(r["label"]), bytes(r["a"])) for r in table.where("part is not null").select("part", "tree", "label", "a").collect()]  # two a task
    rows.sort()
    across = []
    for (p, t, x, a), (q, u, y, b) in zip(rows, rows[1:]):
        if p != q and t == u:
            d = int(shared(np.frombuffer(x, np.uint16)[None], np.frombuffer(y, np.uint16)[None])[0])
            if d >= least:
                across.append((a, b, d))
    out = table.where("part is null").select("a", "b", "depth").unionByName(table.sparkSession.createDataFrame(across, "a binary, b binary, depth int"))
    out._wearline_path = table._wearline_path
    return out


def _small_groups(placed: DataFrame, threshold: float) -> DataFrame:
    """Links within groups that fit a task, of pairs that come from different groups of the level before."""
    total = placed.agg(F.sum("n")).first()[0] or 0

    def check(pdf):
        import pandas as pd

        words = Words()
        pdf = pdf.sort_values(["root", "set_key"], kind="stable")
        made = Verifier([shingles(t, words) for t in pdf["text"]], pdf["copies"].to_numpy(np.int64), threshold)
        root, old = pd.factorize(pdf["root"])[0], pd.factorize(pdf["old"])[0]
        ends = np.append(np.flatnonzero(root[1:] != root[:-1]) + 1, len(root))
        for a, end in enumerate(ends[np.searchsorted(ends, np.arange(len(root)), "right")].tolist()):
            who = np.arange(a + 1, end)
            made.check(a, who[old[who] != old[a]])
        return pd.DataFrame(made.rows(pdf["set_key"].tolist()), columns=["set_key", "links", "near", "bin", "pairs"]).astype({"links": "Int64", "bin": "Int32", "pairs": "Int64"})

    bundle = F.pmod(F.xxhash64("root"), F.lit(max(1, -(-total // BLOCK_SHINGLES))))
    return placed.select("root", "old", "set_key", "copies", "text", bundle.alias("bundle")).groupBy("bundle").applyInPandas(check, _VERIFIED)


def _write_blocks(placed: DataFrame, folder: str, trees: int, depth: int, level: int) -> DataFrame:
    """Write large groups in trie order as blocks; returns (root, name, tree, node) for every node of a block."""
    most_classes, most_shingles = BLOCK_CLASSES, BLOCK_SHINGLES

    def write(batches):
        import pyarrow as pa

        words, held, count = Words(), [], 0

        def block():
            keys, olds, whole, copies, labels, sets = zip(*(r[1:] for r in held))
            name = f"{level}-{held[0][0].hex()}-{keys[0].hex()}"
            labels = np.frombuffer(b"".join(labels), np.uint16).reshape(len(held), trees, depth)
            out = io.BytesIO()
            np.savez(out, keys=np.array(keys, "V16"), olds=np.array(olds, "V16"), whole=np.array(whole, bool), copies=np.array(copies, np.int64), labels=labels, sizes=np.array([len(s) for s in sets], np.int64), flat=np.concatenate(sets))
            write_atomically(f"{folder}/{name}", lambda f: f.write(out.getvalue()))
            nodes = node_hashes(labels, level)
            for t in range(trees):
                own = np.unique(nodes[:, t]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([held[0][0]] * len(own), pa.binary()), pa.array([name] * len(own)), pa.array(np.full(len(own), t, np.int32)), pa.array(own)], ["root", "name", "tree", "node"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("root", "set_key", "old", "whole", "copies", "labels", "text"))):
                if held and (held[-1][0] != row[0] or len(held) >= most_classes or count >= most_shingles):
                    yield from block()
                    held, count = [], 0
                held.append((*row[:-1], shingles(row[-1], words)))
                count += len(held[-1][-1])
        if held:
            yield from block()

    # some blocks a task, since a block ends with its task
    count, total = placed.agg(F.count("*"), F.sum("n")).first()
    tasks = max(1, count // (4 * most_classes), total // (4 * most_shingles))
    ordered = placed.select("root", "set_key", "old", "whole", "copies", "labels", "text").repartitionByRange("root", "labels", "set_key").coalesce(tasks).sortWithinPartitions("root", "labels", "set_key")
    return stored(ordered.mapInArrow(write, "root binary, name string, tree int, node long"), "blocks")


@functools.lru_cache(maxsize=2)
def _block(uri: str) -> dict[str, np.ndarray]:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _large_groups(placed: DataFrame, folder: str, trees: int, depth: int, level: int, last: int, threshold: float) -> DataFrame:
    """Links within large groups, of pairs that share a node at this level and did not at the ``last``."""
    nodes = _write_blocks(placed, folder, trees, depth, level)
    other = nodes.select("root", "tree", "node", F.col("name").alias("other"))
    pairs = nodes.join(other, ["root", "tree", "node"]).where("name <= other").select("name", "other").distinct()
    pairs = stored(pairs, "block-pairs")

    def compare(batches):
        for batch in batches:
            for x, y in zip(batch.column("name").to_pylist(), batch.column("other").to_pylist()):
                parts = [_block(f"{folder}/{n}") for n in dict.fromkeys((x, y))]
                keys, olds, whole, copies, labels = (np.concatenate([p[k] for p in parts]) for k in ("keys", "olds", "whole", "copies", "labels"))
                sets = [s for p in parts for s in np.split(p["flat"], np.cumsum(p["sizes"])[:-1])]
                made, left = Verifier(sets, copies, threshold), len(parts[0]["keys"])
                now = np.ascontiguousarray(node_hashes(labels, level).T)
                before = np.ascontiguousarray(node_hashes(labels, last).T)
                old = np.unique(olds.view(np.uint64).reshape(-1, 2), axis=0, return_inverse=True)[1].ravel()
                for a in range(left):
                    low = a + 1 if x == y else left
                    meets = (now[:, low:] == now[:, a : a + 1]).any(axis=0)
                    same = old[low:] == old[a]
                    if same.any():  # met before: in a group that was verified whole, or below a deeper node
                        meets &= ~(same & (whole[a] | (before[:, low:] == before[:, a : a + 1]).any(axis=0)))
                    made.check(a, np.flatnonzero(meets) + low)
                yield _verified_batch(made.rows([k.tobytes() for k in keys]))

    tasks = max(1, min(100_000, -(-pairs.count() // 4)))
    out = stored(pairs.repartition(tasks, "name", "other").mapInArrow(compare, _VERIFIED), "verified")
    dropped(nodes, pairs)
    return out


def join_near_copies(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash (xxhash64), root, class_id, n_links for every row of ``docs`` (doc_id, text).

    root: what the rows of one near-duplicate class share; null without words.

    class_id: the least doc_id of the documents that links connect to this one.
    n_links: the other documents with similarity of the threshold or more; rows
    with an equal shingle set link to each other.

    Null and empty texts have no shingles: no links, a class of their own.  A text
    of one to four words is a single shingle.  Rows with a null doc_id link like
    others; a class of such rows only has a null class_id.  Rows that repeat an id
    are documents of their own that share its class id.  An empty table gives no rows.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "jaccard")
    rows = stored(signed(docs, trees, depth), "signed")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    classes = stored(rows.where("set_key is not null").groupBy("set_key").agg(rep, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels")), "classes")

    # beyond this depth no similarity above the threshold is found with less than the recall
    floor = next((d for d in range(depth, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)
    rest = trie_links(classes, trees, depth, floor)

    # the whole texts of the classes that meet any other, read once
    meeting = rest.select(F.col("a").alias("set_key")).unionByName(rest.select(F.col("b").alias("set_key"))).distinct()
    wanted = meeting.join(classes, "set_key").select("set_key", "copies", "n", "labels", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    found_texts = texts.alias("t").join(wanted.alias("w"), (F.col("t.hash") == F.col("w.hash")) & F.col("t.id").eqNullSafe(F.col("w.id")))
    # rows that repeat id and text bring it more than once
    texts = stored(found_texts.groupBy("w.set_key").agg(*(F.first(f"w.{c}").alias(c) for c in ("copies", "n", "labels")), F.first("t.text").alias("text")), "texts")

    members, verified, large = None, [], False
    found, active = np.zeros((BANDS, BINS), np.int64), np.arange(BANDS)
    level, last = depth, depth + 1
    while True:
        meets = rest.where(F.col("depth") >= level)
        merged = connected_components(meets)
        if members is None:
            grown = merged.select(F.col("node").alias("set_key"), "root", F.col("node").alias("old"), F.lit(True).alias("whole"))
        else:
            kept = members.join(merged.select(F.col("node").alias("old"), F.col("root").alias("new")), members["root"] == F.col("old"), "left")
            kept = kept.select("set_key", F.coalesce("new", "root").alias("root"), F.col("root").alias("old"), "whole")
            fresh = merged.join(members.select(F.col("set_key").alias("node")), "node", "left_anti").select(F.col("node").alias("set_key"), "root", F.col("node").alias("old"), F.lit(True).alias("whole"))
            grown = kept.unionByName(fresh)
        # whole: whether all pairs of the old group have been compared
        grown = stored(grown, "groups")
        band = F.least(F.lit(BANDS - 1), F.floor(F.log2("n")).cast("int"))
        sized = grown.join(texts.select("set_key", "n"), "set_key").groupBy("root").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"),
            (F.min("old") < F.max("old")).alias("grew"), F.max(band.isin([int(x) for x in active]) | (band - 1).isin([int(x) for x in active])).alias("open"),
        )
        sized = stored(sized, "sizes")
        placed = grown.join(sized.where("open and (grew or blocks > 1)"), "root").join(texts, "set_key")
        some = {bool(r["large"]) for r in sized.where("open and (grew or blocks > 1)").select((F.col("blocks") > 1).alias("large")).distinct().collect()}  # two rows
        new = [stored(_small_groups(placed.where("blocks = 1"), threshold), "verified")] if False in some else []
        if True in some:
            new.append(_large_groups(placed.where("blocks > 1"), folder, trees, depth, level, min(last, depth), threshold))
        verified += new
        for part in new:
            for r in part.where("bin is not null").groupBy("bin").agg(F.sum("pairs").alias("pairs")).collect():  # at most BANDS * BINS rows
                found[divmod(r["bin"], BINS)] += r["pairs"]
        after = stored(grown.join(sized, "root").select("set_key", "root", (F.col("blocks") == 1).alias("whole")), "members")
        dropped(merged, grown, sized, *([members] if members is not None else []))
        members, large = after, large or True in some
        active = unfinished(found, level, threshold, recall, trees)
        if not len(active) or level == floor:
            break
        # what is left of the tries: links between the groups of this level
        left = rest.where(F.col("depth") < level)
        for end in ("a", "b"):
            left = left.join(members.select(F.col("set_key").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
        left = stored(left.where("ra <> rb").groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.max("depth").alias("depth")), "trie")
        dropped(rest)
        rest = left
        if not large and rest.isEmpty():
            break
        # as far as the links found so far ask for; what is found there may ask for more
        last, level = level, next((d for d in range(level - 1, floor, -1) if not len(unfinished(found, d, threshold, recall, trees))), floor)

    empty = spark.createDataFrame([], _VERIFIED)
    verdicts = functools.reduce(DataFrame.unionByName, verified, empty)
    linked = verdicts.where("links is not null").groupBy("set_key").agg(F.sum("links").alias("links"))
    joined = connected_components(verdicts.where("near is not null").select(F.col("set_key").alias("a"), F.col("near").alias("b")))
    # the class takes the least id among its members
    named = joined.withColumnRenamed("node", "set_key").join(classes.select("set_key", F.col("rep.doc_id").alias("id")), "set_key")
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    named = named.join(least, "root").select("set_key", "root", "least")
    answer = classes.join(linked, "set_key", "left").join(named, "set_key", "left").select("set_key", F.coalesce("root", "set_key").alias("root"), F.coalesce("least", "rep.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "text_hash", "set_key").join(answer, "set_key", "left")
    out = stored(out.select("doc_id", "text_hash", "root", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "near-copies")
    dropped(rows, classes, rest, texts, joined, *verified, *([members] if members is not None else []))
    delete(spark, folder)
    return out


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the least (doc_id, text_hash), null ids last.

    Rows without words are classes of their own; rows that repeat id and text are one.
    """
    rows = join_near_copies(docs, **options)
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    stays = stored(first.select("k.doc_id", "k.text_hash").unionByName(rows.where("root is null").select("doc_id", "text_hash").distinct()), "stays")
    dropped(rows)
    names, inner = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    doc_id, text = (inner[names.index(c)] for c in ("doc_id", "text"))
    marked = docs.toDF(*inner).withColumn("__text", F.xxhash64(text))
    kept = marked.join(stays.toDF("__id", "__hash"), F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates([doc_id, "__text"]).select(*inner).toDF(*names)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_near_copies(docs).select("doc_id", "class_id", "n_links")
