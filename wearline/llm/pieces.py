"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for every piece of the vocabulary that occurs
in it, weighted by the piece's score, and for every character that is no piece an
edge to its bytes, ten below the lowest score (of pieces that are not all blank).  Forward Viterbi gives each
position the best score of any way to reach it.  Those scores are exact
heuristics for a backward A-star search, which pops the segmentations of a text
in order of their scores.

No piece crosses a line end or the start of a word, so a text's lattice is a
chain of small lattices and its N best segmentations combine theirs.  Forward and
backward Viterbi run over thousands of distinct words at a time; they also give
what a word's second best segmentation costs, so only the N - 1 words of a text
with the cheapest alternatives, all that its N best can use, go to A-star.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Stands for a literal U+2581 of the text, which is encoded by its bytes.
LITERAL = "\U0010fffe"
#: Below the lowest score of any piece but runs of blanks, for a character that is no piece.
PENALTY = 10.0
#: Every segment opens with blanks or line ends.
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+[^{SPACE}\n]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of one length that run together; words of more than LONG characters run alone.
BATCH, LONG = 4096, 64
#: Characters of text whose new words are learnt together.
GROUP_CHARS = 2_000_000


def _real(word: str) -> str:
    return word if word[:1] == "\n" else SPACE + word


class PieceModel:
    """Pieces and scores of a SentencePiece model, and a bounded table of segmented words."""

    def __init__(self, path: str, room: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes, self.byte_ids = {}, [], [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.bytes.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a word's start or a line's end")
        self.unknown = min(self.scores[i] for p, i in self.ids.items() if p.strip(SPACE)) - PENALTY
        self.longest = max(map(len, self.ids))
        tables: list[list] = [[] for _ in range(self.longest + 1)]
        for piece, i in self.ids.items():
            tables[len(piece)].append((int(self._hashes(np.array([[ord(c) for c in piece]], np.uint32), len(piece))[-1][0, 0]), i))
        self.tables = [(np.array([h for h, _ in sorted(t)], np.uint64), np.array([i for _, i in sorted(t)], np.int32)) for t in tables]
        if any(len(np.unique(h)) != len(h) for h, _ in self.tables):
            raise ValueError("two pieces have one hash")
        self.sieves = []  # by the upper 16 bits of a hash: whether any piece of that length has them
        for h, _ in self.tables:
            self.sieves.append(np.zeros(1 << 16, bool))
            self.sieves[-1][h >> np.uint64(48)] = True
        self.score_of = np.array(self.scores)
        self.room = room
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.codes: list[bytes] = []
        self.best, self.loss, self.used = np.zeros(self.room + 1), np.zeros(self.room + 1), np.zeros(self.room + 1, np.int32)
        self.found: dict[str, list] = {}

    def _forget(self) -> None:
        """Keep what several texts have used, at most half of the table: most words occur once, and would push out the rest."""
        n = len(self.codes)
        often = np.flatnonzero(self.used[:n] > 1)
        if len(often) > self.room // 2:
            often = np.sort(often[np.argpartition(-self.used[often], self.room // 2)[: self.room // 2]])
        words, codes, found, k = list(self.place), self.codes, self.found, len(often)
        best, loss, used = self.best[often], self.loss[often], self.used[often] // 2
        self._empty()
        self.place = {words[i]: at for at, i in enumerate(often.tolist())}
        self.codes, self.found = [codes[i] for i in often.tolist()], found
        self.best[:k], self.loss[:k], self.used[:k] = best, loss, used

    @staticmethod
    def _hashes(chars: np.ndarray, longest: int) -> list[np.ndarray]:
        """For lengths 1, 2, ...: hashes of the substrings of each row by their start."""
        c, out = chars.astype(np.uint64) + np.uint64(1), []
        h = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(longest, chars.shape[1])):
                h = (h[:, : chars.shape[1] - k] + c[:, k:]) * _MIX
                h ^= h >> np.uint64(29)
                out.append(h)
        return out

    def _expand(self, word: str) -> list[int]:
        return [self.byte_ids[b] for c in word for b in (SPACE if c == LITERAL else c).encode()]

    def _segment(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Best ids, best score and the loss of the second best, for words of one length."""
        n, size = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size)
        ids, edges = [], []  # by length: ids by (word, start); by start the words that have a piece there, and its scores
        everyone = np.arange(n)
        for length, h in enumerate(self._hashes(chars, self.longest), 1):
            table, numbers = self.tables[length]
            i, width = np.full(h.size, -1, np.int32), h.shape[1]
            h = h.ravel()
            maybe = np.flatnonzero(self.sieves[length][h >> np.uint64(48)])
            if len(maybe):
                at = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
                hit = table[at] == h[maybe]
                maybe, at = maybe[hit], at[hit]
                i[maybe] = numbers[at]
            ids.append(i.reshape(n, width))
            if length == 1:
                s = np.full(n * width, self.unknown)
                if len(maybe):
                    s[maybe] = self.score_of[i[maybe]]
                edges.append([(everyone, x) for x in s.reshape(n, width).T])
                continue
            row, start = np.divmod(maybe, width)
            order = np.argsort(start, kind="stable")
            row, cuts = row[order], np.searchsorted(start[order], np.arange(width + 1))
            score = self.score_of[i[maybe[order]]]
            edges.append([(row[x:y], score[x:y]) for x, y in itertools.pairwise(cuts.tolist())])
        forward, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int32)
        forward[0] = 0
        for j in range(1, size + 1):
            for length in range(min(j, len(edges)), 0, -1):  # of equal scores the longest last piece
                rows, s = edges[length - 1][j - length]
                if len(rows):
                    new = forward[j - length][rows] + s
                    better = new > forward[j][rows]
                    rows = rows[better]
                    forward[j][rows] = new[better]
                    back[j][rows] = length
        behind = np.full((size + 1, n), -np.inf)
        behind[size] = 0
        for i in range(size - 1, -1, -1):
            for length in range(1, min(size - i, len(edges)) + 1):
                rows, s = edges[length - 1][i]
                if len(rows):
                    behind[i][rows] = np.maximum(behind[i][rows], s + behind[i + length][rows])
        # the best path, from its end
        rows, end = np.arange(n), np.full(n, size)
        taken, path = np.zeros((size, n), np.int32), np.zeros((size, n), np.int32)
        count = np.zeros(n, np.int64)
        while len(rows):
            length = back[end[rows], rows]
            start = end[rows] - length
            taken[start, rows] = length
            for k in np.unique(length):
                of = length == k
                path[size - 1 - count[rows[of]], rows[of]] = ids[k - 1][rows[of], start[of]]
            count[rows] += 1
            end[rows] = start
            rows = rows[start > 0]
        # any other segmentation has an edge off the best path, so the best through such an edge is second
        second = np.full(n, -np.inf)
        for length, starts in enumerate(edges, 1):
            for i, (rows, s) in enumerate(starts):
                if len(rows):
                    through = forward[i][rows] + s + behind[i + length][rows]
                    through[taken[i][rows] == length] = -np.inf
                    second[rows] = np.maximum(second[rows], through)
        path, codes = np.ascontiguousarray(path.T), []
        plain = (path >= 0).all(axis=1)
        wide = path.astype("<u4")
        for k in range(n):
            if plain[k]:
                codes.append(wide[k, size - count[k] :].tobytes())
            else:
                at, out = 0, []
                for i in path[k, size - count[k] :].tolist():
                    length = int(taken[at, k])
                    out += [i] if i >= 0 else self._expand(words[k][at : at + length])
                    at += length
                codes.append(np.array(out, "<u4").tobytes())
        return codes, forward[size], forward[size] - second

    def _segment_alone(self, word: str) -> tuple[bytes, float, float]:
        """What :meth:`_segment` gives, for one long word: time and memory in proportion to its length."""
        size, get, longest, scores, none = len(word), self.ids.get, self.longest, self.scores, -np.inf
        forward, back = [0.0] + [none] * size, [0] * (size + 1)
        for j in range(1, size + 1):
            for length in range(min(j, longest), 0, -1):  # of equal scores the longest last piece
                i = get(word[j - length : j])
                if i is not None or length == 1:
                    new = forward[j - length] + (scores[i] if i is not None else self.unknown)
                    if new > forward[j]:
                        forward[j], back[j] = new, length
        taken, path, j = [0] * (size + 1), [], size
        while j:
            start = j - back[j]
            taken[start], i = back[j], get(word[start:j])
            path.append([i] if i is not None else self._expand(word[start:j]))
            j = start
        behind, second = [none] * size + [0.0], none
        for i in range(size - 1, -1, -1):
            for length in range(1, min(size - i, longest) + 1):
                k = get(word[i : i + length])
                if k is not None or length == 1:
                    s = scores[k] if k is not None else self.unknown
                    behind[i] = max(behind[i], s + behind[i + length])
                    if taken[i] != length:
                        second = max(second, forward[i] + s + behind[i + length])
        return np.array([i for part in reversed(path) for i in part], "<u4").tobytes(), forward[size], forward[size] - second

    def _learn(self, words: set[str]) -> None:
        """Segment words that are new to the table and fit it."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w) + (w[:1] != "\n"), []).append(w)
        for size, same in by_size.items():
            for a in range(0, len(same), BATCH):
                part, at = same[a : a + BATCH], len(self.codes)
                if size <= LONG:
                    codes, best, loss = self._segment([_real(w) for w in part])
                else:
                    codes, best, loss = zip(*(self._segment_alone(_real(w)) for w in part))
                self.best[at : at + len(part)], self.loss[at : at + len(part)] = best, loss
                self.place.update(zip(part, range(at, at + len(part))))
                self.codes += codes

    def n_best_word(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """Backward A-star: the n best (score, ids) of a word, best first."""
        size, into = len(word), [[] for _ in range(len(word) + 1)]
        reach = [0.0] + [-np.inf] * size
        for j in range(1, size + 1):
            for length in range(1, min(j, self.longest) + 1):
                i = self.ids.get(word[j - length : j])
                score = self.scores[i] if i is not None else self.unknown if length == 1 else None
                if score is not None:
                    into[j].append((j - length, score, i))
                    reach[j] = max(reach[j], reach[j - length] + score)
        # what is behind is known exactly and so is the best of what is ahead: the first n to arrive are the n best
        queue, order, out = [(-reach[size], 0, size, 0.0, None)], itertools.count(-1, -1), []
        while queue and len(out) < n:
            total, _, j, done, path = heapq.heappop(queue)
            if j == 0:
                ids = []
                while path:
                    start, end, i, path = path
                    ids += [i] if i is not None else self._expand(word[start:end])
                out.append((-total, ids))
                continue
            for i, score, piece in into[j]:
                heapq.heappush(queue, (-(done + score + reach[i]), next(order), i, done + score, (i, j, piece, path)))
        return out

    def words(self, text: str) -> list[str]:
        """A text's segments: as they are if they open with a line end, else without their first blank."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
            return [w[1:] if w[0] == SPACE else w for w in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def encode(self, text: str, n: int = 1) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a text, best first; fewer if there are fewer."""
        return next(iter(self.encode_all([text], n)))

    def _alternatives(self, words: list[str], loss: np.ndarray, n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """The 2nd to nth best segmentations: what each loses to the best, and the words it cuts otherwise."""
        if n < 2 or not words:
            return []
        near = np.argsort(loss, kind="stable")[: n - 1] if len(loss) <= 4 * n else np.argpartition(loss, n - 1)[: n - 1]
        top: list[tuple[float, dict]] = [(0.0, {})]
        for k in near.tolist():
            if loss[k] == np.inf:
                continue
            found = self.found.get(words[k])
            if found is None or len(found) < n:
                if len(self.found) >= self.room // 8:
                    self.found.clear()
                found = self.found[words[k]] = self.n_best_word(_real(words[k]), n)
                if len({b"".join(map(self.bytes.__getitem__, ids)) for _, ids in found}) > 1:
                    raise ValueError(f"segmentations of {words[k]!r} decode to different bytes")
            more = [(lost + score - found[0][0], {**cut, k: ids}) for lost, cut in top for score, ids in found[1:n]]
            top = sorted(top + more, key=lambda x: -x[0])[:n]
        return top[1:]

    def _looked_up(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Codes, scores and losses of a text's words, learnt in runs that the table holds."""
        codes, scores, loss = [], [np.zeros(0)], [np.zeros(0)]
        for a in range(0, len(words), self.room):
            run = words[a : a + self.room]
            places = list(map(self.place.get, run))
            if None in places:
                for room in (self._forget, self._empty, None):
                    new = {w for w, x in zip(run, map(self.place.get, run)) if x is None}
                    if len(self.place) + len(new) <= self.room:
                        break
                    room()
                self._learn(new)
                places = list(map(self.place.__getitem__, run))
            at = np.array(places, np.int64)
            self.used[at] += 1
            codes += map(self.codes.__getitem__, places)
            scores.append(self.best[at])
            loss.append(self.loss[at])
        return codes, np.concatenate(scores), np.concatenate(loss)

    def encode_all(self, texts: list[str], n: int = 1, ids_of_all: bool = True):
        """encode() of each text, with new words of many texts learnt together; without ids_of_all only the best has ids."""
        ends = np.cumsum([len(t) for t in texts]) // GROUP_CHARS
        for _, group in itertools.groupby(range(len(texts)), ends.__getitem__):
            split = [self.words(texts[k]) for k in group]
            new = set().union(*split).difference(self.place)
            if len(self.place) + len(new) > self.room:
                self._forget()
                new = set().union(*split).difference(self.place)
            if len(self.place) + len(new) <= self.room:  # else each text's words are learnt by themselves
                self._learn(new)
            for words in split:
                codes, scores, loss = self._looked_up(words)
                best = float(scores.sum())
                out = [(best, np.frombuffer(b"".join(codes), "<u4"))]
                for lost, cut in self._alternatives(words, loss, n):
                    if ids_of_all:
                        other = list(codes)
                        for k, ids in cut.items():
                            other[k] = np.array(ids, "<u4").tobytes()
                    out.append((best + lost, np.frombuffer(b"".join(other), "<u4") if ids_of_all else None))
                yield out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; damaged byte runs become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str, n_best: int = 4, with_ids: bool = True, carried: Sequence[str] = (), every: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, score, scores (the n best), round_trip and, if asked for, ids (best) and source.

    ``every``: ids are made of all n segmentations, not of the best alone: ``crc32s``
    has a sum for each of them, and with_ids adds ``segmentations``.
    ``carried``: further columns of ``docs`` that stand, as they are, at the end of each row.

    The model's scores are what its file says.  In a model made by merges they are
    merge ranks (the first merge 0, the next -1, ...), not log probabilities, and the
    best sum of them is often a segmentation of more and shorter pieces than the
    library's own merging gives; both decode to the text.

    round_trip: decoding the ids gives the whole text.  The other segmentations cut some
    words otherwise; that these decode to the same bytes is compared when they are found.  A word of any length is
    segmented whole, in time and memory that grow with its length.  Null text counts as empty,
    with no ids, score 0 and one segmentation; rows that repeat an id are encoded
    each; an empty table gives no rows; other columns are not read.
    """
    kinds = {"doc_id": "long"} | ({"source": "string"} if with_ids else {}) | {"n_ids": "long", "ids_crc32": "long", "score": "double", "scores": "array<double>", "round_trip": "boolean"}
    kinds |= ({"ids": "array<int>"} if with_ids else {}) | ({"crc32s": "array<long>"} if every else {}) | ({"segmentations": "array<array<int>>"} if every and with_ids else {})

    def run(batches):
        import pyarrow as pa

        encoder = model(path)
        arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}

        def lists(arrays):
            offsets = pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32), pa.int32()))

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = list(encoder.encode_all(texts, n_best, ids_of_all=every))
                best = [f[0][1] for f in found]
                made = {
                    "n_ids": [len(ids) for ids in best], "ids_crc32": [zlib.crc32(ids.tobytes()) for ids in best], "score": [f[0][0] for f in found], "scores": [[s for s, _ in f] for f in found],
                    "round_trip": [encoder.decode_bytes(ids) == text.encode() for ids, text in zip(best, texts)],
                }
                if every:
                    made["crc32s"] = [[zlib.crc32(ids.tobytes()) for _, ids in f] for f in found]
                columns = {k: part.column(k) if k in ("doc_id", "source") else pa.array(made[k], arrow[kind]) if k in made else None for k, kind in kinds.items()}
                if with_ids:
                    columns["ids"] = lists(best)
                if with_ids and every:
                    offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.int32())
                    columns["segmentations"] = pa.ListArray.from_arrays(offsets, lists([ids for f in found for _, ids in f]))
                yield pa.RecordBatch.from_arrays([*columns.values(), *(part.column(c) for c in carried)], [*columns, *carried])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([F.col("source").cast("string").alias("source")] if with_ids else []), "text", *carried)
    return rows.mapInArrow(run, ", ".join([f"{c} {kind}" for c, kind in kinds.items()] + [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried]))


def op6_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, path or default_model(), with_ids=False, every=True)
    n_best_crc32 = F.crc32(F.array_join("crc32s", ",").cast("binary"))
    return out.select("doc_id", "n_ids", "ids_crc32", "score", F.try_element_at("scores", F.lit(2)).alias("second_score"), F.element_at("scores", -1).alias("last_score"), F.size("scores").cast("int").alias("n_segmentations"), n_best_crc32.alias("n_best_crc32"), "round_trip")
