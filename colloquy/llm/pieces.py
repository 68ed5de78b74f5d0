"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary file gives pieces and scores; nothing is trained.  Scores are
taken as log probabilities; a vocabulary whose scores are whole numbers (merge
ranks) gets log probabilities from Zipf's law over the order of its scores.  Blanks are
the white-space marker: a text is encoded with one blank in front, and decoding
turns markers into blanks and drops the first.  Characters without a piece
become byte pieces, as does a literal marker character in a text, so decoding
gives back every text exactly.

The best segmentation never crosses a place that no piece crosses: before a run
of blanks and around bytes that no piece holds.  Texts are cut there, each
distinct segment is solved once per task as long as the memory of solved
segments (`CACHE_BYTES`) lasts, and the trie is walked for all places of
`BATCH` bytes of new segments together.  A segment of more bytes than that is
solved block by block: what is kept of the blocks behind is one piece for each
place, so a task's memory grows with `BATCH`, the cache and the ids of the
longest text, and not with the pieces that were tried.

Defined results: a null text gives null ids, an empty one none; null ids decode
to null; ids outside the vocabulary, control and unknown pieces decode to
nothing.  Pieces with a blank after another character are not used.  Of equal
scores the segmentation whose last pieces are longest wins.  Rows with one id
(or a null id) are encoded each for itself, so repeated rows give equal rows; a
text of any length is encoded whole; an empty table gives an empty one.
Other columns do not reach the result of `encode`; `decode` hands all columns on
but replaces one called `text`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_column, table, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE_PENALTY = 10.0
#: Bytes of text (of 4-byte ids, when decoding) that are worked on at once.
SLICE = 1 << 20
#: Segments of one long text that are looked up at once.
RUN = 1 << 17
#: Bytes of new segments that are solved together.
BATCH = 1 << 16
#: Bytes of solved segments that a task remembers, each counted with ENTRY_BYTES for its place in memory.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 160
STEP = 48


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is base[s] + c + 1 if check of that is s."""

    def __init__(self, keys: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for k, key in enumerate(keys):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = k
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        free, several, queue = 257, 257, [(0, 0)]
        for node, state in queue:
            codes = sorted(children[node])
            if not codes:
                continue
            while taken[free]:
                free += 1
            # Nodes of several children look on from where the last such node was put; the holes go to the others.
            at = max((free if len(codes) == 1 else several) - codes[0] - 1, 0)
            while any(taken[at + c + 1] for c in codes):
                at += 1
                if at + 300 > len(taken):
                    grow = len(taken)
                    taken.extend(bytes(grow))
                    self.base, self.check, self.value = (np.concatenate([x, np.full(grow, fill, np.int32)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            if len(codes) > 1:
                several = at + codes[0] + 1
            self.base[state] = at
            for c in codes:
                child = at + c + 1
                taken[child] = 1
                self.check[child] = state
                self.value[child] = value[children[node][c]]
                queue.append((children[node][c], child))


class Vocabulary:
    """Pieces, log scores and the trie; small and of fixed size, so it travels with the task."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        """kinds: 'normal', 'byte' or 'other' (control and unknown pieces) of each piece."""
        raw = [p.replace(MARK, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.byte_ids = np.full(256, -1, np.int32)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte_ids[raw[i][0]] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        used = [i for i, k in enumerate(kinds) if k == "normal" and not re.search(rb"[^ ] ", raw[i])]
        own = np.array([scores[i] for i in used])
        if len(own) and np.array_equal(own, np.round(own)):
            ranks = np.argsort(np.argsort(-own, kind="stable"), kind="stable")
            own = -np.log((ranks + 1) * np.sum(1 / np.arange(1, len(own) + 1)))
        self.ids, self.scores = np.array(used, np.int32), own
        self.byte_score = (own.min() if len(own) else 0.0) - BYTE_PENALTY
        self.trie = DoubleArray([raw[i] for i in used])
        self.longest = max((len(raw[i]) for i in used), default=1)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.array([k == "byte" for k in kinds])
        held = {c for i in used for c in raw[i]}
        apart = bytes(c for c in range(128) if c not in held and c != 32)
        cut = b"[" + re.escape(apart) + b"]+" if apart else None
        stop = b"[^ " + re.escape(apart) + b"]+"
        self.segment = re.compile(b" *" + stop + b"|" + (cut + b"|" if cut else b"") + b" +")

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in ids]
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)

    def edges(self, data: np.ndarray, ends: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that start at one of the first `places`: start, end, id, score; ends holds the end of the segment of each place."""
        place = np.arange(places, dtype=np.int32)
        found = [(place, place + 1, self.byte_ids[data[:places]], np.full(places, self.byte_score))]
        state, depth = np.zeros(places, np.int32), 0
        while len(place):
            nxt = self.trie.base[state] + data[place + depth] + 1
            ok = self.trie.check[nxt] == state
            place, state = place[ok], nxt[ok]
            depth += 1
            value = self.trie.value[state]
            hit = value >= 0
            if hit.any():
                found.append((place[hit], place[hit] + np.int32(depth), self.ids[value[hit]], self.scores[value[hit]]))
            more = place + depth < ends[place]
            place, state = place[more], state[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def encode(self, segments: list[bytes]) -> list[np.ndarray]:
        """Ids of the best segmentation of each segment; of equal scores, the one whose last pieces are longest."""
        out: list[np.ndarray] = []
        batch: list[bytes] = []
        held = 0
        for segment in segments:
            if batch and held + len(segment) > BATCH:
                out += self._together(batch)
                batch, held = [], 0
            if len(segment) > BATCH:
                out.append(self._by_blocks(segment))
            else:
                batch.append(segment)
                held += len(segment)
        return out + self._together(batch)

    def _by_blocks(self, segment: bytes) -> np.ndarray:
        """Ids of one long segment; of each place only the length and the id of its best last piece are kept."""
        data = np.frombuffer(segment, np.uint8)
        n = len(data)
        length, via = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        carried = [0.0]  # best scores of the places from the start of the block on
        for low in range(0, n, BATCH):
            high = min(low + BATCH, n)
            reach = min(high + self.longest, n)
            start, end, piece, score = self.edges(data[low:reach], np.full(reach - low, reach - low, np.int32), high - low)
            order = np.lexsort((end, start))
            best = carried + [-np.inf] * (reach - low + 1 - len(carried))
            own, ids = [0] * len(best), [0] * len(best)
            behind = len(carried)
            for k in range(1, behind):
                own[k], ids[k] = int(length[low + k]), int(via[low + k])
            for s, e, p, w in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), score[order].tolist(), strict=True):
                gain = best[s] + w
                if gain > best[e]:
                    best[e], own[e], ids[e] = gain, e - s, p
            length[low + 1 : reach + 1], via[low + 1 : reach + 1] = own[1:], ids[1:]
            carried = best[high - low :]
        found, place = [], n
        while place:
            found.append(via[place])
            place -= length[place]
        return np.array(found[::-1], np.int32)

    def _together(self, segments: list[bytes]) -> list[np.ndarray]:
        if not segments:
            return []
        sizes = np.array([len(s) for s in segments])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(segments), np.uint8)
        begin = np.repeat(starts[:-1], sizes)
        start, end, piece, score = self.edges(data, np.repeat(starts[1:], sizes), len(data))
        step = end - begin[start]
        order = np.lexsort((start, end, step))
        start, end, piece, score, step = (x[order] for x in (start, end, piece, score, step))
        # Nodes: place p of a segment that starts at s is p + (number of the segment), so that ends do not meet the next start.
        shift = np.repeat(np.arange(len(segments)), sizes)
        source, target = start + shift[start], end + shift[start]
        best = np.zeros(len(data) + len(segments))
        via = np.zeros(len(best), np.int64)
        bounds = np.searchsorted(step, np.arange(1, int(sizes.max()) + 2))
        for t in range(len(bounds) - 1):
            a, b = bounds[t], bounds[t + 1]
            if b - a < STEP:
                for e in range(a, b):
                    gain = best[source[e]] + score[e]
                    if e == a or target[e] != target[e - 1] or gain > best[target[e]]:
                        best[target[e]], via[target[e]] = gain, e
                continue
            gain, aim = best[source[a:b]] + score[a:b], target[a:b]
            heads = np.flatnonzero(np.concatenate([[True], aim[1:] != aim[:-1]]))
            most = np.maximum.reduceat(gain, heads)
            hits = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(heads, b - a))))
            chosen = hits[np.concatenate([[True], aim[hits[1:]] != aim[hits[:-1]]])]
            best[aim[chosen]], via[aim[chosen]] = most, a + chosen
        node = starts[1:] + np.arange(len(segments))
        first = starts[:-1] + np.arange(len(segments))
        owner, steps = np.arange(len(segments)), []
        while len(node):
            e = via[node]
            steps.append((owner, piece[e]))
            node = source[e]
            more = node != first[owner]
            node, owner = node[more], owner[more]
        who, ids = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
        order = np.argsort(who, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(who, minlength=len(segments)))[:-1])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces, markers as blanks."""
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]


class _Index(dict):
    """Numbers keys in the order in which they are first seen."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Solved:
    """Looks segments up among those that are solved, and solves the new ones; forgets all when CACHE_BYTES are held."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index, self.pool, self.ends, self.held = _Index(), np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def ids(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and the number of ids of each."""
        if self.held > CACHE_BYTES:
            self.clear()
        known = len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))
        new = list(islice(self.index, known, None))
        if new:
            found = self.vocabulary.encode(new)
            sizes = np.array([len(x) for x in found])
            self.pool = np.concatenate([self.pool, *found])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.held += ENTRY_BYTES * len(new) + sum(map(len, new)) + 4 * int(sizes.sum())
        own = self.ends[numbers + 1] - self.ends[numbers]
        total = np.cumsum(own)
        return self.pool[np.repeat(self.ends[numbers] - total + own, own) + np.arange(total[-1] if len(total) else 0)], own


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", id_column: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(id, token_ids, n_tokens, n_byte_tokens) of each row; if decoded, with text from its token ids by the same worker, since a step of its own holds a second one."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        solved = Solved(v)
        for batch in text_slices(batches, "text", SLICE):
            texts = batch.column("text")
            raw = texts.cast(pa.binary()).to_pylist()
            if len(raw) == 1 and raw[0] and len(raw[0]) > SLICE:
                found, parts = v.segment.finditer(b" " + raw[0]), []
                while some := [m.group() for m in islice(found, RUN)]:
                    parts.append(solved.ids(some)[0])
                ids = np.concatenate(parts)
                n = np.array([len(ids)], np.int64)
            else:
                lists = [v.segment.findall(b" " + x) if x else [] for x in raw]
                ids, own = solved.ids([s for x in lists for s in x])
                n = np.bincount(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), own, len(lists)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            fallback = np.diff(np.concatenate([[0], np.cumsum(v.is_byte[ids])])[ends])
            if texts.null_count:
                column = pa.array([None if gone else ids[a:b] for gone, a, b in zip(texts.is_null().to_pylist(), ends[:-1], ends[1:], strict=True)], pa.list_(pa.int32()))
            else:
                column = list_column(ids, n, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(n), pa.array(fallback, pa.int64())], ["id", "token_ids", "n_tokens", "n_byte_tokens"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return with_texts(run(batches), shared.value)

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(both if decoded else run, f"id {kind}, token_ids array<int>, n_tokens bigint, n_byte_tokens bigint" + ", text string" * decoded)
    return out.withColumnRenamed("id", id_column)


def with_texts(batches: Iterator[pa.RecordBatch], v: Vocabulary, token_ids: str = "token_ids") -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices, with the text of their token ids."""
    for batch in batches:
        count = next(n for n in map("_n{}".format, range(len(batch.schema) + 1)) if n not in batch.schema.names)
        sizes = pc.fill_null(pc.list_value_length(batch.column(token_ids)), 0).cast(pa.int64())
        marked = pa.RecordBatch.from_arrays([*batch.columns, sizes], [*batch.schema.names, count])
        for part in text_slices([marked], count, SLICE // 4):
            ids = [y.values.to_numpy(zero_copy_only=False) if y.is_valid else None for y in part.column(token_ids)]
            texts = [None if x is None else v.decode(x)[1:].tobytes().decode(errors="replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names, "text"])


def decode(df: DataFrame, vocabulary: Vocabulary, token_ids: str = "token_ids") -> DataFrame:
    """All columns of df, and text from its token ids."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    df = df.drop("text")
    return df.mapInArrow(lambda batches: with_texts(batches, shared.value, token_ids), T.StructType([*df.schema.fields, T.StructField("text", T.StringType())]))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.load()
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded=True).select("doc_id", "n_tokens", "n_byte_tokens", "token_ids", F.sha2("text", 256).alias("decoded_sha256"))
