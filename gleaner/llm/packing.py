"""Mixture-controlled packing (deficit round-robin over source queues).

1. Rows are dealt evenly over partitions, in the order of a hash, and tokenised once; a task writes its
   ids as *lanes*, rows of about ``lane_tokens`` ids (16 bit each).
2. Token counts by lane and source (no ids are read for them) give the target
   proportions, those of the corpus where the caller has no others, and, by
   prefix sums over tasks and the lanes in them, the deficit with which every
   lane begins: what the lanes before it owe each source. So deficits carry
   across partitions though lanes are packed side by side.
3. Each lane fills windows of 1024. A window entitles every queue that has
   tokens left to its target share; queues are served as their deficit (entitled
   less served) falls due, and what is not served is carried to the next window. Where a queue
   is empty the others share its place. The deficit owed from earlier lanes is
   paid beside, a quarter of a queue's share at a time: it never crowds a whole
   window. All documents go in, so the last windows of a lane hold what the
   targets left over. A queue comes up again when its next piece is due, so a
   window costs what it holds, however many sources there are. The lane's last,
   partly filled window is cut into sequences whose lengths are powers of two,
   which need no padding.

Null and empty texts are documents of one token (the closing id 0); a null
source is the queue ``''``; a source without target comes last in its lane;
repeated rows are packed as often as they stand; ties go by the lane's order of
sources; a very long text is a lane of its own size; an empty table gives an empty
result. Only ``doc_id``, ``text`` and ``source`` are read, so further columns do not clash.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import SPACE, hash_spans, lean, materialize, slices

WINDOW = 1024
LANE_TOKENS = 1 << 20
#: A queue waits until its deficit is worth a piece of this many tokens.
MIN_PIECE = 32
#: What is owed from earlier lanes is paid at this part of a queue's share.
REPAY = 0.25
#: Distinct words whose ids a worker remembers; beyond, it forgets all and begins again.
CACHE_WORDS = 1 << 20

LANES = "part int, lane long, doc_ids array<long>, queues array<int>, lens array<long>, names array<string>, counts array<long>, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class ByteBpe:
    """Ids of whole texts, equal to those of the tokenizers library on the same vocabulary.

    Texts of ASCII and Latin-1 letters without apostrophes are cut into
    words by array operations, and each distinct word is encoded once; any
    other text goes through the encoder as it stands.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model = self._ranks(path)
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=model, special_tokens={})
        self.reset()

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int]:
        import json

        # The file spells bytes as printable characters: those that print stand for themselves, the others follow from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        return {bytes(spelled[c] for c in w): i for w, i in vocab.items() if all(c in spelled for c in w) and not w.startswith("<|")}

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint16)

    def slow(self, text: str) -> np.ndarray:
        if "<|" in text:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.asarray(self.enc.encode_ordinary(text), np.uint16)

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        piece = self.enc._encode_single_piece
        ids = [piece(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.store) + np.cumsum(size) - size
        flat = np.fromiter((x for y in ids for x in y), np.uint16, int(size.sum()))
        self.store = np.concatenate([self.store, flat])
        allk = np.concatenate([self.keys, keys])
        order = np.argsort(allk, kind="stable")
        self.keys, self.at, self.size = allk[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice."""
        rows = len(offsets) - 1
        if not len(data):
            return [np.zeros(0, np.uint16)] * rows
        high = data >= 0x80
        lead = data == 0xC3
        tail = np.zeros(len(data), bool)
        tail[1:] = lead[:-1]
        odd = (high & ~lead & ~tail) | (tail & ((data == 0x97) | (data == 0xB7))) | (data < 9) | ((data > 13) & (data < 32)) | (data == 39) | (data == 127)
        bad = np.add.reduceat(np.append(odd, False).astype(np.int64), np.minimum(offsets[:-1], len(data))) * (np.diff(offsets) > 0)
        letter = (((data | 32) >= 97) & ((data | 32) <= 122)) | high
        digit = (data >= 48) & (data <= 57)
        space = SPACE[data]
        kind = np.where(space, 0, np.where(letter, 1, np.where(digit, 2, 3))).astype(np.int8)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        first = first[:-1]
        prev = np.empty_like(kind)
        prev[0], prev[1:] = -1, kind[:-1]
        gap = np.zeros(len(data), bool)
        gap[1:] = data[:-1] == 32
        gap &= ~first
        last = np.zeros(len(data), bool)  # a white space before something solid in the same text
        last[:-1] = (kind[1:] != 0) & ~first[1:]
        begin = first | ((kind != 0) & (kind != prev) & ~gap) | ((kind == 0) & ((prev != 0) | last))
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        keys = hash_spans(data, starts, ends)
        uniq, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.reset()
        pos = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        new = self.keys[pos] != uniq if len(self.keys) else np.ones(len(uniq), bool)
        if new.any():
            self.learn(data, uniq[new], starts[where[new]], ends[where[new]])
            pos = np.searchsorted(self.keys, uniq)
        size, at = self.size[pos][back], self.at[pos][back]
        stop = np.cumsum(size)
        flat = self.store[np.arange(int(stop[-1])) + np.repeat(at - (stop - size), size)]
        edges = np.append(0, stop)[np.searchsorted(starts, offsets)]
        raw = data.tobytes() if bad.any() else b""
        return [flat[edges[i] : edges[i + 1]] if not bad[i] else self.slow(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")) for i in range(rows)]


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str | None) -> ByteBpe:
    """The worker's encoder; ``path`` None finds the public vocabulary of this machine."""
    if (path or "") not in _encoders:
        import public_tokenizers

        _encoders[path or ""] = ByteBpe(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return _encoders[path or ""]


def lanes_of(batches, path: str | None, lane_tokens: int):
    """Tokenise a partition and give it out as lanes."""
    bpe, part = encoder(path), TaskContext.get().partitionId()
    names: dict[str, int] = {}
    docs, queues, ids, held, k = [], [], [], 0, 0

    def flush():
        nonlocal names, docs, queues, ids, held, k
        lens = [len(x) for x in ids]
        counts = np.bincount(queues, weights=lens, minlength=len(names)).astype(np.int64)
        row = {"part": [part], "lane": [k], "doc_ids": [docs], "queues": [queues], "lens": [lens], "names": [list(names)], "counts": [counts.tolist()], "ids": [np.concatenate(ids).tobytes()]}
        out = pa.RecordBatch.from_pydict(row, schema=LANE_SCHEMA)
        names, docs, queues, ids, held, k = {}, [], [], [], 0, k + 1
        return out

    for batch in batches:
        doc_id, source = batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()
        for lo, hi, data, offsets in slices(batch.column("text")):
            for i, x in zip(range(lo, hi), bpe.encode(data, offsets)):
                docs.append(doc_id[i])
                queues.append(names.setdefault(source[i] or "", len(names)))
                ids.append(np.append(x, np.uint16(0)))
                held += len(x) + 1
                if held >= lane_tokens:
                    yield flush()
    if docs:
        yield flush()


LANE_SCHEMA = pa.schema([("part", pa.int32()), ("lane", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("queues", pa.list_(pa.int32())), ("lens", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


def fill(queues: np.ndarray, lens: np.ndarray, share: np.ndarray, owed: np.ndarray, window: int = WINDOW, min_piece: int = MIN_PIECE):
    """Deficit round-robin over one lane: yields windows, lists of (document, start, length).

    ``clock`` runs so that the queues with tokens left are entitled to one window
    more in every window; a queue's deficit is what it is entitled to, less what it was served.
    """
    order = np.argsort(queues, kind="stable")
    edge = np.searchsorted(queues[order], np.arange(len(share) + 1))
    left = np.bincount(queues, weights=lens, minlength=len(share)).astype(np.int64).tolist()
    head, done, served = edge[:-1].tolist(), [0] * len(share), [0] * len(share)
    order, sizes, share, owed = order.tolist(), lens.tolist(), share.tolist(), owed.tolist()

    def entitled(s: int, clock: float) -> float:
        return share[s] * clock + math.copysign(min(abs(owed[s]), REPAY * share[s] * clock), owed[s])

    def due(s: int) -> tuple[float, int]:
        """When the queue's next piece is worth serving."""
        if share[s] <= 0:
            return math.inf, s
        want = served[s] + min(min_piece, left[s])
        repaid = abs(owed[s]) / (REPAY * share[s])
        early = want / (share[s] * (1 + math.copysign(REPAY, owed[s])))
        return (early if early <= repaid else (want - owed[s]) / share[s]), s

    def serve(s: int, n: int, out: list) -> None:
        served[s] += n
        left[s] -= n
        while n:
            d = order[head[s]]
            take = min(n, sizes[d] - done[s])
            if out and out[-1][0] == d:
                out[-1] = (d, out[-1][1], out[-1][2] + take)
            else:
                out.append((d, done[s], take))
            n -= take
            done[s] += take
            if done[s] == sizes[d]:
                head[s] += 1
                done[s] = 0

    waiting = [due(s) for s in range(len(share)) if left[s]]
    heapq.heapify(waiting)
    live = sorted(share[s] for _, s in waiting)
    targeted, live = sum(x > 0 for x in live), math.fsum(live)
    clock = 0.0
    while waiting:
        out: list = []
        room = window
        if targeted:
            clock += window / live
        # What is due goes first; where less is due than the window holds, the next ones come early.
        while room and waiting:
            s = heapq.heappop(waiting)[1]
            quantum = window / live * share[s] * (1 + REPAY)
            n = max(min_piece, min(int(entitled(s, clock)) - served[s], math.ceil(quantum))) if share[s] > 0 else room
            n = min(n, room, left[s])
            serve(s, n, out)
            room -= n
            if left[s]:
                heapq.heappush(waiting, due(s))
            elif share[s] > 0:
                targeted -= 1
                live = max(live - share[s], 1e-12)
        yield out


def sequences(windows, window: int = WINDOW):
    """Full windows as they are; a partly filled one in parts whose lengths are powers of two."""
    for pieces in windows:
        total = sum(p[2] for p in pieces)
        if total == window:
            yield pieces
            continue
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        now, room = [], sizes.pop(0)
        for d, start, n in pieces:
            while n:
                take = min(n, room)
                now.append((d, start, take))
                start, n, room = start + take, n - take, room - take
                if not room:
                    yield now
                    now, room = [], sizes.pop(0) if sizes else 0


PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])


def pieces_of(batches, window: int, min_piece: int):
    for batch in batches:
        for row in batch.to_pylist():
            ids, lens, queues = np.frombuffer(row["ids"], np.uint16).astype("<u4"), np.array(row["lens"], np.int64), np.array(row["queues"])
            at = np.cumsum(lens) - lens
            known = {n: (p, d) for n, p, d in zip(row["targets"], row["shares"], row["owed"])}
            share, owed = (np.array([known[n][k] for n in row["names"]], float) for k in (0, 1))
            cols: list[list] = [[] for _ in PIECE_SCHEMA]
            for k, seq in enumerate(sequences(fill(queues, lens, share, owed, window, min_piece), window)):
                offset = 0
                for d, start, n in seq:
                    a = int(at[d]) + start
                    for c, v in zip(cols, (row["doc_ids"][d], start, n, zlib.crc32(ids[a : a + n]), int(lens[d]), row["part"] << 44 | row["lane"] << 24 | k, offset, row["names"][queues[d]])):
                        c.append(v)
                    offset += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECE_SCHEMA)], schema=PIECE_SCHEMA)


def lane_deficits(counts: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """part, lane, and lists targets (names), shares, owed of the lane's own sources.

    ``counts``: part, lane, name, n. Prefix sums run over the lanes of a task and
    over tasks, so no window holds more rows than a source has tasks, or a task lanes.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    if targets is None:
        total = counts.agg(F.sum("n").alias("all"))
        shares = counts.groupBy("name").agg(F.sum("n").alias("of_name")).crossJoin(F.broadcast(total)).select("name", (F.col("of_name") / F.col("all")).alias("share"))
    else:
        asked = targets.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.sum(F.greatest(F.col("share"), F.lit(0.0))).cast("double").alias("asked"))
        shares = asked.crossJoin(F.broadcast(asked.agg(F.sum("asked").alias("all")))).where("all > 0").select("name", (F.col("asked") / F.col("all")).alias("share"))
    of_part = counts.groupBy("part", "name").agg(F.sum("n").alias("n"))
    of_part = of_part.withColumn("part_mine", sum_of("n", before("name").orderBy("part"))).drop("n")
    # One row a task, then one row a lane: small whatever the input.
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).withColumn("part_all", sum_of("n", before().orderBy("part"))).drop("n")
    lanes = counts.groupBy("part", "lane").agg(F.sum("n").alias("n")).withColumn("lane_all", sum_of("n", before("part").orderBy("lane"))).drop("n")
    rows = counts.withColumn("lane_mine", sum_of("n", before("part", "name").orderBy("lane")))
    rows = rows.join(of_part, ["part", "name"]).join(parts, "part").join(lanes, ["part", "lane"]).join(shares, "name", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    owed = F.col("share") * (F.col("part_all") + F.col("lane_all")) - (F.col("part_mine") + F.col("lane_mine"))
    grouped = rows.groupBy("part", "lane").agg(F.collect_list(F.struct("name", "share", owed.alias("owed"))).alias("q"))
    return grouped.select("part", "lane", F.col("q.name").alias("targets"), F.col("q.share").alias("shares"), F.col("q.owed").alias("owed"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, lane_tokens: int = LANE_TOKENS, min_piece: int = MIN_PIECE, targets: DataFrame | None = None) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``, ``source``) in sequences of at most ``window`` tokens.

    ``targets`` (``name``, ``share``) gives the mixture of sources that windows
    follow while their queues last; without it windows follow the corpus. A lane
    holds up to ``lane_tokens`` ids and one document more; sequence ids leave 24
    bits for the sequences of a lane, 20 for the lanes of a task.
    """
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.monotonically_increasing_id().alias("_row")).withColumn("_place", F.xxhash64("_row"))
    # In the order of a hash every lane is a fair draw of the rows, and the same one whenever a task runs again.
    dealt = dealt.repartition("_place").sortWithinPartitions("_place", "_row").select("doc_id", "source", "text")
    lanes = materialize(dealt.mapInArrow(lean(lambda it: lanes_of(it, tokenizer_path, lane_tokens)), LANES), "lanes")
    counts = materialize(lanes.select("part", "lane", F.explode(F.arrays_zip("names", "counts")).alias("x")).select("part", "lane", F.col("x.names").alias("name"), F.col("x.counts").alias("n")), "lane-counts")
    owed = materialize(lane_deficits(counts, targets), "lane-deficits")
    ready = lanes.join(owed, ["part", "lane"]).select("part", "lane", "doc_ids", "queues", "lens", "names", "ids", "targets", "shares", "owed")
    return ready.mapInArrow(lean(lambda it: pieces_of(it, window, min_piece)), PIECES)
