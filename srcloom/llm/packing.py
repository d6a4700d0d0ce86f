"""Best-fit packing of tokenized documents by linear grouping.

Only the histogram of piece lengths, at most ``capacity`` rows, is planned on the driver;
documents are assigned to the plan by their rank among the pieces of equal length, so
the plan's size does not depend on how many documents there are.

1. Lengths above ``capacity / 8`` are large. Sorted, they are split into groups of equal
   cardinality, and every length is rounded up to the largest of its group.
2. The few rounded sizes give a small covering problem over configurations (multisets
   that fit one sequence); its linear program is solved by column generation, and the
   whole part of the solution is kept.
3. The configurations' places are taken by the actual documents of each group.
4. What is left over, and all small pieces, go by decreasing length into the fullest
   sequence that still has room.

Edge cases: a null or empty text is the end token alone; a null id is kept; repeated rows
are packed once each; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm import bpe, common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = f"{PIECES}, sequence_id long, offset long"
#: Every length is ranked in so many independent parts, so one frequent length is not one task.
RANK_PARTS = 256


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Token pieces of every text: whole if it fits, else cut so that only the first is short."""

    def run(batches):
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(bpe.encoder(path).ids(text), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                start, end, piece = 0, first, 0
                while start < len(ids):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return common.id_and_text(docs).mapInArrow(run, PIECES)


# ---- planning on a histogram -----------------------------------------------------------------


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity."""
    worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    size = np.array(sizes)
    for room in range(min(sizes), capacity + 1):
        fits = np.flatnonzero(size <= room)
        gains = worth[room - size[fits]] + values[fits]
        k = int(gains.argmax())
        if gains[k] > worth[room - 1] + 1e-12:
            worth[room], choice[room] = gains[k], fits[k]
        else:
            worth[room] = worth[room - 1]
    taken, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            taken[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(worth[capacity]), taken


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[int, np.ndarray]]:
    """(times, configuration): the whole part of the best fractional cover of the demand."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    amount = inverse @ np.array(demand, float)
    for _ in range(rounds):
        value, column = best_configuration(sizes, np.maximum(np.ones(n) @ inverse, 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = column
        inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ np.array(demand, float), 0)
    return [(int(amount[k] + 1e-9), basis[:, k].astype(int)) for k in range(n) if int(amount[k] + 1e-9) > 0]


def take(queue: list[list[int]], count: int) -> list[tuple[int, int]]:
    """The next ``count`` items of a queue of [length, items] runs."""
    out = []
    while count and queue:
        n = min(count, queue[0][1])
        out.append((queue[0][0], n))
        queue[0][1] -= n
        count -= n
        if not queue[0][1]:
            queue.pop(0)
    return out


def plan(histogram: dict[int, int], capacity: int, groups: int = 64) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: pieces in each}): how to pack all pieces of the histogram."""
    bins: list[list] = []  # [sequences, {length: pieces in each}, room]
    rest = {k: v for k, v in histogram.items() if v}
    if rest.get(capacity):
        bins.append([rest.pop(capacity), {capacity: 1}, 0])
    large = sorted((k for k in rest if k > capacity // 8), reverse=True)
    total = sum(rest[k] for k in large)
    n = min(groups, total)
    queues: list[list[list[int]]] = []
    queue = [[k, rest[k]] for k in large]
    for g in range(n):
        part = take(queue, total * (g + 1) // n - total * g // n)
        if queues and part[0][0] == queues[-1][0][0]:  # groups that round to the same size are one
            queues[-1] += [list(x) for x in part]
        else:
            queues.append([list(x) for x in part])
    if queues:
        sizes = [q[0][0] for q in queues]
        for times, configuration in configurations(sizes, [sum(x[1] for x in q) for q in queues], capacity):
            places = [take(queues[g], times) for g in np.repeat(np.arange(len(sizes)), configuration)]
            places = [p for p in places if p]
            while places:  # as many equal sequences as the shortest run of every place allows
                run = min(p[0][1] for p in places)
                content: dict[int, int] = {}
                for p in places:
                    content[p[0][0]] = content.get(p[0][0], 0) + 1
                bins.append([run, content, capacity - sum(k * v for k, v in content.items())])
                places = [q for p in places if (q := ([(p[0][0], p[0][1] - run)] if p[0][1] > run else []) + p[1:])]
        for k in large:
            rest[k] = 0
        for q in queues:
            for length, count in q:
                rest[length] += count
    rooms: dict[int, list[int]] = {}
    for k, b in enumerate(bins):
        rooms.setdefault(b[2], []).append(k)
    open_rooms = sorted(rooms)

    def put_back(room: int, k: int) -> None:
        if room not in rooms:
            bisect.insort(open_rooms, room)
            rooms[room] = []
        rooms[room].append(k)

    for length in sorted((k for k, v in rest.items() if v), reverse=True):
        left = rest[length]
        while left:
            at = bisect.bisect_left(open_rooms, length)
            if at == len(open_rooms):
                each = min(capacity // length, left)
                sequences = left // each
                bins.append([sequences, {length: each}, capacity - each * length])
                put_back(bins[-1][2], len(bins) - 1)
                left -= sequences * each
                continue
            room = open_rooms[at]
            k = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                open_rooms.pop(at)
            sequences, content, _ = bins[k]
            each = min(room // length, left)
            used = min(sequences, left // each)
            if used < sequences:
                bins.append([sequences - used, dict(content), room])
                put_back(room, len(bins) - 1)
            content = dict(content)
            content[length] = content.get(length, 0) + each
            bins[k] = [used, content, room - each * length]
            put_back(bins[k][2], k)
            left -= used * each
    return [(b[0], b[1]) for b in bins]


def intervals(packing: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Per length, which ranks go where: rows of (length, first rank, pieces in each, first sequence, first offset)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for sequences, content in packing:
        offset = 0
        for length, each in content.items():
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * sequences
            offset += each * length
        sequence += sequences
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Place pieces (columns ``PIECES``, written tables preferred: they are read three times)."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS))
    parts = parts.withColumn("part", part)
    counts = parts.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = intervals(plan(histogram, capacity))
    keys = table[:, 0] << 44 | table[:, 1]
    # At most capacity * RANK_PARTS rows, however many documents there are.
    before = counts.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = parts.withColumn("rank", rank).join(before, ["length", "part"])
    names = [c.split()[0] for c in PIECES.split(", ")]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            at = batch.column("at").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length << 44 | at, side="right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            local = at - row[:, 1]
            sequence, offset = row[:, 3] + local // row[:, 2], row[:, 4] + local % row[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, (F.col("rank") + F.col("before")).cast("long").alias("at")).mapInArrow(place, SCHEMA)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    return pack(common.stage(pieces(docs, path, capacity, end_id), "pieces"), capacity)
