"""Operator 6: best-fit packing improved by swap-based local search.

Documents become ids plus an end id; a document over the limit is cut into
full pieces, its first piece taking the remainder.  Pieces are dealt by hash
into groups of bounded size.  In a group, best fit in order of falling size
makes bins; then items are moved, exchanged one for one, or two for one
between underfull bins wherever that raises the sum of squared fills, so that
fuller bins fill up and the emptiest run empty.  The items of bins that stay
underfull are dealt anew into fewer groups and packed again, ``ROUNDS`` times,
so that what is left over in one group meets what is left over in others.

Defined cases: a null text is empty (a piece of the end id alone); repeated
rows are packed once each; other columns are ignored; an empty table gives an
empty result.  Nothing is dropped: each piece has one sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import MEMO, SHARED_MEMO, LibraryCodec, codec, encode_texts
from .common import slices, stored, table

LIMIT = 1024
END_ID = 2
#: Items that one task packs at a time, and how often underfull bins are dealt anew.
GROUP = 8192
ROUNDS = 3


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, shared: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    ``shared``: the workers serve other stages too, so a task holds few texts
    and chunks at a time and leaves none of them behind.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = codec(LibraryCodec, path)
        for batch in slices(batches, 256) if shared else batches:
            rows: list[list] = [[], [], [], [], []]
            encoded = encode_texts(coder, batch.column(1).to_pylist(), *((500_000, SHARED_MEMO) if shared else (4_000_000, MEMO)))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                n = len(ids) // 4
                first = n if n <= limit else n % limit or limit
                for k, start in enumerate([0, *range(first, n, limit)]):
                    part = ids[4 * start:4 * (start + limit if k else first)]
                    for column, value in zip(rows, (doc, k, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if shared:
            coder.memo.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Best fit in order of falling size: each item goes to the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    open_rooms = 0  # bit r is set if a bin with room r exists
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            where = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, where = limit, len(bins)
            bins.append([])
        bins[where].append(item)
        if room > size:
            by_room[room - size].append(where)
            open_rooms |= 1 << (room - size)
    return bins


def improve(sizes: list[int], bins: list[list[int]], limit: int, passes: int = 6) -> list[list[int]]:
    """Local search between underfull bins; each step raises the sum of squared fills.

    Gaining d for bin A from bin B changes it by 2d(A - B + d), so a step is
    taken where fill(B) < fill(A) + d.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    for _ in range(passes):
        under = sorted((k for k in range(len(bins)) if 0 < fill[k] < limit), key=lambda k: -fill[k])
        if len(under) < 2:
            break
        singles: dict[int, list[tuple[int, int]]] = {}
        doubles: dict[int, list[tuple[int, int, int]]] = {}
        for k in under:
            one = {sizes[i]: i for i in bins[k]}
            for s, i in one.items():
                singles.setdefault(s, []).append((k, i))
            few = list(one.items())[:32]  # distinct sizes of one bin; pairs of the rest add no new reach here
            for x in range(len(few)):
                for y in range(x):
                    doubles.setdefault(few[x][0] + few[y][0], []).append((k, few[x][1], few[y][1]))
        place = {i: k for k in under for i in bins[k]}

        def giver(entries, a, gain):
            """The emptiest-last entry of another bin whose items are still there and may give."""
            while entries:
                k, *items = entries[-1]
                if any(place.get(i) != k for i in items):
                    entries.pop()
                    continue
                break
            for k, *items in reversed(entries[-8:]):
                if k != a and fill[k] < fill[a] + gain and all(place.get(i) == k for i in items):
                    return k, items
            return None

        changed = False

        def swap(a, b, out, came):
            for i in out:
                bins[a].remove(i)
                bins[b].append(i)
                place[i] = b
            for i in came:
                bins[b].remove(i)
                bins[a].append(i)
                place[i] = a
            gain = sum(sizes[i] for i in came) - sum(sizes[i] for i in out)
            fill[a] += gain
            fill[b] -= gain

        for a in under:
            while 0 < fill[a] < limit:
                room, found = limit - fill[a], None
                own = {sizes[i]: i for i in bins[a]}
                # fill the bin up exactly if a move or an exchange can, else gain the most that one can
                for gain in range(room, 0, -1):
                    if got := giver(singles.get(gain, []), a, gain):
                        found = (got[0], [], got[1])
                    for s, i in own.items() if not found else ():
                        if got := giver(singles.get(s + gain, []), a, gain) or giver(doubles.get(s + gain, []), a, gain):
                            found = (got[0], [i], got[1])
                            break
                    if found:
                        break
                if not found:
                    break
                swap(a, *found)
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _pack_group(limit: int, round_no: int, last: bool):
    def run(key, group):
        # in a defined order, so that a task that is run again packs the same way
        group = group.sort_by([(c, "ascending") for c in ("length", "ids_crc32", "doc_id", "piece", "start")])
        sizes = group.column("length").to_pylist()
        bins = improve(sizes, best_fit(sizes, limit), limit)
        where, offset, done = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8"), np.zeros(len(sizes), bool)
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                where[i], offset[i] = k, at
                at += sizes[i]
            done[items] = last or at == limit
        sequence = (round_no << 58) + (int(key[0].as_py()) << 24) + where
        return pa.table([*(group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset), pa.array(done)],
                        names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "done"])

    return run


def pack(items: DataFrame, limit: int = LIMIT, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Give every piece a sequence and an offset there."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest, parts = items, []
    for k in range(rounds):
        n = rest.count()
        groups = max(1, -(-n // group))
        last = k == rounds - 1 or groups == 1
        dealt = rest.select(*columns, F.pmod(F.xxhash64(F.lit(k), *columns), F.lit(groups)).alias("_group"))
        packed = dealt.groupBy("_group").applyInArrow(_pack_group(limit, k, last), schema)
        packed = packed if last else stored(packed, "packed")
        parts.append(packed.filter("done").drop("done"))
        if last:
            break
        rest = packed.filter("not done")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(stored(cut, "pieces"))
