"""Filling containers of fixed capacity by bin completion, a branch and bound over ways to fill one container at a time.

The largest item left opens a container; its undominated fillings are tried, fullest first. A branch is given up as soon as
the space it has wasted shows that it cannot take fewer containers than the best solution so far, which best fit decreasing
starts. Every block of items is packed by one task as the rows come by; only sizes are kept, so nothing is shuffled.
"""

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.splitting import pieces
from corpusloom.llm.tokenizer import VOCABULARY, encoder


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of sizes, largest item first, each into the fullest container that it fits."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(room, (s, -1))
        if k < len(room):
            left, at = room.pop(k)
        else:
            left, at = capacity, len(bins)
            bins.append([])
        bins[at].append(s)
        bisect.insort(room, (left - s, at))
    return bins


def least(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: the sum over the capacity, or more where large items leave room that none fills."""
    up, total = sorted(sizes), sum(sizes)
    best = -(-total // capacity)
    upto = [0]
    for s in up:
        upto.append(upto[-1] + s)
    big = [s for s in up if 2 * s > capacity]
    for k in sorted({s for s in up if 2 * s <= capacity}):
        huge = len(big) - bisect.bisect_right(big, capacity - k)
        half = len(big) - huge
        small = upto[bisect.bisect_right(up, capacity // 2)] - upto[bisect.bisect_left(up, k)]
        room = half * capacity - sum(big[:half])
        best = max(best, huge + half + max(0, -(-(small - room) // capacity)))
    return best


def _fillings(up: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """All undominated sets of the sizes left (up: all sizes, ascending; counts: how many are left of each) that fit into room,
    fullest first. They are made one by one, as they are asked for.

    reach[k] has bit t set if some of the first k sizes sum to t, so that no step of the search for a sum is in vain.
    """
    upto = bisect.bisect_right(up, room)
    left = [s for s in up[:upto] if counts[s]]
    mask, reach = (1 << room + 1) - 1, [1]
    for s in left:
        r = reach[-1]
        for _ in range(min(counts[s], room // s)):
            more = (r | r << s) & mask
            if more == r:
                break
            r = more
        reach.append(r)
    free = 0
    for s in left:
        free |= 1 << s

    def sets(k: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
        for j in range(k if total else 0, 0, -1):  # left[j - 1] is the largest of the set
            if not reach[j] >> total & 1:
                break
            s = left[j - 1]
            for n in range(min(counts[s], total // s), 0, -1):
                if reach[j - 1] >> total - n * s & 1:
                    for rest in sets(j - 1, total - n * s):
                        yield (s,) * n + rest

    def dominated(f: tuple[int, ...], slack: int) -> bool:
        """Another size would fit beside the chosen, or some of them could be replaced by one that is left out, no smaller than
        their sum, and still fits."""
        out, one, two, some = free, 0, 0, 0
        for s in f:
            two |= two << s | some << s
            some |= some << s | 1 << s
            one |= 1 << s
        for s in set(f):
            if counts[s] <= f.count(s):
                out &= ~(1 << s)
        if slack and (out >> 1 & (1 << slack) - 1 or one & _within(out >> 1, slack - 1)):
            return True
        return bool(two & _within(out, slack))

    r = reach[-1]
    while r:
        total = r.bit_length() - 1
        r ^= 1 << total
        for f in sets(len(left), total):
            if not dominated(f, room - total):
                yield f


def _within(bits: int, slack: int) -> int:
    """Bit t is set if any of the bits t to t + slack is."""
    width = 1
    while width <= slack:
        step = min(width, slack + 1 - width)
        bits |= bits >> step
        width += step
    return bits


def completed(sizes: list[int], capacity: int, budget: int = 4_000) -> tuple[list[list[int]], bool]:
    """(containers of sizes, none of which exceeds capacity; whether no packing has fewer).

    budget bounds the fillings tried, and so the time, not the items: where it runs out, the best packing met so far is given,
    never worse than best fit decreasing, and the second value is False unless it meets the lower bound.
    """
    best, low = best_fit(sizes, capacity), least(sizes, capacity)
    total, steps, waste = sum(sizes), 0, 0
    if len(best) <= low:
        return best, True
    counts = dict(Counter(sizes))
    up = sorted(counts)
    left, top = len(sizes), len(up) - 1
    # Each level of the stack: the untried fillings of a container, the fullest first, its largest size, and where that stood.
    stack: list[tuple[Iterator[tuple[int, ...]], int, int]] = []
    done: list[tuple[int, ...]] = []

    def open_one() -> None:
        nonlocal top
        was = top
        while not counts[up[top]]:
            top -= 1
        s = up[top]
        rest = dict(counts)  # the fillings are made later, when other containers have been tried and undone
        rest[s] -= 1
        stack.append((_fillings(up[: top + 1], rest, capacity - s), s, was))

    open_one()
    while stack and steps < budget and len(best) > low:
        if len(done) == len(stack):  # back from below: this level's filling is put back
            back = done.pop()
            for s in back:
                counts[s] += 1
            waste -= capacity - sum(back)
            left += len(back)
        fill, s, was = stack[-1]
        take = next(fill, None)
        steps += 1
        # Fillings come fullest first: once one wastes too much, the others of its level do too.
        if take is None or waste + capacity - s - sum(take) > (len(best) - 1) * capacity - total:
            top = was
            stack.pop()
            continue
        take = (s, *take)
        for x in take:
            counts[x] -= 1
        done.append(take)
        waste += capacity - sum(take)
        left -= len(take)
        if left:
            open_one()
        else:
            best = [list(b) for b in done]
    return best, len(best) <= low or not stack


def complete(sizes: list[int], capacity: int, budget: int = 4_000) -> list[list[int]]:
    return completed(sizes, capacity, budget)[0]


def packed(df: DataFrame, key: str, text: str, capacity: int, block: int = 4_096, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, container, place, n_tokens): the container of each row's text and the tokens that stand before it there.
    Columns of df beside key and text are not read.

    Sizes are tokens of the vocabulary. A text is whole (piece 0) unless it is larger than the capacity: then its pieces, cut
    at natural boundaries without overlap, are items of their own. Null and empty texts are items of no tokens and take the first
    container of their block. Containers are named by the partition, block and number; a block holds up to block items of one
    partition, so that one container in some hundreds may stay partly empty at the end of a block. A block is filled by completed().
    """
    kind = df.schema[key].dataType.simpleString()
    return _blocks(df, key, text, capacity, block, vocabulary, f"`{key}` {kind}, piece int, container string, place int, n_tokens int", False)


def block_report(df: DataFrame, key: str, text: str, capacity: int, block: int = 4_096, vocabulary: str = VOCABULARY) -> DataFrame:
    """(block, items, tokens, least, best_fit, containers, proved) of each block of packed(): the lower bound, what best fit decreasing
    needs, what is used, and whether no packing of the block has fewer."""
    return _blocks(df, key, text, capacity, block, vocabulary, "block string, items int, tokens bigint, least int, best_fit int, containers int, proved boolean", True)


def _blocks(df: DataFrame, key: str, text: str, capacity: int, block: int, vocabulary: str, schema: str, report: bool) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no = encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list = []
        kind, items = None, []

        def out() -> pa.RecordBatch:
            nonlocal no
            sizes = [n for _, _, n in items if n]
            bins, proved = completed(sizes, capacity)
            if report:
                row = (f"{part:06d}-{no:06d}", len(sizes), sum(sizes), least(sizes, capacity), len(best_fit(sizes, capacity)), len(bins), proved)
                no += 1
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))],
                                                  names=["block", "items", "tokens", "least", "best_fit", "containers", "proved"])
            bins = bins or [[]]
            slots: dict[int, list[tuple[int, int]]] = {}
            for b, sizes in enumerate(bins):
                at = 0
                for s in sizes:
                    slots.setdefault(s, []).append((b, at))
                    at += s
            put = [slots[n].pop() if n else (0, 0) for _, _, n in items]
            names = [f"{part:06d}-{no:06d}-{b:05d}" for b in range(len(bins))]
            no += 1
            at = pa.array([k for k, _, _ in items], pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.chunked_array(keys, kind).combine_chunks().take(at), pa.array([p for _, p, _ in items], pa.int32()), pa.array([names[b] for b, _ in put], pa.string()),
                 pa.array([x for _, x in put], pa.int32()), pa.array([n for _, _, n in items], pa.int32())],
                names=[key, "piece", "container", "place", "n_tokens"])

        base = 0
        for b in batches:
            kind = b.column(0).type
            keys.append(b.column(0))
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py() or ""
                for p, (_, _, _, n) in enumerate(pieces(enc, t, capacity, 0)):
                    items.append((base + k, p, n))
                if len(items) >= block:
                    yield out()
                    keys, base, items = [b.column(0)], 0, []
            base += b.num_rows
        if items:
            yield out()

    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return src.mapInArrow(run, schema)
