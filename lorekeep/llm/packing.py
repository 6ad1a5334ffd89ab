"""Filling containers of fixed capacity with bounded-space online packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.spread import spread
from lorekeep.llm.tokens import DEFAULT, encoder, shipped
from lorekeep.session import cut


class OpenWindows:
    """At most ``width`` open containers; an item goes where it leaves the least room, else the fullest closes."""

    def __init__(self, capacity: int, width: int) -> None:
        self.capacity, self.width = capacity, width
        self._by_room: list[tuple[int, int]] = []
        self._held: dict[int, list] = {}
        self._next = 0

    def put(self, size: int, members: list) -> tuple[int, list] | None:
        """Places an item of ``size``; returns (used, members) of a container that closed on the way."""
        closed = None
        at = bisect_left(self._by_room, (size, -1))
        if at < len(self._by_room):
            room, k = self._by_room.pop(at)
        else:
            if len(self._by_room) >= self.width:
                closed = self._take(0)
            room, k = self.capacity, self._next
            self._next += 1
            self._held[k] = []
        self._held[k].extend(members)
        if room == size:
            # nothing fits any more
            full = (self.capacity, self._held.pop(k))
            if closed is not None:
                # both leave: hand the full one over at the next call
                insort(self._by_room, (0, k))
                self._held[k] = full[1]
                return closed
            return full
        insort(self._by_room, (room - size, k))
        return closed

    def _take(self, at: int) -> tuple[int, list]:
        room, k = self._by_room.pop(at)
        return self.capacity - room, self._held.pop(k)

    def rest(self) -> Iterator[tuple[int, list]]:
        """The containers still open, the fullest first."""
        while self._by_room:
            yield self._take(0)


_MEMBER = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("piece_no", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("size", T.IntegerType(), False),
    ]
)
_WINDOWS = T.StructType(
    [
        T.StructField("container", T.StringType(), False),
        T.StructField("is_open", T.BooleanType(), False),
        T.StructField("used", T.IntegerType(), False),
        T.StructField("members", T.ArrayType(_MEMBER, False), False),
    ]
)


def _pid() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.name for f in _WINDOWS])


def _flushed(rounds: int, pieces: Iterator[tuple[int, list]], capacity: int, width: int, last: bool):
    windows, rows, n = OpenWindows(capacity, width), [], 0
    label = f"r{rounds}-p{_pid()}"

    def row(is_open: bool, found: tuple[int, list]) -> None:
        nonlocal n
        rows.append((f"{label}-{n}", is_open, found[0], found[1]))
        n += 1

    for size, members in pieces:
        if size == capacity:
            row(False, (size, members))
        else:
            closed = windows.put(size, members)
            if closed is not None:
                row(False, closed)
        if len(rows) >= 2000:
            yield _frame(rows)
            rows.clear()
    for found in windows.rest():
        row(not last and found[0] < capacity, found)
    yield _frame(rows)


def pack(
    spark: SparkSession, sized: DataFrame, capacity: int = 2048, width: int = 64, fan_in: int = 16
) -> DataFrame:
    """Containers for the items of ``sized`` (item string, size long).

    Result: container string, item string, piece_no int, start long, size int; ``start`` is the offset inside the
    item. An item of more than ``capacity`` is cut into full containers and one rest; every other item stays whole.
    Items of size null, zero or less need no room and are left out; equal or null items are all placed. Each partition
    keeps ``width`` open containers; what is still open at its end moves on to a round with ``fan_in`` times fewer
    partitions, so that no task ever receives more than ``fan_in * width`` open containers, until one is left.
    The partitions are written once to the shared folder between the rounds, so no item is sized twice.
    """

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[tuple[int, list]]:
            for frame in frames:
                for item, size in zip(frame["item"], frame["size"], strict=True):
                    if size is None or not size > 0:
                        continue
                    size, at, no = int(size), 0, 0
                    while size - at > capacity:
                        yield capacity, [(item, no, at, capacity)]
                        at, no = at + capacity, no + 1
                    yield size - at, [(item, no, at, size - at)]

        yield from _flushed(0, pieces(), capacity, width, False)

    found = cut(sized.select(F.col("item").cast("string").alias("item"), "size").mapInPandas(first, _WINDOWS))
    rounds, parts = 1, max(1, -(-found.rdd.getNumPartitions() // fan_in))
    done = [found.where(~F.col("is_open"))]
    while True:
        last = parts == 1

        def again(frames: Iterator[pd.DataFrame], rounds: int = rounds, last: bool = last) -> Iterator[pd.DataFrame]:
            rows = [r for f in frames for r in zip(f["used"], f["container"], f["members"], strict=True)]
            # larger ones first pack best; the name makes the order the same in every run
            rows.sort(key=lambda r: (-r[0], r[1]))
            parts = ((int(u), [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in ms]) for u, _, ms in rows)
            yield from _flushed(rounds, parts, capacity, len(rows) + 1 if last else width, last)

        group = F.pmod(F.xxhash64("container"), F.lit(parts)).cast("int")
        open_ = found.where("is_open").withColumn("__g", group)
        # one partition for each group, so the bound above holds
        found = open_.repartitionById(parts, "__g").drop("__g").mapInPandas(again, _WINDOWS)
        if last:
            done.append(found)
            break
        found = cut(found)
        done.append(found.where(~F.col("is_open")))
        rounds, parts = rounds + 1, max(1, -(-parts // fan_in))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    return whole.select("container", F.explode("members").alias("m")).select("container", "m.*")


def pack_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    width: int = 64,
    name: str = DEFAULT,
    folder: str | None = None,
) -> DataFrame:
    """``pack`` over texts, each as large as its number of tokens; ``start`` and ``size`` count tokens.

    Null and empty texts have no tokens and are in no container.
    """
    key, ranks = shipped(df.sparkSession, name, folder)

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(key, ranks.value)
        for frame in frames:
            yield pd.DataFrame({"item": frame["item"], "size": [e.count(t) for t in frame["text"]]})

    texts = df.where(F.length(text_col) > 0).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )
    sized = spread(texts, "item").mapInPandas(sizes, "item string, size long")
    return pack(df.sparkSession, sized, capacity, width)
