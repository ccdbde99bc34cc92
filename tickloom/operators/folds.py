"""Ordered folds: a state that each row of a key moves on, for what no window function expresses.

Rows are dealt by key and sorted; a task walks them batch by batch and holds one key's state, so a key may be as long as it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(df: DataFrame, by: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, list[tuple]]], schema: str, rows: int = 4096, end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """What step(state, row) → (state, rows out) emits, with a fresh start() for each key; null keys are keys.

    row holds df's columns in their order. rows: what is handed on at a time; batches may cut a key anywhere. end(state): rows after a key's last.
    """
    names = df.columns
    at = [names.index(c) for c in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        columns = None
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for row in batch.itertuples(index=False, name=None):
                mine = tuple(row[i] for i in at)
                if key is None or mine != key:
                    if end and key is not None:
                        out += end(state)
                    key, state = mine, start()
                state, made = step(state, row)
                out += made
                if len(out) >= rows:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if end and key is not None:
            out += end(state)
        if out:
            yield pd.DataFrame(out, columns=columns)

    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInPandas(run, schema)


def frames(chunks: DataFrame, life: str = "life", order: Sequence[str] = ("tick", "seq"), counter: str = "counter", payload: str = "payload") -> DataFrame:
    """life, tick, counter, size, payload: the payload gathered so far, at each row whose counter is new to the life.

    chunks: life long, tick long, seq long, counter long (null: no new count), payload binary (null: nothing to add). Payloads only grow; a row
    with a new counter shows them with its own chunk.
    """
    rows = chunks.select(F.col(life).cast("long"), *[F.col(c).cast("long").alias(c) for c in order], F.col(counter).cast("long").alias("counter"), F.col(payload).alias("payload"))

    def step(state, row):
        seen, held = state
        tick, count, chunk = row[1], row[-2], row[-1]
        if chunk:
            held += bytes(chunk)
        if count is None or count == seen:
            return (seen, held), []
        return (count, held), [(row[0], tick, count, len(held), bytes(held))]

    return folded(rows, [life], order, lambda: (None, bytearray()), step, f"{life} long, {order[0]} long, counter long, size long, payload binary", rows=64)


def frame_sizes(chunks: DataFrame, life: str = "life", order: Sequence[str] = ("tick", "seq"), counter: str = "counter", payload: str = "payload") -> DataFrame:
    """life, tick, counter, size of each frame, by window functions: for where the payloads themselves are not wanted."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(life).orderBy(*order)
    before = F.last(counter, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    size: Column = F.coalesce(F.sum(F.octet_length(payload)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long")
    rows = chunks.select(life, order[0], F.col(counter).alias("counter"), size.alias("size"), before.alias("__before"))
    return rows.where(F.col("counter").isNotNull() & ~F.col("counter").eqNullSafe(F.col("__before"))).drop("__before")


#: Most bytes of a vector and most slots of a recipe (fixed values of the log format).
VECTOR_BYTES, SLOTS = 4096, 64
RECIPE_NUMBERS = ("active_slot", "recipe_version", "graph_definition", "graph_iteration")


class _Vector:
    """Bytes that are set whole, by length, or one at a time."""

    def __init__(self, grows: bool):
        self.held, self.length, self.grows = bytearray(), None, grows

    def resized(self, n: int) -> None:
        self.held = self.held[:n] + bytes(max(0, n - len(self.held)))

    def write(self, place: int | None, number: int | None, whole: bytes | None) -> None:
        if whole is not None:
            if len(whole) <= VECTOR_BYTES:
                self.held, self.length = bytearray(whole), len(whole)
        elif place is None:
            if number is not None and 0 <= number <= VECTOR_BYTES:
                self.resized(number)
                self.length = number
        elif number is not None and 0 <= number <= 255 and 0 <= place < VECTOR_BYTES:
            self.resized(max(len(self.held), place + 1))
            self.held[place] = number
            if self.grows or self.length is None:
                self.length = len(self.held)

    def shown(self) -> bytes:
        return bytes(self.held[: self.length]) + bytes(max(0, (self.length or 0) - len(self.held)))


class _Recipe:
    """What is known of one life's recipe. topologies: by slot."""

    def __init__(self):
        self.numbers, self.dynamic, self.topologies = dict.fromkeys(RECIPE_NUMBERS), _Vector(True), {}
        self.tick, self.touched = None, False

    def snapshot(self, life) -> list[tuple]:
        """The row of the tick that ends, if anything changed in it and both kinds of bytes are known."""
        touched, self.touched = self.touched, False
        if not touched or not self.dynamic.held or not self.topologies or max(self.topologies) >= SLOTS:
            return []
        slots = [self.topologies[k].shown() if k in self.topologies else b"" for k in range(max(self.topologies) + 1)]
        return [(life, self.tick, *self.numbers.values(), slots, self.dynamic.shown())]


def recipes(changes: DataFrame, life: str = "life", order: Sequence[str] = ("tick", "seq")) -> DataFrame:
    """life, tick, the recipe's numbers, topologies (binary, by slot) and dynamic: one row per life and tick in which its pose recipe changed.

    changes: life, tick, seq, field, slot, place, number, payload. Fields are the numbers' names, and the vectors `dynamic` and `topology` (with
    its slot): payload sets a vector whole, number alone its length, number at a place one byte. A byte beyond a topology's length is held
    but not shown until the length says so; dynamic grows. A row shows the state at the end of its tick; nothing is shown before both
    kinds of bytes are there. Other fields, vectors over VECTOR_BYTES and rows without a slot where one is needed change nothing.
    A task holds one life's recipe (at most SLOTS + 1 vectors that can be shown).
    """
    kinds = {"field": "string", "slot": "int", "place": "int", "number": "long", "payload": "binary"}
    wanted = changes.where(F.col("field").isin(*RECIPE_NUMBERS, "dynamic", "topology") & (~(F.col("field") == "topology") | (F.col("slot") >= 0)))
    rows = wanted.select(F.col(life).cast("long"), *[F.col(c).cast("long").alias(c) for c in order], *[F.col(c).cast(t).alias(c) for c, t in kinds.items()])

    def step(state, row):
        _, recipe = state
        mine, tick, (field, slot, place, number, payload) = row[0], row[1], row[-5:]
        out = recipe.snapshot(mine) if recipe.tick is not None and tick != recipe.tick else []
        recipe.tick, recipe.touched = tick, True
        if field in recipe.numbers:
            recipe.numbers[field] = None if number is None else int(number)
        else:
            # a slot that no recipe has hides the whole, so only its number is kept
            vector = recipe.dynamic if field == "dynamic" else recipe.topologies.setdefault(int(slot), _Vector(False))
            if field == "dynamic" or slot < SLOTS:
                vector.write(None if place is None else int(place), None if number is None else int(number), None if payload is None else bytes(payload))
        return (mine, recipe), out

    schema = f"{life} long, {order[0]} long, " + ", ".join(f"{n} long" for n in RECIPE_NUMBERS) + ", topologies array<binary>, dynamic binary"
    return folded(rows, [life], order, lambda: (None, _Recipe()), step, schema, rows=64, end=lambda state: state[1].snapshot(state[0]))
