"""Parallel scans of a small automaton: chunks become functions of the state they are entered in.

An `Automaton` reads classes of bytes. What a stretch of text does to the state is a function of the states,
and there are few such functions (`functions`, closed under composition), so a stretch is one number, and two
stretches in turn are one look-up in a table. That is associative: `before` takes the composition of all that
stands before each byte in a tree of look-ups, without knowing the state at the start.

A chunk's summary is its function and, for each state that it may be entered in, how often each event
happens in it. `entries` composes the summaries of a text's chunks in Spark, in blocks of `fan` chunks and
blocks of blocks, and hands the state and the counts before each chunk back down the tree. No block is
larger than `fan`, however long the text.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm._common import materialise

#: What a chunk does: the state it ends in and the events in it by the state it begins in, and its size.
SUMMARY = "to array<int>, units array<long>, tags array<long>, chars long, bytes long"


@dataclass
class Automaton:
    """classes: class of each byte; steps[state, class]: the next state; events[name][state, class]: whether it happens there.

    Class 0 holds the bytes of no interest: a run of them does what its first does, and no event happens after
    the first, so runs are read as one letter.
    """

    classes: np.ndarray
    steps: np.ndarray
    events: dict[str, np.ndarray]
    functions: np.ndarray = field(init=False)
    product: np.ndarray = field(init=False)
    letters: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        once = self.steps[:, 0]
        if (once[once] != once).any() or any(e[once, 0].any() for e in self.events.values()):
            raise ValueError("class 0 must do nothing after its first letter")
        known = {tuple(range(len(self.steps))): 0}
        todo = list(known)
        gens = [tuple(c) for c in self.steps.T.tolist()]
        for f in todo:  # grows while it is read
            for g in gens:
                if (h := tuple(g[s] for s in f)) not in known:
                    known[h] = len(known)
                    todo.append(h)
        self.functions = np.array(todo, np.int16)
        self.product = np.array([[known[tuple(g[s] for s in f)] for g in todo] for f in todo], np.int16)
        self.letters = np.array([known[g] for g in gens], np.int16)

    def before(self, f: np.ndarray) -> tuple[np.ndarray, int]:
        """(function of all that stands before each letter, function of all letters)."""
        if len(f) < 2:
            return np.zeros(len(f), np.int16), int(f[0]) if len(f) else 0
        left, right = f[0 : len(f) - 1 : 2], f[1::2]
        outer, total = self.before(self.product[left, right])
        out = np.empty(len(f), np.int16)
        out[0 : 2 * len(outer) : 2], out[1 : 2 * len(outer) : 2] = outer, self.product[outer, left]
        if len(f) % 2:
            out[-1], total = total, int(self.product[total, f[-1]])
        return out, total

    def read(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(places that count, their classes, function before each, function of all) of bytes."""
        kind = self.classes[data]
        told = kind != 0
        told[1:] |= kind[:-1] != 0
        told[:1] = True
        at = np.flatnonzero(told)
        kind = kind[at]
        outer, total = self.before(self.letters[kind])
        return at, kind, outer, total

    def places(self, data: np.ndarray, state: int, *names: str) -> list[np.ndarray]:
        """Where each event happens in bytes that are entered in `state`."""
        at, kind, outer, _ = self.read(data)
        states = self.functions[outer, state]
        return [at[self.events[n][states, kind]] for n in names]

    def summary(self, data: np.ndarray) -> dict:
        """SUMMARY of a chunk, for every state that it may be entered in."""
        _, kind, outer, total = self.read(data)
        met = np.bincount(outer.astype(np.int64) * self.steps.shape[1] + kind, minlength=len(self.functions) * self.steps.shape[1])
        met = met.reshape(len(self.functions), -1)
        count = lambda e: [int(met[e[self.functions[:, s]]].sum()) for s in range(len(self.steps))]
        return {"to": self.functions[total].tolist(), **{n: count(e) for n, e in self.events.items()}, "chars": int(starts(data).sum()), "bytes": len(data)}


def starts(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a code point."""
    return (data & 0xC0) != 0x80


#: A byte that no UTF-8 text has: before each text of a batch, it brings the automaton back to its start.
RESET = 0xFF


@functools.cache
def lines(tags: tuple[str, ...]) -> Automaton:
    """Units `[^\\n]*\\n|[^\\n]+` and tags of three ASCII characters `<X>`.

    States: whether a unit has begun, and how much of a tag has been read (nothing, `<`, `<X`).
    """
    if not all(len(t) == 3 and t.isascii() and (t[0], t[2]) == ("<", ">") for t in tags):
        raise ValueError("tags are <X> with one ASCII character X")
    other, newline, opens, letter, closes, reset = range(6)
    classes = np.zeros(256, np.int8)
    for byte, kind in {"\n": newline, "<": opens, ">": closes, **{t[1]: letter for t in tags}}.items():
        classes[ord(byte)] = kind
    classes[RESET] = reset
    state = lambda begun, tag: 3 * begun + tag
    steps = np.zeros((6, 6), np.int16)
    units, closed = np.zeros((6, 6), bool), np.zeros((6, 6), bool)
    for begun in (0, 1):
        for tag in (0, 1, 2):
            for kind in (other, newline, opens, letter, closes):
                seen = 1 if kind == opens else 2 if kind == letter and tag == 1 else 0
                steps[state(begun, tag), kind] = state(int(kind != newline), seen)
                units[state(begun, tag), kind] = not begun
                closed[state(begun, tag), kind] = tag == 2 and kind == closes
    return Automaton(classes, steps, {"units": units, "tags": closed})


def after(a: Column, b: Column) -> Column:
    """Summary of a chunk `a` and then `b`."""
    both = lambda name: F.transform(F.arrays_zip(a["to"].alias("s"), a[name].alias("n")), lambda x: x["n"] + F.get(b[name], x["s"])).alias(name)
    return F.struct(F.transform(a["to"], lambda s: F.get(b["to"], s)).alias("to"), both("units"), both("tags"), *((a[c] + b[c]).alias(c) for c in ("chars", "bytes")))


def follow(e: Column, f: Column) -> Column:
    """Entry of what follows a chunk `f` that has the entry `e`."""
    return F.struct(F.get(f["to"], e["state"]).alias("state"), *((e[c] + F.get(f[c], e["state"])).alias(c) for c in ("units", "tags")), *((e[c] + f[c]).alias(c) for c in ("chars", "bytes")))


def entries(chunks: DataFrame, key: str, fan: int = 64) -> DataFrame:
    """(key, chunk, entry) of `chunks` (key, chunk from 0, f: SUMMARY): the state that each is entered in and what stands before it."""
    blocks = chunks.groupBy(key, F.floor(F.col("chunk") / fan).alias("block")).agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("held"))
    blocks = materialise(blocks)
    zero = F.lit(0).cast("long")
    first = F.struct(F.lit(0).alias("state"), *(zero.alias(c) for c in ("units", "tags", "chars", "bytes")))
    if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
        entered = blocks.withColumn("outer", first)
    else:
        whole = F.aggregate(F.slice("held", 2, fan), F.col("held")[0]["f"], lambda acc, x: after(acc, x["f"]))
        above = entries(blocks.select(key, F.col("block").alias("chunk"), whole.alias("f")), key, fan)
        entered = blocks.join(above.select(key, F.col("chunk").alias("block"), F.col("entry").alias("outer")), [key, "block"])
    # The entry of each chunk of a block follows those before it: the last one leads on.
    one = lambda chunk, e: F.struct(chunk.alias("chunk"), e.alias("entry"), )
    grown = F.aggregate(
        "held",
        F.struct(F.array().cast("array<struct<chunk:bigint,entry:struct<state:int,units:bigint,tags:bigint,chars:bigint,bytes:bigint>>>").alias("done"), F.col("outer").alias("e")),
        lambda acc, x: F.struct(F.array_append(acc["done"], one(x["chunk"].cast("long"), acc["e"])).alias("done"), follow(acc["e"], x["f"]).alias("e")),
    )
    return entered.select(key, F.inline(grown["done"]))
