"""Packing of tokenised documents into sequences of bounded length.

Only the counts of pieces by length matter for packing, and there are at most
``capacity`` lengths.  So the search runs on the driver over that histogram,
whatever the number of documents: bins with one filling are one group with a
multiplicity.  Best fit by falling length gives the start; then local search
moves documents between underfull bins, exchanges one for one or two for one,
each time raising the sum of squared fills, until bins are empty, no bin can
be saved (the token total is the bound) or no exchange helps.

Each piece finds its place from its rank among the pieces of its length, which
the tasks number themselves and a prefix sum over tasks makes global.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored


@lru_cache(maxsize=2)
def encoder(tokenizer: str):
    """A function from a list of texts to their ids.

    Byte-level BPE files are run by tiktoken from their vocabulary, which gives
    the ids of the tokenizers library at several times its speed; any other
    file is run by tokenizers itself.  Added tokens that stand in a text get
    their own ids, as the tokenizers library gives them.
    """
    import json

    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        model = json.load(file)
    if _plain_byte_level(model):
        import tiktoken

        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        vocabulary = model["model"]["vocab"]
        single = {bytes([alphabet[c]]): i for c, i in vocabulary.items() if c in alphabet}
        ranks = {bytes(alphabet[c] for c in word): i for word, i in vocabulary.items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        if len(single) == 256:
            run = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            return lambda texts: [run.encode(t, allowed_special="all") if any(s in t for s in special) else run.encode_ordinary(t) for t in texts]
    whole = Tokenizer.from_file(tokenizer)
    return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def _plain_byte_level(model: dict) -> bool:
    """Whether merges in the order of ids, after the usual split, are all that the file does."""
    before = model.get("pre_tokenizer") or {}
    inner = model.get("model", {})
    if model.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or inner.get("type", "BPE") != "BPE":
        return False
    if any(t.get(flag) for t in model.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    if inner.get("ignore_merges") or inner.get("dropout") or inner.get("continuing_subword_prefix") or inner.get("end_of_word_suffix"):
        return False
    vocabulary = inner["vocab"]
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in inner["merges"]]
    return None not in made and all(a < b for a, b in zip(made, made[1:], strict=False))


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return out | {chr(256 + i): b for i, b in enumerate(hidden)}


class Group:
    """``bins`` bins that hold the same documents: a count for each length."""

    __slots__ = ("items", "fill", "bins")

    def __init__(self, items: Counter, bins: int):
        self.items, self.bins = items, bins
        self.fill = sum(length * n for length, n in items.items())


def best_fit(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Longest first, each into the fullest bin that has room.  Adds at most
    three groups for a length."""
    groups: list[Group] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for group in sorted((g for g in groups if capacity - g.fill >= length), key=lambda g: -g.fill):
            if not left:
                break
            each = (capacity - group.fill) // length
            full = min(group.bins, left // each)
            rest = min(left - full * each, each) if full < group.bins else 0
            groups.remove(group)
            for n, bins in ((each, full), (rest, 1 if rest else 0), (0, group.bins - full - (1 if rest else 0))):
                if bins:
                    groups.append(Group(group.items + Counter({length: n}) if n else group.items, bins))
            left -= full * each + rest
        each = capacity // length
        if left // each:
            groups.append(Group(Counter({length: each}), left // each))
        if left % each:
            groups.append(Group(Counter({length: left % each}), 1))
    return groups


def _gain(receiver: Group, donor: Group, room: int) -> tuple[int, Counter, Counter] | None:
    """The exchange that fills the receiver most: (tokens gained, what the donor
    gives, what it gets back).  Gains are positive and at most ``room``."""
    best = None

    def offer(gain: int, give: tuple[int, ...], back: tuple[int, ...]):
        nonlocal best
        if 0 < gain <= room and (best is None or gain > best[0]):
            best = (gain, Counter(give), Counter(back))

    ours, theirs = sorted(receiver.items), sorted(donor.items)
    for b in theirs:
        offer(b, (b,), ())
        for a in ours:
            offer(b - a, (b,), (a,))
        for i, a in enumerate(ours):
            for a2 in ours[i if receiver.items[a] > 1 else i + 1 :]:
                offer(b - a - a2, (b,), (a, a2))
    for i, b in enumerate(theirs):
        for b2 in theirs[i if donor.items[b] > 1 else i + 1 :]:
            for a in ours:
                offer(b + b2 - a, (b, b2), (a,))
    return best


def local_search(groups: list[Group], capacity: int) -> list[Group]:
    """Exchanges between underfull bins, each raising the sum of squared fills.

    The emptiest bins give to the fullest that an exchange can fill up.  A step
    treats as many pairs of equal bins as there are at once and adds at most
    two groups.  The sum rises with every step and is bounded, so the search
    ends; it ends when no bin can be saved or no exchange helps.
    """
    total = sum(g.fill * g.bins for g in groups)
    least = -(-total // capacity)
    by_items: dict[frozenset, Group] = {}

    def add(items: Counter, bins: int):
        if bins and items:
            key = frozenset(items.items())
            if key in by_items:
                by_items[key].bins += bins
            else:
                by_items[key] = Group(items, bins)

    for g in groups:
        add(g.items, g.bins)
    stuck: set[frozenset] = set()
    while sum(g.bins for g in by_items.values()) > least:
        open_ = sorted((g for g in by_items.values() if g.fill < capacity), key=lambda g: g.fill)
        donor = next((g for g in open_ if frozenset(g.items.items()) not in stuck), None)
        if donor is None:
            break
        found = None
        for receiver in reversed(open_):
            if receiver is donor and donor.bins < 2 or receiver.fill < donor.fill:
                continue
            found = _gain(receiver, donor, capacity - receiver.fill)
            if found:
                break
        if not found:
            stuck.add(frozenset(donor.items.items()))
            continue
        _, give, back = found
        pairs = donor.bins // 2 if receiver is donor else min(donor.bins, receiver.bins)
        taken = +(receiver.items - back + give), +(donor.items - give + back)
        for g in {id(receiver): receiver, id(donor): donor}.values():
            g.bins -= 2 * pairs if receiver is donor else pairs
            if not g.bins:
                del by_items[frozenset(g.items.items())]
        for items in taken:
            add(items, pairs)
        stuck.clear()
    return list(by_items.values())


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    return local_search(best_fit(histogram, capacity), capacity)


def layout(groups: list[Group]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rising rank: first rank, first sequence, documents of
    this length in each bin, and where the first of them starts.

    Bounded by the groups (bins of one content are one group, so there are as
    many as there are fillings in use) and by the lengths in a bin; not by the
    number of documents.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for group in groups:
        at = 0
        for length, n in sorted(group.items.items(), reverse=True):
            out.setdefault(length, []).append((used[length], sequence, n, at))
            used[length] += n * group.bins
            at += length * n
        sequence += group.bins
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in out.items()}


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenise(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        nth = [0] * (capacity + 1)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                few = batch.slice(low, 256)
                rows = []
                for doc, ids in zip(few.column("doc_id").to_pylist(), encode(few.column("text").to_pylist()), strict=True):
                    data = np.array([*ids, end_id], "<u4")
                    for piece, (start, length) in enumerate(cut(len(data), capacity)):
                        rows.append((doc, piece, start, length, zlib.crc32(data[start : start + length].tobytes()), part, nth[length]))
                        nth[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return run


def _place(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                first, begin, each, at = by_length[int(value)]
                row = np.searchsorted(first, rank[mine], "right") - 1
                inside = rank[mine] - first[row]
                sequence[mine] = begin[row] + inside // each[row]
                offset[mine] = at[row] + inside % each[row] * value
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text and ``end_id``; one longer than
    ``capacity`` is cut into full pieces, of which the first may be shorter.
    Null texts are empty and make a piece of the end id alone.  Every row of
    ``documents`` is packed: rows that repeat a doc_id, or have none, give
    pieces of their own under that doc_id.  Other columns are not looked at.
    ``tokenizer`` is a file that every executor can read.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stored(texts.mapInArrow(_tokenise(tokenizer, end_id, capacity), _PIECES_SQL), "pieces")
    counts = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(layout(plan(histogram, capacity)))
    # There are up to ``capacity`` counts a task, so they are dealt and not sent to all.
    ranked = pieces.join(counts.select("part", "length", "base").hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
