"""Benchmark decontamination by templates.

Words become templates: numbers, units and names turn into typed placeholders,
so a question asked again with other values keeps its template.  Windows of
template words are matched by an equi-join on their hashes.  Along an
alignment of a document with an item, each value in the item's slots must have
one counterpart, and two names two; else the likeness is chance.  A document is contaminated by an item if
enough of the item's windows are found that way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import U64
from .runtime import NO_ID, content_key, order_id, private, stored
from .shingles import windows, windows_at

# Words for numbers and units in English, German, French and
# Spanish, without those that are rather something else in one of them.
NUMBER_WORDS = frozenset(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen
    null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen dutzend
    zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille millions douzaine
    cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones docena""".split()
)
UNIT_WORDS = frozenset(
    """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years mph kmh percent degree degrees celsius fahrenheit watt watts volt volts dollar dollars cent cents euro euros
    meter metern kilometer kilometern zentimeter gramm kilogramm pfund tonne tonnen sekunde sekunden stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad
    mètre mètres kilomètre kilomètres centimètre centimètres gramme grammes kilogramme kilogrammes seconde secondes heure heures jour jours semaine semaines mois année années pourcent degré degrés
    metro metros kilómetro kilómetros centímetro centímetros gramo gramos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados""".split()
)
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?[%°]?\Z", re.I)
_MEASURE = re.compile(r"[+-]?\d+(?:[.,]\d+)*(mm|cm|m|km|mg|g|kg|ml|l|s|h|min|mph|kmh)\Z", re.I)
_EDGES = re.compile(r"^[^\w$€£%°+-]+|[^\w%°]+$")
_ENDS, _STOPS = frozenset(".!?:;"), frozenset(".!?:;,")
_SENTENCE_END = re.compile(r"[.!?:;][\"')\]]*\Z")


class _Words(dict):
    """Word -> code: a hash in the upper bits, then kind (2 bits), capitalised, ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        # Words of letters, with one mark behind them or none, need no patterns.
        plain = word[:-1] if word[-1:] in _STOPS else word
        if plain.isalpha():
            low = plain.lower()
            kind = NUMBER if low in NUMBER_WORDS else UNIT if low in UNIT_WORDS else LITERAL
            capital = kind == LITERAL and plain[0].isupper() and plain[1:].islower()
            code = xxhash.xxh64_intdigest(low, 1) >> 4 << 4 | kind << 2 | capital << 1 | (word[-1] in _ENDS)
        else:
            code = self.by_patterns(word)
        self[word] = code
        return code

    @staticmethod
    def by_patterns(word: str) -> int:
        core = _EDGES.sub("", word)
        low = core.lower()
        kind = LITERAL
        if _NUMBER.match(core) or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNIT_WORDS:
            kind = UNIT
        elif _MEASURE.match(core):
            kind = NUMBER
        capital = kind == LITERAL and core[:1].isupper() and core[1:].islower()
        body = xxhash.xxh64_intdigest(low, 1) >> 4
        return body << 4 | kind << 2 | capital << 1 | bool(_SENTENCE_END.search(word))


_words = _Words()
_NAME_CODE = U64(xxhash.xxh64_intdigest("name", 1) >> 4 << 4 | NAME << 2)
_KIND_CODES = np.array([0, *(xxhash.xxh64_intdigest(str(k), 1) >> 4 << 4 | k << 2 for k in (NUMBER, UNIT)), int(_NAME_CODE)], U64)


def template(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, kind) of each word; a capitalised word inside a sentence is a name."""
    return _template(_raw(words))


def _raw(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), U64, len(words))


def _template(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = (raw & U64(1)).astype(bool)
    starts = np.concatenate(([True], ends[:-1])) if len(raw) else ends
    name = (raw & U64(2)).astype(bool) & ~starts
    kind = np.where(name, NAME, ((raw >> U64(2)) & U64(3)).astype(np.int64))
    return np.where(kind == LITERAL, raw & ~U64(3), _KIND_CODES[kind]), kind


def template_windows(raw: np.ndarray, code: np.ndarray, kind: np.ndarray, width: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(reading, kinds, start, hash) of all windows.

    A capitalised word that opens a sentence is a literal in reading 1 and a
    name in reading 2; windows without one are in both (3).  By template if at
    least half the words are literal; if in reading 2 fewer are, also by the
    words themselves, without placeholders."""
    if len(code) < width:
        return []
    inside = lambda mask: (total := np.concatenate(([0], np.cumsum(mask))))[width:] - total[:-width]
    opens = (raw & U64(2)).astype(bool) & (kind == LITERAL)
    literal, opening = inside(kind == LITERAL), inside(opens)
    names = np.where(opens, NAME, kind)
    by_code = windows(code, width)
    both = np.flatnonzero((opening == 0) & (2 * literal >= width))
    first = np.flatnonzero((opening > 0) & (2 * literal >= width))
    second = np.flatnonzero((opening > 0) & (2 * (literal - opening) >= width))
    dense = np.flatnonzero(2 * (literal - opening) < width)
    out = [(3, kind, both, by_code[both]), (1, kind, first, by_code[first])]
    if len(second):
        out.append((2, names, second, windows_at(np.where(opens, _NAME_CODE, code), second, width)))
    if len(dense):
        out.append((3, np.zeros_like(kind), dense, windows_at(raw | U64(15), dense, width)))
    return out


def slots(words: list[str], kind: np.ndarray, start: int, width: int) -> list[str]:
    """Kind and value of each placeholder of a window, in order."""
    at = start + np.flatnonzero(kind[start : start + width])
    return [f"{kind[i]}:{_EDGES.sub('', words[i]).lower()}" for i in at]


def pattern(values: list[str]) -> int:
    """Hash of which of the values are equal."""
    first: dict[str, int] = {}
    return xxhash.xxh64_intdigest(np.array([first.setdefault(v, i) for i, v in enumerate(values)], np.int64).tobytes()) >> 1


def _items(width: int):
    """(item, text, likeness, pattern, width, start, window, slots, reading) of each window of each item.

    Items of one likeness and pattern match the same documents: they have the
    same windows in every reading, those by words included, and the same slots
    are equal, words that open a sentence counting as slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.split()
                if words:
                    raw = _raw(words)
                    code, kind = _template(raw)
                    used = min(width, len(words))
                    found = template_windows(raw, code, kind, used)
                    like = xxhash.xxh64_intdigest(b"".join(np.concatenate(([reading, len(start)], start, window.view(np.int64))).astype(np.int64).tobytes() for reading, _, start, window in found)) >> 1
                    names = np.where((raw & U64(2)).astype(bool), NAME, kind)
                    equal, own = pattern(slots(words, names, 0, len(words))), xxhash.xxh64_intdigest(" ".join(words)) >> 1
                    rows += ((item, own, like, equal, used, int(s), int(w.view(np.int64)), slots(words, kinds, int(s), used), reading) for reading, kinds, start, window in found for s, w in zip(start, window, strict=True))
            yield pa.RecordBatch.from_pylist([dict(zip(_ITEMS.names, r, strict=True)) for r in rows], schema=_ITEMS)

    return run


_ITEMS = pa.schema([("item", pa.int64()), ("text", pa.int64()), ("likeness", pa.int64()), ("pattern", pa.int64()), ("width", pa.int32()), ("start", pa.int64()), ("window", pa.int64()), ("slots", pa.list_(pa.string())), ("reading", pa.int32())])
_ITEMS_SQL = "item long, text long, likeness long, pattern long, width int, start long, window long, slots array<string>, reading int"
_HITS = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("at", pa.int64()), ("window", pa.int64()), ("found", pa.list_(pa.string())), ("read", pa.int32())])
_HITS_SQL = "doc long, hash long, at long, window long, found array<string>, read int"


#: Bits of the table that says which windows may be an item's, and of its rows.
_BITS, _ROW_BITS = 27, 15


def _sieve(items: DataFrame) -> np.ndarray:
    """A table of 2^27 flags, of which each window of the items sets one: 16 MB
    whatever the size of the benchmark.  Put together by the executors."""
    place = F.col("window").bitwiseAND(F.lit((1 << _BITS) - 1))
    rows = items.select(F.shiftright(place, _ROW_BITS).alias("row"), place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("bit")).distinct()
    table = np.zeros((1 << _BITS - _ROW_BITS, 1 << _ROW_BITS - 3), np.uint8)
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        table[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def _hits(widths: list[int], sent):
    """Windows of documents that are among those sent: (the windows, sorted,
    and no table), or (None and a table of those that may be)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flags = sent.value
        if known is not None:
            table = np.zeros(1 << 20, bool)
            table[(known & U64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            rows = []
            for doc, hash_, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "text")), strict=True):
                words = text.split()
                raw = _raw(words)
                code, kind = _template(raw)
                for reading, kinds, start, window, width in ((*found, width) for width in widths for found in template_windows(raw, code, kind, width)):
                    if known is not None:
                        maybe = np.flatnonzero(table[(window & U64((1 << 20) - 1)).astype(np.int64)])
                        place = np.minimum(np.searchsorted(known, window[maybe]), len(known) - 1)
                        maybe = maybe[known[place] == window[maybe]]
                    else:
                        place = (window & U64((1 << _BITS) - 1)).astype(np.int64)
                        maybe = np.flatnonzero(flags[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    start, window = start[maybe], window[maybe]
                    rows += ((doc, hash_, int(s), int(w), slots(words, kinds, int(s), width), reading) for s, w in zip(start, window.view(np.int64), strict=True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _HITS.types, strict=True)], schema=_HITS)
        _words.clear()  # workers live on, and their next task needs the memory

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.5, max_windows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, windows, covered, hash, item_ids): one row for each
    contaminated document and class of items, with the item's windows and how
    many were found.

    Capitalised words are names inside a sentence; at its start they are tried
    as names and as words.  Items that match the same documents, since they
    have the same windows and the same slots are equal, are one class: it is
    looked for once and named by its smallest item_id, and ``item_ids`` holds
    all of its ids, sorted.  Different texts of one item_id are looked for each;
    windows and covered are of the one found most of, and ``item_ids`` are those
    of all that were found.  Items shorter
    than ``width`` words have one window, the whole item; windows of which
    less than half the words are literal must hold the same words.  Empty and
    null items and items without an id match nothing.  Null and empty texts contain nothing.  Rows
    that repeat a doc_id are told apart by hash, and equal rows are one; rows
    without a doc_id are reported with a null one.  Up to ``max_windows``
    windows are sent to the executors to look for (8 bytes each); of a larger
    benchmark a table of flags is sent, and windows that pass it are joined, to
    the same result.  Other columns are not looked at.
    """
    spark = documents.sparkSession
    texts = documents.select(order_id("doc_id").alias("doc"), content_key("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    asked = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    items = stored(asked.mapInArrow(_items(width), _ITEMS_SQL), "items")
    classes = items.groupBy("likeness", "pattern").agg(F.min(F.struct("item", "text")).alias("f"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    classes = stored(classes.select("likeness", "pattern", "f.*", "item_ids"), "classes")
    items = items.join(classes.drop("item_ids"), ["likeness", "pattern", "item", "text"]).dropDuplicates(["item", "text", "start", "window", "reading"])
    items = stored(items.select("item", "text", "width", "start", "window", "slots", "reading"), "first_items")
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # at most ``width`` of them
    n = items.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, item_id long, windows long, covered long, hash long, item_ids array<long>")
    few = np.unique(items.select("window").toPandas()["window"].to_numpy(np.int64).view(U64)) if n <= max_windows else None
    sent = spark.sparkContext.broadcast((few, None if few is not None else _sieve(items)))
    hits = stored(texts.mapInArrow(_hits(sorted(widths), sent), _HITS_SQL), "hits")

    pairs = hits.join(items, "window").withColumn("shift", F.col("at") - F.col("start"))
    # Alignments by sentence-initial words as literals (1) and as names (2), each with the windows that have none.
    shared = F.col("reading").bitwiseAND(F.col("read"))
    way = F.filter(F.array(F.when(shared.bitwiseAND(F.lit(1)) > 0, 1), F.when((shared.bitwiseAND(F.lit(2)) > 0) | (shared == 0), 2)), lambda x: x.isNotNull())
    pairs = pairs.withColumn("way", F.explode(way))
    along = ["way", "doc", "hash", "item", "text", "shift"]
    values = F.explode_outer(F.arrays_zip("slots", "found"))
    slot = pairs.select(*along, "start", values.alias("v")).select(*along, "start", F.col("v.slots").alias("a"), F.col("v.found").alias("b"))
    pair, is_name = F.struct("a", "b"), F.col("a").startswith(f"{NAME}:")
    chains = slot.groupBy(along).agg(
        F.collect_set("start").alias("starts"), F.countDistinct("a").alias("n_a"), F.countDistinct(F.when(F.col("a").isNotNull(), pair)).alias("n_ab"), F.countDistinct(F.when(is_name, F.col("b"))).alias("names"), F.countDistinct(F.when(is_name, pair)).alias("named")
    )
    # Each value has one counterpart; two numbers may get the same one, two names may not.
    good = chains.where((F.col("n_ab") == F.col("n_a")) & (F.col("names") == F.col("named")))
    covered = good.select("doc", "hash", "item", "text", F.explode("starts").alias("start")).groupBy("doc", "hash", "item", "text").agg(F.countDistinct("start").alias("covered"))
    sizes = items.groupBy("item", "text").agg(F.count_distinct("start").alias("windows"))
    found = covered.join(sizes, ["item", "text"]).where(F.col("covered") / F.col("windows") >= share)
    # Of several texts of an item, the one found most of; the classes of all.
    likest = F.max_by(F.struct("windows", "covered"), F.struct(F.col("covered") / F.col("windows"), F.col("covered")))
    found = found.join(classes.select("item", "text", "item_ids"), ["item", "text"])
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    found = found.groupBy("doc", "hash", "item").agg(likest.alias("n"), ids.alias("item_ids")).select("doc", "hash", "item", "n.*", "item_ids")
    return found.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), F.col("item").alias("item_id"), "windows", "covered", "hash", "item_ids")


def without_leaks(documents: DataFrame, benchmark: DataFrame, **given) -> DataFrame:
    """``documents``, all columns, without the contaminated rows."""
    doc, hash_ = private(documents, 2)
    leaks = stored(find_leaks(documents, benchmark, **given).select(order_id("doc_id").alias(doc), F.col("hash").alias(hash_)).distinct(), "leaks")
    keys = documents.withColumns({doc: order_id("doc_id"), hash_: content_key("text")})
    return keys.join(leaks, [doc, hash_], "left_anti").select(*documents.columns)
