"""Personal data: patterns for direct identifiers, and terms that disclose them.

E-mail addresses, IP addresses, payment cards and phone numbers are found by
their form; long runs of mixed letters and digits are held as opaque values,
which may be secrets.  These are the protected entities.  Then the corpus says
which terms reveal them.  A term's disclosure is the share of its occurrences in
the corpus that are near the entity, P(entity | term), and its information is
log2(P(entity | term) / P(entity)); contexts that differ are counted, so copies
of one text are one witness.  It is estimated twice:

* for each single identifier: a term that stands near it in several contexts
  and hardly anywhere else discloses it wherever it stands;
* for each kind: a term that hardly stands anywhere but near that kind (the
  label of a field, say) discloses it in the texts that hold one, and is marked
  next to it.  An opaque value next to a term that discloses such values is a
  secret.

Terms above the upper threshold are removed, those above the lower generalised.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import content_key, order_id, private, stored

KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[TERM]", "gone": ""}
#: Spans of one start come in this order.
ORDER = {k: i for i, k in enumerate(MARKS)}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number of more parts starts at its first digit, so later digits are no starts.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Direct identifiers, by start and then by kind; kinds may overlap each other."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += ((m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split("."))))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += ((m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def identity(text: str, span: Span) -> str:
    """One spelling for all spellings of an identifier."""
    value = text[span[0] : span[1]]
    return f"{span[2]}:{value.lower() if span[2] in ('email', 'ip') else ''.join(_DIGIT.findall(value))}"


def term_of(word: str) -> str:
    """A word without marks at its edges, in lower case; empty if too short to tell anything."""
    term = _EDGES.sub("", word).lower()
    return term if len(term) >= 3 and not term.isdigit() else ""


_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}")


def opaque_spans(text: str, base: list[Span]) -> list[Span]:
    """Runs of at least 20 letters, digits and +/_- with three of both, which no direct identifier touches."""
    out = []
    if _DIGIT.search(text):
        for m in _OPAQUE.finditer(text):
            value = m.group()
            digits = sum(map(value.count, "0123456789"))
            if digits >= 3 and sum(c.isalpha() for c in value) >= 3 and not any(a < m.end() and m.start() < b for a, b, _ in base):
                out.append((m.start(), m.end(), "secret"))
    return out


#: Words around an identifier are looked for within so many code points of it.
WINDOW = 4_096
_MEMO: dict[str, str] = {}


def _term(word: str) -> str:
    """``term_of`` with a bounded memory."""
    term = _MEMO.get(word)
    if term is None:
        if len(_MEMO) >= 200_000:
            _MEMO.clear()
        term = _MEMO[word] = term_of(word)
    return term


def _around(text: str, start: int, end: int, reach: int) -> tuple[list[re.Match], list[re.Match]]:
    """The ``reach`` words before and after a span, from slices that grow up to ``WINDOW``."""
    size = 32 * reach
    while True:
        low = max(0, start - size)
        before = list(_WORD.finditer(text, low, start))
        if len(before) > reach or low == 0 or size >= WINDOW:
            break
        size = min(4 * size, WINDOW)
    size = 32 * reach
    while True:
        high = min(len(text), end + size)
        after = list(_WORD.finditer(text, end, high))
        if len(after) > reach or high == len(text) or size >= WINDOW:
            return before[-reach:], after[:reach]
        size = min(4 * size, WINDOW)


def _near(text: str, spans: list[Span], reach: int) -> Iterator[tuple[str, list[str], int]]:
    """(identity, terms around it, hash of the words around it) of each identifier."""
    for span in spans:
        words = [m.group() for side in _around(text, span[0], span[1], reach) for m in side]
        around = [w for w in words if not base_spans(w) and not opaque_spans(w, [])]
        yield identity(text, span), sorted({t for w in around if (t := term_of(w))}), xxhash.xxh64_intdigest(" ".join(words), 3) - (1 << 63)


def _mentions(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            words = 0
            for text in batch.column("text").to_pylist():
                words += text.count(" ") + 1
                spans = base_spans(text)
                spans = spans + opaque_spans(text, spans)
                for entity, terms, context in _near(text, spans, reach) if spans else ():
                    rows.append((entity, None, context, 1))
                    rows += ((entity, t, context, 1) for t in terms)
            rows.append((None, None, 0, words))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["entity", "term", "context", "n"])

    return run


#: Bits of the table that says which words may be among the terms looked for.
_BITS = 24


def _sieve(terms: DataFrame):
    """A broadcast table of 2^24 flags, of which each term sets one: 2 MB
    whatever the number of terms."""
    place = F.xxhash64("term").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    table = np.zeros(1 << _BITS, bool)
    table[terms.select(place.alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)] = True
    return terms.sparkSession.sparkContext.broadcast(np.packbits(table))


def _sifted(table: np.ndarray, term: str) -> bool:
    place = xxhash.xxh64_intdigest(term, 42) & (1 << _BITS) - 1
    return bool(table[place >> 3] >> (7 - (place & 7)) & 1)


def _occurrences(sieve):
    """How often words that may be among the terms occur, added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, may, count = sieve.value, {}, {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for word, n in Counter(text.split()).items():
                    term = _term(word)
                    known = may.get(term)
                    if known is None:
                        if len(may) >= 200_000:
                            may.clear()
                        known = may[term] = bool(term) and _sifted(table, term)
                    if known:
                        count[term] = count.get(term, 0) + n
            if len(count) >= 200_000:
                yield out()
                count.clear()
        yield out()

    return run


def _words(sieve):
    """(doc, hash, term, start, end) of every word that may be among the terms, for more terms than fit a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sieve.value
        for batch in batches:
            for doc, hash_, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "text")), strict=True):
                rows = [(t, m.start(), m.end()) for m in _WORD.finditer(text) if (t := _term(m.group())) and _sifted(table, t)]
                term, start, end = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), pa.array([hash_] * len(rows), pa.int64()), pa.array(term, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc", "hash", "term", "start", "end"])

    return run


def disclosing_terms(texts: DataFrame, reach: int = 4, support: int = 3, generalise: float = 0.2, remove: float = 0.5, bits: float = 3.0) -> DataFrame:
    """(term, of, kind, disclosure): terms that reveal an identifier; kind 'gone' for
    those to remove, 'term' for those to generalise.  ``of`` is the kind of
    identifier that a term reveals next to it, or null for a term that reveals
    a single one wherever it stands.

    texts: (doc, hash, text).  A term counts as evidence only if it stands
    within ``reach`` words of the entity in ``support`` different contexts,
    so that copies of one text are one witness.  Counts are over all texts.
    """
    spark = texts.sparkSession
    seen = stored(texts.select("text").mapInArrow(_mentions(reach), "entity string, term string, context long, n long").groupBy("entity", "term", "context").agg(F.sum("n").alias("n")), "mentions")
    words = seen.where("entity is null").agg(F.sum("n").alias("n")).first()["n"] or 1
    of = F.substring_index("entity", ":", 1)
    # Each mention is one of its single identifier and one of its kind.
    levels = F.explode(F.array(F.struct(F.col("entity").alias("key"), F.lit(None).cast("string").alias("of")), F.struct(of.alias("key"), of.alias("of"))))
    both = seen.where("entity is not null").select("term", "context", "n", levels.alias("e")).select("term", "context", "n", "e.*")
    entities = both.where("term is null").groupBy("key", "of").agg(F.sum("n").alias("mentions"))
    # Contexts are deduplicated before they are counted, so no kind's contexts meet in one task.
    pairs = both.where("term is not null").groupBy("key", "of", "term", "context").agg(F.sum("n").alias("n")).groupBy("key", "of", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
    pairs = pairs.where(F.col("contexts") >= support)
    mentions = lambda level: entities.where(level).select("key", "mentions")
    of_kinds = pairs.where("of is not null").join(F.broadcast(mentions("of is not null")), "key")  # as many rows as there are kinds
    pairs = stored(of_kinds.unionByName(pairs.where("of is null").join(mentions("of is null"), "key")), "pairs")
    candidates = pairs.select("term").distinct()
    if pairs.isEmpty():
        return spark.createDataFrame([], "term string, of string, kind string, disclosure double")
    total = texts.select("text").mapInArrow(_occurrences(_sieve(candidates)), "term string, n long").groupBy("term").agg(F.sum("n").alias("total"))
    share = F.col("together") / F.greatest("total", "together")
    scored = pairs.join(total, "term").withColumn("disclosure", share).where(F.log2(share * words / F.col("mentions")) >= bits)
    scored = scored.groupBy("term", "of").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise)
    return stored(scored.select("term", "of", F.when(F.col("disclosure") >= remove, "gone").otherwise("term").alias("kind"), "disclosure"), "terms")


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by a mark of its kind, or by nothing."""
    out, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            out += [text[end:start], MARKS[kind]]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_RESULT_SQL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, sanitised string"
_RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("sanitised", pa.string())])

#: What a task knows of terms: those that reveal a kind beside it, as
#: (kind, term) -> mark, and those that reveal wherever they stand, or None
#: where rows bring the spans of these along.
Known = tuple[dict[tuple[str, str], str], dict[str, str] | None]


def _spans(text: str, known: Known, more: list | None, reach: int) -> tuple[list[Span], list[Span]]:
    """(direct identifiers, all spans) of a text."""
    beside, anywhere = known
    base = base_spans(text)
    opaque = opaque_spans(text, base)
    found: set[Span] = set()
    if beside and (base or opaque):
        for start, end, kind in base + opaque:
            near = [(m, beside.get((kind, term_of(m.group())))) for side in _around(text, start, end, reach) for m in side]
            found.update((m.start(), m.end(), mark) for m, mark in near if mark)
            if kind == "secret" and any(mark == "gone" for _, mark in near):
                found.add((start, end, kind))
    if anywhere:
        found.update((m.start(), m.end(), k) for m in _WORD.finditer(text) if (k := anywhere.get(_term(m.group()))))
    found.update((r["start"], r["end"], r["kind"]) for r in more or ())
    return base, sorted({*base, *found}, key=lambda s: (s[0], ORDER[s[2]], s[1])) if found else base


def _marked(known, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            more = batch.column("more").to_pylist() if "more" in batch.schema.names else [None] * batch.num_rows
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), more, strict=True):
                base, spans = _spans(text, known.value, own, reach)
                count = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((doc, *count, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), sanitised(text, spans) if spans else text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT)

    return run


def _sent(terms: DataFrame, max_terms: int):
    """(broadcast of what tasks know, terms to be joined or None).  Terms that
    reveal a kind stand in a few labels; those of single identifiers grow with
    the corpus and are joined where they are more than ``max_terms``."""
    few = terms.where("of is null").limit(max_terms + 1).count() <= max_terms
    sent = terms if few else terms.where("of is not null")
    rows = sent.collect()
    beside = {(r["of"], r["term"]): r["kind"] for r in rows if r["of"] is not None}
    anywhere = {r["term"]: r["kind"] for r in rows if r["of"] is None} if few else None
    return terms.sparkSession.sparkContext.broadcast((beside, anywhere)), None if few else terms.where("of is null").select("term", "kind")


def _joined_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, hash, more): the spans of terms that were not sent."""
    found = texts.select("doc", "hash", "text").mapInArrow(_words(_sieve(terms)), "doc long, hash long, term string, start long, end long").join(terms, "term")
    return found.distinct().groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))


def find_personal_data(documents: DataFrame, max_terms: int = 200_000, reach: int = 4, **thresholds) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256 (of the direct identifiers' spans), spans (all of them as
    kind:start:end in code points, with secrets as kind 'secret' and the
    disclosing terms as kinds 'term' and 'gone') and sanitised (the text with
    the spans replaced).

    Null texts are empty and have no spans.  Rows without a doc_id and rows
    that repeat one are read like others; each repeated row is evidence once
    per different context.  Other columns are not looked at.  Up to
    ``max_terms`` terms of single identifiers are sent to the executors; more
    are joined, to the same result.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), order_id("doc_id").alias("doc"), content_key("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    known, joined = _sent(disclosing_terms(texts.select("doc", "hash", "text"), reach=reach, **thresholds), max_terms)
    rows = texts.select("doc_id", "text") if joined is None else texts.join(_joined_spans(texts, joined), ["doc", "hash"], "left").select("doc_id", "text", "more")
    return rows.mapInArrow(_marked(known, reach), _RESULT_SQL)


def _replaced(known, reach: int, more: str | None, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            extra = batch.column(more).to_pylist() if more else [None] * batch.num_rows
            for text, own in zip(batch.column("text").to_pylist(), extra, strict=True):
                _, spans = _spans(text or "", known.value, own, reach)
                texts.append(sanitised(text, spans) if spans else text)
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c].cast(batch.schema.field(c).type) if c in new else batch.column(c) for c in columns], columns)

    return run


def sanitise(documents: DataFrame, max_terms: int = 200_000, reach: int = 4, **thresholds) -> DataFrame:
    """``documents``, all rows and columns, with the spans in text replaced and
    n_chars, where there is such a column, counted anew.  Null texts stay null."""
    keyed = documents.select(order_id("doc_id").alias("doc"), content_key("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    known, joined = _sent(disclosing_terms(keyed, reach=reach, **thresholds), max_terms)
    if joined is None:
        return documents.mapInArrow(_replaced(known, reach, None, documents.columns), documents.schema)
    doc, hash_, more = private(documents, 3)
    spans = _joined_spans(keyed, joined).withColumnsRenamed({"doc": doc, "hash": hash_, "more": more})
    rows = documents.withColumns({doc: order_id("doc_id"), hash_: content_key("text")}).join(spans, [doc, hash_], "left")
    return rows.mapInArrow(_replaced(known, reach, more, documents.columns), documents.schema)
