import hashlib
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_chars long"


def plain(text):
    """The patterns as stated, each searched over the whole text."""
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(float(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123459.@+- ()ab_%é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["4539 1488 0343 6467", "a@b.c.d@e.f", "+1 (212) 555-0153.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000001.2.3.4", "x" * 5000 + "@" + "9" * 5000 + ".com", "1.1.1." + "0" * 5000, "0" * 5000 + ".1.2.3", "1.1.1." + "9" * 5000])
def test_base_spans_of_cases(text):
    assert pii.base_spans(text) == plain(text)


def corpus():
    rows = [(i, f"{'one two six ten'.split()[i % 4]} word{i} Zorblax wrote to jo.doe@mail.example.com about case{i}, they said{i}", "", 0) for i in range(6)]
    rows += [(10 + i, f"common filler common text number {i} with Zorblaxian things", "", 0) for i in range(30)]
    rows += [(50, "here Zorblax stands alone", "", 0), (51, None, "", 0), (52, "", "", 0), (None, "call +1 (212) 555-0153 now", "", 0), (0, rows[0][1], "", 0)]
    return rows + [(60 + i, "copied secretword near ann@mail.example.com at noon", "", 0) for i in range(9)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_terms_that_disclose(spark, most):
    got = pii.find_personal_data(spark.createDataFrame(corpus(), SCHEMA).repartition(4), max_terms=most).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(corpus())
    assert by[50][0].spans == "gone:5:12" and by[50][0].sanitised == "here  stands alone"
    assert by[51][0].spans == by[52][0].spans == by[12][0].spans == ""
    assert by[None][0].n_phone == 1 and by[None][0].sanitised == "call [PHONE] now"
    # Copies of one text are one witness, so its words disclose nothing.
    assert all(r.spans.startswith("email:") and "," not in r.spans for i in range(60, 69) for r in by[i])
    base = ",".join(f"{k}:{a}:{b}" for a, b, k in plain(corpus()[0][1]))
    assert by[0][0].spans.startswith("gone:")
    assert all(r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.n_email == 1 for r in by[0])


def disclosure(texts, reach=4, support=3, generalise=0.2, remove=0.5, bits=3.0):
    """Terms that disclose, by definition: {(term, kind or None): mark}."""
    mentions, together, total, words = {}, {}, {}, 0
    for text in texts:
        words += text.count(" ") + 1
        for w in text.split():
            total[pii.term_of(w)] = total.get(pii.term_of(w), 0) + 1
        spans = pii.base_spans(text)
        for span in spans + pii.opaque_spans(text, spans):
            near = text[: span[0]].split()[-reach:] + text[span[1] :].split()[:reach]
            for key in ((pii.identity(text, span), None), (span[2], span[2])):
                mentions[key] = mentions.get(key, 0) + 1
                for t in {pii.term_of(w) for w in near if not pii.base_spans(w) and not pii.opaque_spans(w, [])} - {""}:
                    together.setdefault((t, *key), []).append(tuple(near))
    best = {}
    for (t, key, of), contexts in together.items():
        share = len(contexts) / max(total[t], len(contexts))
        if len(set(contexts)) >= support and math.log2(share * words / mentions[key, of]) >= bits:
            best[t, of] = max(best.get((t, of), 0), share)
    return {k: "gone" if d >= remove else "term" for k, d in best.items() if d >= generalise}


def labelled():
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(200)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{some(9)} token = \"{rng.getrandbits(160):040x}\" {some(9)}" for _ in range(12)]
    texts += [f"{some(7)} Mail: u{i}@mail{i}.example.com {some(9)}" for i in range(9)] + [f"{some(5)} mail {some(9)}" for _ in range(20)]
    texts += [f"{some(5)} call us +1 (212) 555-0{100 + i} {some(5)}" for i in range(6)] + [f"{some(30)} us {some(20)}" for _ in range(60)]
    return texts + [f"{some(6)} {rng.getrandbits(160):040x} {some(6)}", f"the token of {some(12)}"]


def test_terms_match_brute_force(spark):
    for texts in (labelled(), [r[1] or "" for r in corpus()]):
        rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, hash long, text string").repartition(3)
        want = disclosure(texts)
        assert {(r.term, r.of): r.kind for r in pii.disclosing_terms(rows).collect()} == want and want
    assert disclosure(labelled())["token", "secret"] == "gone" and disclosure(labelled())["mail", "email"] == "term"


def test_secrets_and_labels(spark):
    texts = labelled()
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert all("secret:" in got[i].spans and "gone:" in got[i].spans and "[SECRET]" in got[i].sanitised and "token" not in got[i].sanitised for i in range(12))
    assert all("term:" in got[i].spans and "[TERM] [EMAIL]" in got[i].sanitised for i in range(12, 21))
    # Without an identifier beside it a label discloses nothing, nor is every opaque value a secret.
    assert all(got[i].spans == "" and got[i].sanitised == texts[i] for i in [*range(21, 41), len(texts) - 2, len(texts) - 1])
    assert all(got[i].n_email == 1 for i in range(12, 21)) and all(pii.base_spans(texts[i]) == plain(texts[i]) for i in range(len(texts)))


def test_very_long_texts_are_read_in_proportion():
    one, two = ((" ".join(f"w{i % 97} u{i}@mail.example.com" for i in range(n)), n) for n in (4_000, 16_000))
    took = []
    for text, n in (one, two):
        began = time.perf_counter()
        spans = pii.base_spans(text)
        assert len(spans) == n and sum(1 for _ in pii._near(text, spans, 4)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
    packed = ",".join(f"u{i}@mail.example.com" for i in range(4_000))
    assert len(list(pii._near(packed, pii.base_spans(packed), 4))) == 4_000


@pytest.mark.parametrize("most", [200_000, 0])
def test_clashing_columns(spark, most):
    docs = spark.createDataFrame([(i, t, 7, 8, "m", 9) for i, t, *_ in corpus()], "doc_id long, text string, _doc int, hash int, more string, _key int")
    out = pii.sanitise(docs, max_terms=most)
    assert out.columns == docs.columns and {tuple(r[2:]) for r in out.collect()} == {(7, 8, "m", 9)} and out.count() == len(corpus())


@pytest.mark.parametrize("most", [200_000, 0])
def test_sanitise_keeps_rows_and_columns(spark, most):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    out = pii.sanitise(docs, max_terms=most)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == len(corpus())
    assert not any("@" in (r.text or "") or "Zorblax " in (r.text or "") for r in got)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_generalised_and_overlapping():
    assert pii.sanitised("a bob b", [(2, 5, "term")]) == "a [TERM] b"
    assert pii.sanitised("0123456789", [(1, 5, "card"), (3, 7, "phone")]) == "0[CARD]789"


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
