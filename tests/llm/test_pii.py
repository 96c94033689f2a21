import re

import pyarrow as pa
import pytest

from tessera.llm import pii
from tessera.llm.common import strings

from .data import SCHEMA, documents, frame

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
HARD = [
    "a@b.c@d.e f..@x.y @a.b a.b@c.d_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 1 4111-1111-1111-1111", "+1 555 555 5555+44 20 1234 5678", "+1..........2 +12", "é4111111111111111é é+1(555)5550199é",
    "12 34 56", "x@y.z-", "%@a.b", "4111  1111 1111 1111 1111", "1.1.1.1 - 2", "a" * 3000 + "@b.c", "1" * 3000 + ".1.1.1", "+" * 50 + "1 2 3 4 5 6 7 8 9 0 1",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_patterns_match_brute_force(spark):
    rows = documents() + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(HARD)]
    got = pii.spans(frame(spark, rows, clash=True), ["doc_id"]).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.base_spans]) for r in got) == sorted((r[0], brute(r[1])) for r in rows)
    for r in got:
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.all_spans}


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_the_field_adds_what_patterns_miss_and_no_more(model):
    texts = {"call (206) 555-1234 or 206-555-1234 now": {b"(206) 555-1234", b"206-555-1234"}, "card 4111.1111.1111.1111 used": {b"4111.1111.1111.1111"}, "on 2024-01-02 at 12:30 in version 1.2.3, chapter 4, page 123": set(), "number 2123465659789240 of 10": set(), "id 12345678 and 99 more": set()}
    buf, offsets = strings(pa.array(list(texts)))
    _, added = pii.found(buf, offsets, model)
    for (text, want), spans in zip(texts.items(), added, strict=True):
        assert {text.encode()[a:b] for a, _, b in spans} == want


#: Texts of other words and forms than the labelled table's.
HELD_OUT = """
contact/O sue.###@web.example.edu/B-email or/O (r##@site.net)/B-email soon/O
the/O gateway/O 1##.#.##.2##,/B-ip answers/O
charged/O to/O 5###/B-card ####/I-card ####/I-card ####/I-card ./O
dial/O (2##)/B-phone 555-####/I-phone tonight/O
fax/O 3##.555.####/B-phone only/O
or/O +49/B-phone 30/I-phone ####/I-phone ####/I-phone please/O
set/O token:/O "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"/B-secret then/O
the/O secret/O =/O ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~/B-secret works/O
use/O api_key="^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^#^"/B-secret once/O
new/O password:/O ^^^^^^#^^/B-secret today/O
saw/O Mr./O Peter/B-name Hansen/I-name there/O
thanks/O to/O Dr./O Wu,/B-name again/O
von/O Herr/O Lukas/B-name Braun/I-name ./O
moved/O to/O ##/B-address Elm/I-address Street/I-address in/O
office/O at/O ###/B-address Lake/I-address Road,/I-address ask/O
revision/O ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~/O merged/O
we/O had/O ##/O cases/O in/O 20##/O
a/O loss/O of/O #.#/O percent/O
by/O #:##/O on/O 0#/0#/20##/O they/O
lot/O ################/O shipped/O
release/O ##.#.#/O is/O out/O
after/O ##/O Some/O went/O home/O
"""


def test_precision_and_recall_on_held_out_texts(model):
    texts = pii.labelled(HELD_OUT, 20, 99)
    buf, offsets = strings(pa.array([" ".join(w) for w, _ in texts]))
    base, added = pii.found(buf, offsets, model)
    right = wrong = missed = new = 0
    for (words, tags), b, a in zip(texts, base, added, strict=True):
        want, at = [], 0
        for w, t in zip(words, tags, strict=True):
            if t[0] == "B":
                want.append([at, t[2:], at + len(w)])
            elif t[0] == "I":
                want[-1][2] = at + len(w)
            at += len(w) + 1
        got = [(x, pii.KINDS[k], y) for x, k, y in [*b, *a]]
        meets = lambda p, q: p[1] == q[1] and p[0] < q[2] and q[0] < p[2]
        hit = [w for w in want if any(meets(w, g) for g in got)]
        right, missed = right + len(hit), missed + len(want) - len(hit)
        wrong += sum(not any(meets(w, g) for w in want) for g in got)
        new += sum(any(meets(w, (x, pii.KINDS[k], y)) for w in want) for x, k, y in a)
    print(f"held out: recall {right / (right + missed):.3f}, precision {right / (right + wrong):.3f}, {new} of {right} by the field alone")
    assert right >= 0.9 * (right + missed) and wrong <= 0.1 * right and new >= 0.5 * right


def test_secrets_names_and_addresses(spark):
    text = 'ask Dr. Jane Smith for token = "11acdfb36bb72224148e6160f674b4be45601bff" at 12 Main Street now'
    rows = [(1, text, "en", "s", 1), (2, "The And Of. In 12 days Ends", "en", "s", 1), (3, "é " * 9000 + text, "en", "s", 1)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.all_spans] for r in pii.spans(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    shown = [(k, text[a:b]) for k, a, b in got[1]]
    assert shown == [("name", "Jane Smith"), ("secret", "11acdfb36bb72224148e6160f674b4be45601bff"), ("address", "12 Main Street")]
    assert got[2] == [] and got[3] == [(k, a + 18000, b + 18000) for k, a, b in got[1]]


def test_mask_replaces_spans_and_keeps_columns(spark):
    docs = frame(spark, clash=True)
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert brute(r.text) == []
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert pii.mask(frame(spark, [])).count() == 0
