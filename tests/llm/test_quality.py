import random
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

from .data import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts_match_brute_force(spark):
    got = quality.judged(frame(spark, clash=True)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
    rows = documents()
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        assert base(text) in by[doc_id]
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_probabilities_after_a_context_sum_to_one(spark):
    entries = quality.model(quality.counted(frame(spark)))
    arrays = quality.Arrays(entries.toArrow())
    known = arrays.by["en"][0]
    contexts = [int(k) for k in known[known < (1 << 36)][1::150]][:10]
    for c in contexts:
        keys = np.array([c << quality.BITS | w for w in range(1, 1 << quality.BITS)], np.uint64)
        assert abs(np.exp(arrays.score("en", keys, quality.ORDER) / quality.SCALE).sum() - 1) < 1e-3


def test_a_model_too_large_to_hold_gives_the_same_scores(spark):
    docs = frame(spark)
    held = {(r.doc_id, r.mark): r.log_perplexity for r in quality.scores(docs).collect()}
    joined = {(r.doc_id, r.mark): r.log_perplexity for r in quality.scores(docs, model_rows=0).collect()}
    assert held == joined  # to the last bit
    assert held == {(r.doc_id, r.mark): r.log_perplexity for r in quality.scores(docs.repartition(5).sortWithinPartitions("text")).collect()}


def kneser_ney(texts, order):
    """Plain modified Kneser-Ney over characters: text -> log probability."""
    counts = [None, *({} for _ in range(order))]
    for text in texts:
        for i in range(len(text)):
            gram = text[max(0, i - order + 1) : i + 1]
            counts[len(gram)][gram] = counts[len(gram)].get(gram, 0) + 1
    for k in range(order - 1, 0, -1):  # a lower order counts what precedes, and those at a text's start
        for gram in counts[k + 1]:
            counts[k][gram[1:]] = counts[k].get(gram[1:], 0) + 1
    discount = [None]
    for k in range(1, order + 1):
        n = [sum(v == i for v in counts[k].values()) for i in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        of = [0.5 * i if not (n[i] and n[i + 1]) else i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
        discount.append([max(0.05, min(i - 0.1, d)) for i, d in enumerate(of, 1)])
    total, freed = {}, {}
    for k in range(1, order + 1):
        for gram, v in counts[k].items():
            context = (k, gram[:-1])
            total[context] = total.get(context, 0) + v
            freed[context] = freed.get(context, 0) + discount[k][min(v, 3) - 1]

    def p(gram):
        if not gram:
            return 1 / (1 << quality.BITS)
        k, context = len(gram), (len(gram), gram[:-1])
        if context not in total:
            return p(gram[1:])
        v = counts[k].get(gram, 0)
        return (v - (discount[k][min(v, 3) - 1] if v else 0) + freed[context] * p(gram[1:])) / total[context]

    return lambda text: sum(math.log(p(text[max(0, i - order + 1) : i + 1])) for i in range(len(text)))


def test_scores_and_verdicts_match_a_plain_model(spark):
    rows = [r for r in documents(3, 25) if r[2]]
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]", " ", t or "")
    plain = {lang: kneser_ney([clean(r[1]) for r in rows if r[2] == lang], 3) for lang in {r[2] for r in rows}}
    got = {(r.doc_id, r.lang): r.log_perplexity for r in quality.scores(frame(spark, rows), order=3).collect()}
    for doc_id, text, lang, *_ in rows:
        letters = sum(c.isalnum() if ord(c) < 128 else 1 for c in text or "")
        want = -plain[lang](clean(text)) / letters if letters else None
        assert got[doc_id, lang] == (None if want is None else pytest.approx(want, abs=2e-4)), doc_id


def test_bands_are_the_medians_shrunk_to_all_languages(spark):
    rng = random.Random(2)
    rows = [(lang, round(rng.gauss(2 + i, 0.1), 4)) for i, (lang, n) in enumerate((("a", 400), ("b", 21), (None, 2), ("c", 1))) for _ in range(n)]
    got = {r.lang: (r.low, r.high) for r in quality.bands(spark.createDataFrame([*rows, ("a", None)], "lang string, log_perplexity double"), 4, 5).collect()}
    median = lambda v: sorted(v)[(len(v) - 1) // 2]
    by = {lang: [round(1000 * v) for one, v in rows if one == lang] for lang, _ in rows}
    mid = {lang: median(v) for lang, v in by.items()}
    away = {lang: [abs(x - mid[lang]) for x in v] for lang, v in by.items()}
    m, s = median([x for v in by.values() for x in v]), median([x for v in away.values() for x in v])
    for lang, v in by.items():
        n, k = len(v), quality.PRIOR
        center, dev = ((n * mid[lang] + k * m) / (n + k) / 1000, 1.4826 * (n * median(away[lang]) + k * s) / (n + k) / 1000)
        assert got[lang] == (pytest.approx(center - 4 * dev), pytest.approx(center + 5 * dev))


def test_bands_reject_what_reads_unlike_the_language(spark):
    rows = [(i, t[1], "en", "s", 1) for i, t in enumerate(documents(3, 120)[:120]) if len((t[1] or "").split()) >= 50]
    junk = [(1000, " ".join(f"zq{i}##" for i in range(80)), "en", "s", 1), (1001, "# " * 100, "en", "s", 1)]
    rng = random.Random(1)
    fluent = [w + v for w in ("belando", "tastodo") for v in ("", "belando", "tastodo")]  # more predictable than any text
    junk.append((1002, " ".join(rng.choice(fluent) for _ in range(90)), "en", "s", 1))
    scored = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows + junk, SCHEMA)).collect()}
    assert not any(scored[i].kept for i in (1000, 1001, 1002))
    assert scored[1000].log_perplexity > scored[1000].high and scored[1002].log_perplexity < scored[1002].low
    assert sum(scored[r[0]].kept for r in rows) >= 0.95 * len(rows)


def test_reject_keeps_columns_and_an_empty_table_stays_empty(spark):
    docs = frame(spark, clash=True)
    out = quality.reject(docs)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in quality.judged(docs).where("kept").collect())
    assert sorted(r.doc_id for r in out.collect()) == kept
    assert quality.reject(frame(spark, [])).count() == 0
    assert quality.judged(docs.where(F.lit(False))).count() == 0


def test_reject_neither_shuffles_nor_sorts_texts(spark):
    docs = frame(spark, clash=True)
    out = quality.reject(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    want = sorted((tuple(r) for r in docs.collect() if r.doc_id in kept), key=repr)
    assert want and sorted(map(tuple, out.collect()), key=repr) == want
    assert sorted(map(tuple, quality.reject(docs, model_rows=0).collect()), key=repr) == want
