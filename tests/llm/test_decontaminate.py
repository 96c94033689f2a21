import re

from tessera.llm import decontaminate

from .data import documents, frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def items():
    import random

    rng = random.Random(9)
    docs = documents()
    long = " ".join(docs[45][1].split()[25:45])
    return [(1, long), (2, "Hello, test ONE"), (3, None), (4, "  ... "), (5, sentence(rng, 30)), (11, long.upper()), (6, sentence(rng, 4)), (7, "again"), (2, "same words")]


def brute(text, bench):
    w, hit, found, best = words(text), set(), set(), 0
    for ident, t in bench:
        b = words(t)
        k = min(10, len(b))
        if not k:
            continue
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(ident))
                for j in range(len(b) - k + 1):
                    n = 0
                    while i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                        n += 1
                    best = max(best, n if n >= k else 0)
    return len(w), len(hit), sorted(found), best


def bits(mask):
    return sum(bin(b).count("1") for b in mask)


def test_matches_brute_force_whole_and_in_blocks(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = documents()
    want = sorted((r[0], *brute(r[1], items())) for r in rows)
    for size in (decontaminate.BLOCK_BYTES, 60):
        got = decontaminate.matches(frame(spark, clash=True), bench, block_bytes=size).collect()
        assert sorted((r.doc_id, r.found_words, bits(r.found_mask), r.found_items, r.found_longest) for r in got) == want
    assert max(x[4] for x in want) > 12


def test_clean_drops_only_hits_and_keeps_columns(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = frame(spark, clash=True)
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in documents() if not brute(r[1], items())[1])


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.matches(frame(spark, []), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(frame(spark), none).count() == len(documents())


def test_longest_match_is_that_of_one_item(spark):
    line = [f"w{i}" for i in range(60)]
    text = " ".join(line[:40])
    cases = [
        ([(1, text)], "a b " + " ".join(line[5:30]) + " c", 25),
        ([(1, " ".join(line[1:11])), (2, " ".join(line[2:12]))], " ".join(line[1:12]), 10),  # two items side by side
        ([(1, text)], " ".join(line[3:12]) + " x " + " ".join(line[20:29]), 0),  # nine words are no window
        ([(1, text), (2, " ".join(line))], " ".join([*line[:15], "x", *line[30:55]]), 25),
        ([(1, f"{text} {text}")], f"{text} {text} {text}", 80),
    ]
    for items, doc, want in cases:
        bench = spark.createDataFrame(items, "item_id long, text string")
        docs = spark.createDataFrame([(1, doc), (2, doc + " " + line[59]), (3, None)], "doc_id long, text string").coalesce(1)
        assert sorted((r.doc_id, r.found_longest) for r in decontaminate.matches(docs, bench).collect()) == [(1, want), (2, want), (3, 0)]


def test_suffix_array_is_sorted_by_all_words():
    import numpy as np

    rng = np.random.default_rng(3)
    texts = np.sort(rng.integers(0, 12, 600))
    hashes = rng.integers(0, 3, 600).astype(np.uint64)
    hashes[texts == 7] = hashes[texts == 5][: (texts == 7).sum()].tolist() + [9] * max(0, (texts == 7).sum() - (texts == 5).sum())
    index = decontaminate.SuffixArray(hashes, texts, 700)
    shown = [index.words[p : p + int(np.argmin(index.words[p:]))].tolist() for p in index.order]  # up to the text's end
    assert len(shown) == 600 and shown == sorted(shown)
