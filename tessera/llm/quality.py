"""Quality rules (operator 1): base counts and a perplexity band for each language.

The model is a modified Kneser-Ney n-gram model over characters (order 4 unless told otherwise).  Characters rather
than words, because the distinct n-grams of characters stay few at any corpus size, so that a model of all documents
can be held by every worker; a word model of the same corpus is as large as the corpus and scores its own singletons as
probable.  All n-grams of all whole texts are counted: each worker counts its share in sorted arrays and Spark adds
up.  Discounts, continuation counts and backoff weights are Spark aggregations over the table of distinct n-grams.

Model entries are (language, 64-bit n-gram key, log probability, log backoff).  Workers hold them as arrays sorted by
key and look n-grams up by binary search.  That holds while the model has at most `model_rows` entries; a larger
one is never collected: n-grams of each document are then joined with it in Spark (`score_by_join`).  Counts, and the logarithms that
are added up for a document, are whole numbers (65,536ths of a nat), so both ways, and any layout of the rows, give the same bits.

A document's log perplexity is its negative log probability by letter or digit: by character, lines of symbols would look
fluent, as all but the first of a run cost nothing.  A language's band is the median of its documents, less or more a
multiple of their median absolute deviation, from a histogram of all of them; the median and deviation over all languages
count as PRIOR documents more, so a language of a few documents has a band too, by the same formula.  A document outside its band,
without a letter, or failing the base rules, isn't kept.

Defined results: a null or empty text has no words, fails the base, and has null perplexity; a null language is a
language of its own; repeated rows count and are judged like others; very long texts are counted and scored whole; a
perplexity at the edge of its band is inside; other columns are ignored and pass through `reject`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM_BYTE, WORD_BYTE, Kept, chunks, column, mix, owner, per_text, prefix_hash, runs, span_hash, table, written

ORDER = 4
#: Bits of a character class; n-grams of up to 5 pack into 60 bits, the length above them.
BITS = 12
#: Entries up to which workers hold the whole model (24 bytes each).
MODEL_ROWS = 6_000_000
#: Robust deviations that the band spans below and above the median.
BAND_LOW, BAND_HIGH = 5.0, 6.0
#: Documents that the pooled median and deviation count as, beside a language's own.
PRIOR = 50
STEP = 1000
#: Steps of a nat in which the model's logarithms are kept, and that of a character of no model.
SCALE = 1 << 16
UNKNOWN, NONE = round(np.log(1 << BITS) * SCALE), -(1 << 31)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCORED = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, loglik long, n_letters long"


def repeated(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys within their text: which occur more than once, and which have occurred before."""
    order = np.lexsort((keys, texts))
    k, t = keys[order], texts[order]
    same = np.r_[False, (k[1:] == k[:-1]) & (t[1:] == t[:-1])] if len(k) else np.zeros(0, bool)
    both, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = same
    both[order] = same | np.r_[same[1:], False] if len(k) else same
    return both, later


def base_counts(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a chunk.

    Lines and windows are compared by 64-bit hashes within their text.
    """
    n = len(offsets) - 1
    mask = WORD_BYTE[buf]
    starts, ends = runs(mask, offsets)
    sums, doc = prefix_hash(buf), owner(offsets, starts)
    first = (buf & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(first & mask)]
    symbols = np.r_[0, np.cumsum(SYMBOL[buf])]
    line_start, line_end = runs(buf != 10, offsets)
    words_before = np.r_[0, np.cumsum(mask)]
    full = words_before[line_end] > words_before[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_doc = owner(offsets, line_start)
    dup = repeated(span_hash(sums, line_start, line_end), line_doc)[1]
    h = span_hash(sums, starts, ends)
    hit = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        three = mix(h[:-2][at] * np.uint64(3) + mix(h[1:-1][at] * np.uint64(5) + mix(h[2:][at])))
        at = at[repeated(three, doc[at])[0]]
        for k in range(3):
            hit[at + k] = True
    return [per_text(n, doc), chars[offsets[1:]] - chars[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], per_text(n, line_doc[dup]), per_text(n, doc[hit])]


def symbols_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character class of each code point (1 .. 2**BITS - 1) and the offsets of the texts in them.

    The classes of all code points below 2,048 differ; others share classes by their low bits.
    """
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b0 = buf[at].astype(np.int32)
    wide = np.r_[buf, np.zeros(3, np.uint8)].astype(np.int32)
    b1, b2, b3 = (wide[at + k] & 63 for k in (1, 2, 3))
    cp = np.where(b0 < 128, b0, np.where(b0 < 224, (b0 & 31) << 6 | b1, np.where(b0 < 240, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    cls = np.where(space, 1, np.where(cp < 2048, cp + 1, 2050 + (cp ^ cp >> 11) % 2045)).astype(np.uint64)
    counted = np.r_[0, np.cumsum(lead)]
    return cls, counted[offsets]


def grams(cls: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each character: its characters from the text's start on, at most `order`."""
    pos = np.arange(len(cls)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = cls.copy()
    for k in range(1, order):
        at = np.flatnonzero(pos >= k)
        key[at] |= cls[at - k] << np.uint64(BITS * k)
    return key


def _counted(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for i, j, buf, offsets in chunks(batch.column(0)):
                cls, where = symbols_of(buf, offsets)
                keys, each = grams(cls, where, order), np.repeat(lang[i:j], np.diff(where))
                for one in set(lang[i:j].tolist()):
                    mine = keys[[x is None for x in each] if one is None else each == one] if len(set(lang[i:j].tolist())) > 1 else keys
                    k, c = np.unique(mine, return_counts=True)
                    if one in held:
                        both, counts = np.r_[held[one][0], k], np.r_[held[one][1], c]
                        by = np.argsort(both, kind="stable")
                        both, counts = both[by], counts[by]
                        head = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, int)
                        k, c = both[head], np.add.reduceat(counts, head) if len(head) else counts
                    held[one] = (k, c.astype(np.int64))
                if sum(len(k) for k, _ in held.values()) > 2_000_000:
                    yield from out()
        yield from out()

    return run


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, key, n): all n-grams of all texts; those at a text's start are shorter."""
    return docs.select("text", "lang").mapInArrow(_counted(order), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _length(key: Column) -> Column:
    return F.ceil(F.length(F.bin(key)) / F.lit(float(BITS))).cast("int")


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, key, logp, backoff): the modified Kneser-Ney model of counted n-grams, all orders, logarithms as whole numbers of 1 / SCALE.

    The highest order has raw counts, as n-grams at a text's start have; each lower one counts the distinct characters that precede
    its n-grams.  Each order keeps its three discounts from its own counts of counts.  Probabilities are interpolated.
    """
    mask = lambda k: (1 << BITS * k) - 1
    at = counts.withColumn("length", _length(F.col("key")))
    levels, upper = {}, at.where(F.col("length") == order).select("lang", "key", "n")
    levels[order] = upper
    for k in range(order - 1, 0, -1):
        continued = upper.select("lang", F.col("key").bitwiseAND(F.lit(mask(k))).alias("key"), F.lit(1).cast("long").alias("n"))
        upper = continued.unionByName(at.where(F.col("length") == k).select("lang", "key", "n")).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        levels[k] = upper = written(upper, "level")  # each level is read by several others
    lower, parts = None, []
    for k in range(1, order + 1):
        level = levels[k]
        c = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        stats = level.groupBy("lang").agg(*c)
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        bounded = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(i - 0.1), F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.5 * i)))
        stats = stats.select("lang", *(bounded(i).alias(f"d{i}") for i in (1, 2, 3)))
        level = level.join(stats.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).drop("of")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select("lang", "key", F.shiftright("key", BITS).alias("context"), (F.col("n") - d).alias("rest"), "d1", "d2", "d3", F.col("key").bitwiseAND(F.lit(mask(k - 1))).alias("shorter"), "n")
        # sums of whole numbers, so that no order of rows changes a bit of the result
        kinds = [F.sum(x.cast("long")) * F.min(f"d{i}") for i, x in enumerate((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), 1)]
        context = written(level.groupBy("lang", "context").agg(F.sum("n").alias("total"), (kinds[0] + kinds[1] + kinds[2]).alias("freed")), "contexts")
        known = context.select(F.col("lang").alias("of"), F.col("context").alias("at"), "total", "freed")
        level = level.join(known, F.col("lang").eqNullSafe(F.col("of")) & (F.col("context") == F.col("at"))).drop("of", "at")
        if lower is None:
            level = level.withColumn("q", F.lit(1.0 / (1 << BITS)))
        else:
            low = lower.select(F.col("lang").alias("of"), F.col("key").alias("at"), F.col("p").alias("q"))
            level = level.join(low, F.col("lang").eqNullSafe(F.col("of")) & (F.col("shorter") == F.col("at")), "left").drop("of", "at")
        level = level.withColumn("p", (F.col("rest") + F.col("freed") * F.coalesce("q", F.lit(1.0 / (1 << BITS)))) / F.col("total"))
        level = written(level.select("lang", "key", "p"), "level")
        backoff = context.select("lang", F.col("context").alias("key"), F.log(F.col("freed") / F.col("total")).alias("backoff"))
        parts.append((level, backoff))
        lower = level
    out = None
    for probabilities, backoff in parts:
        one = probabilities.select("lang", "key", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")).unionByName(backoff.select("lang", "key", F.lit(None).cast("double").alias("logp"), "backoff"))
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("lang", "key").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))
    return out.select("lang", "key", *(F.round(F.col(c) * SCALE).cast("long").alias(c) for c in ("logp", "backoff")))


class Arrays:
    """A model's entries of each language in arrays sorted by key."""

    def __init__(self, rows: pa.Table):
        lang, key = rows["lang"].to_pylist(), rows["key"].to_numpy().astype(np.uint64)
        logp, backoff = (rows[c].fill_null(v).to_numpy().astype(np.int32) for c, v in (("logp", NONE), ("backoff", 0)))
        ids = {x: i for i, x in enumerate(dict.fromkeys(lang))}
        which = np.array([ids[x] for x in lang], np.int32)
        self.by = {}
        for one, i in ids.items():
            mine = np.flatnonzero(which == i)
            mine = mine[np.argsort(key[mine])]
            self.by[one] = key[mine], logp[mine], backoff[mine]

    def score(self, lang: str | None, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probability of the last character of each n-gram, in 1 / SCALE."""
        out = np.zeros(len(keys), np.int64)
        if lang not in self.by:
            return out - UNKNOWN
        known, logp, backoff = self.by[lang]
        todo, key = np.arange(len(keys)), keys
        length = np.full(len(keys), order)
        for k in range(order, 1, -1):
            length[(key >> np.uint64(BITS * (k - 1))) == 0] = np.minimum(length[(key >> np.uint64(BITS * (k - 1))) == 0], k - 1)
        while len(todo):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = (known[at] == key) & (logp[at] != NONE)
            out[todo[hit]] += logp[at[hit]]
            todo, key, length = todo[~hit], key[~hit], length[~hit]
            last = length <= 1
            out[todo[last]] += int(backoff[0] if known[0] == 0 else 0) - UNKNOWN  # an unknown character: the empty context, key 0
            todo, key, length = todo[~last], key[~last], length[~last]
            context = key >> np.uint64(BITS)
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            out[todo] += np.where(known[at] == context, backoff[at], 0)
            length = length - 1
            key = key & ((np.uint64(1) << (np.uint64(BITS) * length.astype(np.uint64))) - np.uint64(1))
        return out


def _scored(order: int, arrays, with_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_pylist()
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i, j, buf, offsets in chunks(batch.column(0)):
                cls, where = symbols_of(buf, offsets)
                total, sizes = np.zeros(j - i, np.int64), np.diff(where)
                if arrays is not None:
                    keys, each = grams(cls, where, order), np.repeat(np.arange(j - i), sizes)
                    own = [lang[i + x] for x in range(j - i)]
                    ids = {x: k for k, x in enumerate(dict.fromkeys(own))}
                    which = np.repeat(np.array([ids[x] for x in own], np.int32), sizes)
                    for one, k in ids.items():
                        mine = slice(None) if len(ids) == 1 else np.flatnonzero(which == k)
                        distinct, back = np.unique(keys[mine], return_inverse=True)
                        # whole numbers below 2**53: exact as doubles
                        total += np.bincount(each[mine], arrays.value.score(one, distinct, order)[back], j - i).astype(np.int64)
                letters = np.r_[0, np.cumsum(ALNUM_BYTE[buf] & ((buf & 0xC0) != 0x80))]
                for c, x in zip(cols, [*base_counts(buf, offsets), total, letters[offsets[1:]] - letters[offsets[:-1]]], strict=True):
                    c.append(x)
            got = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            text = [0] * with_text
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(batch.column(k) for k in text), batch.column(1), *(pa.array(x.astype(np.int64)) for x in got)], [*batch.schema.names[2:], *(batch.schema.names[k] for k in text), "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "loglik", "n_letters"])

    return run


def _keyed(order: int):
    """(row, lang, key, n): the distinct n-grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lang = batch.column(2), batch.column(1)
            for i, j, buf, offsets in chunks(batch.column(0)):
                cls, where = symbols_of(buf, offsets)
                keys, each = grams(cls, where, order), np.repeat(np.arange(i, j), np.diff(where))
                by = np.lexsort((keys, each))
                keys, each = keys[by], each[by]
                head = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (each[1:] != each[:-1])]) if len(keys) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([row.take(pa.array(each[head])), lang.take(pa.array(each[head])), pa.array(keys[head].astype(np.int64)), pa.array(np.diff(np.r_[head, len(keys)]))], ["row", "lang", "key", "n"])

    return run


def score_by_join(docs: DataFrame, entries: DataFrame, order: int = ORDER) -> DataFrame:
    """(row, loglik) of docs (text, lang, row) by joins with the model: one join for each order, for a model of any size."""
    todo = docs.select("text", "lang", "row").mapInArrow(_keyed(order), "row long, lang string, key long, n long").withColumns({"length": _length(F.col("key")), "sum": F.lit(0).cast("long")})
    empty = entries.where("key = 0 and backoff is not null").select(F.col("lang").alias("l0"), (F.col("backoff") - UNKNOWN).alias("unknown"))
    todo = todo.join(empty, F.col("lang").eqNullSafe(F.col("l0")), "left").drop("l0")
    done = None
    for _ in range(order):
        m = entries.where("logp is not null").select(F.col("lang").alias("l"), F.col("key").alias("k"), "logp")
        b = entries.where("backoff is not null").select(F.col("lang").alias("l2"), F.col("key").alias("k2"), "backoff")
        got = todo.join(m, F.col("lang").eqNullSafe(F.col("l")) & (F.col("key") == F.col("k")), "left")
        end = got.where("logp is not null or length <= 1").select("row", ((F.col("sum") + F.coalesce("logp", "unknown")) * F.col("n")).alias("x"))
        done = end if done is None else done.unionByName(end)
        rest = got.where("logp is null and length > 1").drop("l", "k", "logp").withColumn("context", F.shiftright("key", BITS))
        todo = rest.join(b, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("context") == F.col("k2")), "left").select("row", "lang", F.col("key").bitwiseAND(F.expr(f"shiftleft(1L, {BITS} * (length - 1)) - 1")).alias("key"), "n", (F.col("length") - 1).alias("length"), (F.col("sum") + F.coalesce("backoff", F.lit(0))).alias("sum"), "unknown")
    return done.groupBy("row").agg(F.sum("x").alias("loglik"))


def scores(docs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS, kept: Kept | None = None) -> DataFrame:
    """doc_id, mark (a hash of text and language), lang, the base counts, n_letters and log_perplexity (null without letters) of each row.

    With `kept` also the text and those columns, under their hidden names.
    """
    entries = written(model(written(counted(docs, order), "ngrams"), order), "model")
    mark = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))).alias("mark")
    rows = docs.select("text", "lang", "doc_id", mark, *(kept.columns if kept else []))
    held = [*rows.schema.fields[2:], *(rows.schema.fields[:1] if kept else [])]
    of = lambda *before: StructType([*before, *held, *StructType.fromDDL(SCORED).fields])
    if entries.count() <= model_rows:
        arrays = docs.sparkSession.sparkContext.broadcast(Arrays(entries.toArrow()))
        out = rows.mapInArrow(_scored(order, arrays, kept is not None), of())
    else:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows").select("text", "lang", "row", *rows.columns[2:])
        out = rows.mapInArrow(_scored(order, None, kept is not None), of(rows.schema["row"])).drop("loglik").join(score_by_join(rows, entries, order), "row", "left").drop("row")
    return out.withColumn("log_perplexity", F.when(F.col("n_letters") > 0, -F.col("loglik") / (F.col("n_letters") * SCALE))).drop("loglik")


def bands(scored: DataFrame, low: float = BAND_LOW, high: float = BAND_HIGH) -> DataFrame:
    """(lang, low, high): the band of log perplexity of each language, from counts by thousandths over all documents.

    Medians and deviations (from the own median) are those of the language's documents and, as PRIOR more, those of all.
    """
    x = scored.where("log_perplexity is not null").select("lang", F.round(F.col("log_perplexity") * STEP).cast("long").alias("v"))
    hist = x.groupBy("lang", "v").agg(F.count(F.lit(1)).alias("c"))

    def middle(h: DataFrame, value: str, *by: str) -> DataFrame:
        """The median of value in each group, with the number of documents."""
        counts = h.groupBy(*by, value).agg(F.sum("c").alias("c"))
        cum = counts.withColumns({"upto": F.sum("c").over(Window.partitionBy(*by).orderBy(value)), "docs": F.sum("c").over(Window.partitionBy(*by))})
        return cum.where(F.col("upto") * 2 >= F.col("docs")).groupBy(*by).agg(F.min(value).alias("m"), F.min("docs").alias("docs"))

    own = written(middle(hist, "v", "lang").select(F.col("lang").alias("of"), "m", "docs"), "medians")
    away = written(hist.join(own, F.col("lang").eqNullSafe(F.col("of"))).select("lang", F.abs(F.col("v") - F.col("m")).alias("away"), "c"), "away")
    spread = middle(away, "away", "lang").select("lang", F.col("m").alias("mad"))
    pooled = middle(hist, "v").select(F.col("m").alias("all_m")).crossJoin(middle(away, "away").select(F.col("m").alias("all_mad")))  # one row each
    both = own.join(spread, F.col("of").eqNullSafe(F.col("lang"))).crossJoin(pooled)
    shrunk = lambda x, y: (F.col(x) * F.col("docs") + F.col(y) * PRIOR) / ((F.col("docs") + PRIOR) * STEP)
    half = lambda k: 1.4826 * k * shrunk("mad", "all_mad")
    return both.select("lang", (shrunk("m", "all_m") - half(low)).alias("low"), (shrunk("m", "all_m") + half(high)).alias("high"))


def judged(docs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS, low: float = BAND_LOW, high: float = BAND_HIGH, kept: Kept | None = None) -> DataFrame:
    """The scores with base_failed and kept."""
    scored = written(scores(docs, order, model_rows, kept), "scores", "zstd" if kept else "snappy")
    # of known size, a row for each language, so that the scored rows (and their texts) needn't be dealt out by language
    band = written(bands(scored, low, high).withColumnRenamed("lang", "band_lang"), "bands")
    x = scored.join(band, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return x.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)


def reject(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the rejected rows, all columns as they were.  These travel with the scores, so no text is shuffled or sorted to meet its verdict."""
    kept = Kept(docs, docs.columns, ("text", "lang", "doc_id"))
    back = dict(zip(kept.names, kept.back, strict=True))
    return judged(docs, kept=kept, **parameters).where("kept").select(*(back.get(c, column(c)) for c in docs.columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


QUERIES = {"op1_quality_rules": op1_quality_rules}
