"""Personal data (operator 6): fixed patterns, and a linear-chain CRF over word shapes that adds what they miss.

Patterns find emails, IP addresses, cards (Luhn) and phones.  The CRF is trained on a small labelled table (the file
`LABELLED`, expanded by a rule) and decodes all runs of words of a batch by Viterbi in numpy.  It finds what the patterns
miss of these kinds, and secrets (keys, tokens, passwords), names after a cue such as a title, and street addresses.  Its lattice
admits an entity only on words with a digit or `@`, and on capitalised ones after a cue or after an admitted word; so chains
part at all other words, exactly, and only runs of admitted ones are decoded.  Spans of the CRF that meet no span of a
pattern are added; those of patterns always stay.

Everything is found in bytes; offsets are code points, ends exclusive.  Defined results: a null or empty text has no
spans; very long texts and words are read whole; spans that start together are in the order of KINDS; an empty table gives an
empty result; repeated rows are treated alike; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, Kept, chunks, column, prefix_hash, runs, span_hash, table
from .crf import Crf

QUOTED = re.compile(rb"[\"']([^\"']++)[\"']")
#: Those of the patterns first; the others are the model's alone.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name", "address")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The patterns of the contract.  Possessive, so that no text makes them quadratic; a match may start at the head of a run only, as the leftmost does.
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

#: The labelled table, a line for each text: words with their tags after the last slash; B- begins a span.  In it # stands for a
#: digit, ~ for a hexadecimal digit and ^ for a letter or digit drawn by a rule.
LABELLED = Path(__file__).with_name("pii_labelled.txt")
#: Words (lower case, without the mark after them) that a name may follow.
CUES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "mlle", "monsieur", "madame", "sr", "sra", "don", "name")
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
BUCKETS, COPIES = 1 << 14, 30


def shape(word: str) -> str:
    """Digits as 9, capitals as A and other letters as a, runs of letters written once and of digits up to 4; other characters as they are."""
    out, last, n = [], "", 0
    for c in word:
        s = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        n = n + 1 if s == last and s in "9aA" else 1
        if n == 1 or (s == "9" and n <= 4):
            out.append(s)
        last = s
    return "".join(out)


def mixture(word: str) -> str:
    """What a long token is made of: its size by powers of two, quarters of digits and capitals, and whether all is hexadecimal."""
    core = "".join(c for c in word if c.isalnum())
    n = max(len(core), 1)
    digits, capitals = sum(c.isdigit() for c in core) * 4 // n, sum(c.isupper() for c in core) * 4 // n
    return f"{n.bit_length()}.{digits}.{capitals}.{set(core.lower()) <= set('0123456789abcdef')}"


def _features(words: list[bytes], before: bytes) -> np.ndarray:
    """Ids of the features of a run of words after the word before."""
    texts = [w.decode("utf-8", "replace") for w in words]
    shapes = [shape(w) for w in texts]
    numbers = [bytes(b for b in w if 48 <= b <= 57) for w in words]
    valid = [_valid(numbers, i) for i in range(len(words))]
    cue = before.decode("utf-8", "replace").lower().strip(".,:;\"'")
    rows = []
    for i, (w, s) in enumerate(zip(texts, shapes, strict=True)):
        digits = len(numbers[i])
        core = s.strip(".,;:!?<>()[]\"'")
        prev = shapes[i - 1] if i else "^" + cue
        mixed = mixture(w)
        bare = w.lower().strip(".,;:!?<>()[]\"'")
        names = (f"s{s}", f"c{core}", f"d{digits}", f"p{prev}|{core}", f"n{shapes[i + 1] if i + 1 < len(words) else '$'}|{core}", f"@{w.count('@')}.{min(w.count('.'), 4)}-{min(w.count('-'), 4)}", f"h{s[:2]}", f"l{len(w).bit_length()}|{digits == len(core)}", f"x{prev}", f"v{valid[i]}", f"v{valid[i]}|{core}", f"m{mixed}", f"m{mixed}|{prev}", f"q{'=' in w}{':' in w}|{mixed[0]}", f"w{bare}" if not digits else f"t{texts[i - 1].lower() if i else cue}|{mixed[0]}")
        rows.append([1 + zlib.crc32(x.encode()) % (BUCKETS - 1) for x in names])
    return np.array(rows, np.int64)


def _valid(numbers: list[bytes], i: int) -> str:
    """Whether the digits of a word, or of the run of digits around a short one, pass Luhn as a card; - if they can't be one."""
    if 14 <= len(numbers[i]) <= 19:
        return "y" if _luhn(numbers[i]) else "n"
    a = b = i
    while a and 3 <= len(numbers[a - 1]) <= 6:
        a -= 1
    while b + 1 < len(numbers) and 3 <= len(numbers[b + 1]) <= 6:
        b += 1
    joined = b"".join(numbers[a : b + 1])
    return "-" if not 14 <= len(joined) <= 19 else "y" if _luhn(joined) else "n"


def _cue(word: str) -> bool:
    return (word[:-1] if word[-1:] in (".", ":") else word).lower() in CUES


def opened(words: list[str]) -> list[bool]:
    """Which words the lattice admits an entity on: those with a digit or @, and capitalised ones after a cue or after such a word."""
    out: list[bool] = []
    for i, w in enumerate(words):
        out.append(any(c in "0123456789@" for c in w) or (w[:1].isascii() and w[:1].isupper() and i > 0 and (out[-1] or _cue(words[i - 1])) and not _cue(w)))
    return out


def labelled(lines: str, copies: int = COPIES, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Words and tags of each line of a labelled table, `copies` times with other characters drawn."""
    rng, out = np.random.default_rng(seed), []
    drawn = {"#": "0123456789", "~": "0123456789abcdef", "^": "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"}
    for line in lines.strip().split("\n"):
        pairs = [x.rsplit("/", 1) for x in line.split(" ")]
        for _ in range(copies):
            words = ["".join(drawn[c][rng.integers(0, len(drawn[c]))] if c in drawn else c for c in w) for w, _ in pairs]
            tags = [t for _, t in pairs]
            _numbered(words, tags)
            out.append((words, tags))
    return out


def trained(table: list[tuple[list[str], list[str]]] | None = None) -> Crf:
    """The model of a labelled table (words and tags of each text; unless given, that of LABELLED)."""
    chains = []
    for words, tags in table if table is not None else labelled(LABELLED.read_text("utf-8")):
        admitted, run = [*opened(words), False], []
        for i, yes in enumerate(admitted):
            if yes:
                run.append(i)
            elif run:
                x = _features([words[j].encode() for j in run], words[run[0] - 1].encode() if run[0] else b"")
                chains.append((x, np.array([TAGS.index(tags[j]) for j in run])))
                run = []
    model = Crf(BUCKETS, len(TAGS)).train(chains, rounds=60)
    for i, a in enumerate(TAGS):  # an I- follows only its own kind
        for j, b in enumerate(TAGS):
            if b[0] == "I" and (a == "O" or a[2:] != b[2:]):
                model.steps[i, j] = -1e4
        if a[0] == "I":
            model.starts[i] = -1e4
    return model


def _numbered(words: list[str], tags: list[str]) -> None:
    """Give cards of the table a last digit that passes Luhn, and other numbers as long one that does not."""
    i = 0
    while i < len(words):
        j = i + 1
        if tags[i] == "B-card":
            while j < len(words) and tags[j] == "I-card":
                j += 1
        digits = "".join(c for w in words[i:j] for c in w if "0" <= c <= "9")
        if 14 <= len(digits) <= 19 and tags[i] in ("B-card", "O") and words[j - 1][-1:].isdigit():
            body = words[j - 1][:-1]
            words[j - 1] = next(f"{body}{d}" for d in range(10) if _luhn(f"{digits[:-1]}{d}".encode()) == (tags[i] != "O"))
        i = j


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, b in enumerate(reversed(digits)):
        d = b - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at each @, the whole run of local characters before it, not into the match before."""
    at, end = raw.find(b"@"), 0
    while at >= 0:
        start = at
        while start > end and raw[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = raw.find(b"@", max(at + 1, end))


def phones(raw: bytes) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(raw):
        if 10 <= sum(48 <= b <= 57 for b in m[0]) <= 15:
            yield m.span()


def numbers(raw: bytes) -> Iterator[tuple[int, int, int]]:
    for m in IP.finditer(raw):
        if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m[0].split(b".")):
            yield 1, *m.span()
    for m in CARD.finditer(raw):
        digits = m[0].replace(b" ", b"").replace(b"-", b"")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield 2, *m.span()


def found(buf: np.ndarray, offsets: np.ndarray, model: Crf) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Of each text of a chunk, the spans (start, kind, end) in bytes of the patterns and those the model adds."""
    n = len(offsets) - 1
    base: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    added: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    mask = WORD_BYTE[buf]
    starts, ends = runs(mask, offsets)
    marked = np.r_[0, np.cumsum(((buf >= 48) & (buf <= 57)) | (buf == 64))]
    can = marked[ends] > marked[starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    if len(starts):
        # capitalised words after a cue or after a word that is admitted
        low = LOWER[buf]
        last = low[ends - 1]
        cue = np.isin(span_hash(prefix_hash(low), starts, ends - ((last == 46) | (last == 58))), CUE_HASHES)
        capital = (buf[starts] >= 65) & (buf[starts] <= 90) & ~cue & np.r_[False, doc[1:] == doc[:-1]]
        while (more := capital & ~can & np.r_[False, (can | cue)[:-1]]).any():
            can |= more
    idx = np.flatnonzero(can)
    raws: dict[int, bytes] = {}

    def raw(d: int) -> bytes:
        if d not in raws:
            raws[d] = buf[offsets[d] : offsets[d + 1]].tobytes()
        return raws[d]

    ats, pluses = np.unique(np.searchsorted(offsets, np.flatnonzero(buf == 64), "right") - 1), np.unique(np.searchsorted(offsets, np.flatnonzero(buf == 43), "right") - 1)
    for d in ats.tolist():
        base[d] += [(a, 0, b) for a, b in emails(raw(d))]
    for d in pluses.tolist():
        base[d] += [(a, 3, b) for a, b in phones(raw(d))]
    if not len(idx):
        return base, added
    cut = np.flatnonzero(np.r_[True, (np.diff(idx) > 1) | (doc[idx[1:]] != doc[idx[:-1]])])
    tail = np.r_[cut[1:], len(idx)]
    features, sizes, where = [], [], []
    for a, b in zip(idx[cut].tolist(), idx[tail - 1].tolist(), strict=True):
        d = int(doc[a])
        shift = int(offsets[d])
        lo, hi = int(starts[a]) - shift, int(ends[b]) - shift
        text = raw(d)
        base[d] += [(lo + x, k, lo + y) for k, x, y in numbers(text[lo:hi])]
        spans = [(int(starts[i]) - shift, int(ends[i]) - shift) for i in range(a, b + 1)]
        before = text[int(starts[a - 1]) - shift : int(ends[a - 1]) - shift] if a and doc[a - 1] == d else b""
        features.append(_features([text[x:y] for x, y in spans], before))
        sizes.append(len(spans))
        where.append((d, spans))
    tags = model.viterbi(model.emissions(np.concatenate(features)), np.array(sizes))
    at = 0
    for size, (d, spans) in zip(sizes, where, strict=True):
        own, at = tags[at : at + size].tolist(), at + size
        i = 0
        while i < size:
            if not own[i]:
                i += 1
                continue
            kind, j = (own[i] - 1) // 2, i + 1
            while j < size and own[j] and TAGS[own[j]][0] == "I" and (own[j] - 1) // 2 == kind:
                j += 1
            a, b = _trimmed(raw(d), spans[i][0], spans[j - 1][1], KINDS[kind] == "secret")
            if a < b and all(b <= x or y <= a for x, _, y in base[d]):
                added[d].append((a, kind, b))
            i = j
    return base, added


def _trimmed(text: bytes, a: int, b: int, quoted: bool) -> tuple[int, int]:
    """Without quotes, brackets and marks around it; a quoted secret ends at its quote."""
    if quoted and (m := QUOTED.search(text, a, b)):
        return m.span(1)
    while a < b and text[a] in b"<>[]{}\"',;:":
        a += 1
    while a < b and text[b - 1] in b"<>[]{}\"',;:.!?":
        b -= 1
    return a, b


def _hashed(words: tuple[str, ...]) -> np.ndarray:
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    return np.array([span_hash(prefix_hash(r), np.zeros(1, np.int64), np.full(1, len(r)))[0] for r in raw], np.uint64)


CUE_HASHES = _hashed(CUES)


def _scanned(weights, with_text: bool):
    held: list[Crf] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(weights.value)
        for batch in batches:
            base_out, all_out, texts = [], [], []
            for i, j, buf, offsets in chunks(batch.column(0)):
                base, added = found(buf, offsets, held[0])
                points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
                for d in range(j - i):
                    every = sorted([*base[d], *added[d]])
                    start = int(offsets[d])
                    shown = lambda s: [{"kind": KINDS[k], "start": int(points[start + a] - points[start]), "end": int(points[start + b] - points[start])} for a, k, b in s]  # noqa: B023, E731
                    base_out.append(shown(sorted(base[d])))
                    all_out.append(shown(every))
                    if with_text:
                        texts.append(_masked(buf[start : offsets[d + 1]].tobytes(), every) if every else None)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            out, names = [*batch.columns[1:], pa.array(base_out, kind), pa.array(all_out, kind)], [*batch.schema.names[1:], "base_spans", "all_spans"]
            if with_text:
                out, names = [batch.column(0), *out, pa.array(texts, pa.string())], ["text", *names, "masked"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _masked(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]".encode()]
        end = max(end, b)
    return (b"".join(out) + text[end:]).decode("utf-8", "replace")


def spans(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """docs' columns `keep` with base_spans and all_spans (kind, start, end) by start, and text and masked if asked for."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    kept = Kept(docs, keep, ("text", "base_spans", "all_spans", "masked"))
    span = "array<struct<kind: string, start: long, end: long>>"
    schema = f"{'text string, ' * with_text}{kept.kinds}base_spans {span}, all_spans {span}{', masked string' * with_text}"
    out = docs.select("text", *kept.columns).mapInArrow(_scanned(weights, with_text), schema)
    return out.select(*["text"] * with_text, *kept.back, "base_spans", "all_spans", *["masked"] * with_text)


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets; n_chars, if there, follows the text."""
    kept = Kept(docs, docs.columns, ("text",))
    out = spans(docs.select("text", *kept.columns), kept.hidden, with_text=True)
    out = out.select(F.coalesce("masked", "text").alias("text"), F.length("masked").alias("__size"), *kept.back)
    if "n_chars" in kept.names:
        out = out.withColumn("n_chars", F.coalesce(F.col("__size").cast(dict(docs.dtypes)["n_chars"]), "n_chars"))
    return out.select(*map(column, docs.columns))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(table(spark, sf_dir, "documents"), ["doc_id"])
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, BASE_KINDS), F.sha2(shown("base_spans"), 256).alias("base_sha256"), shown("all_spans").alias("spans"))


QUERIES = {"op6_personal_data": op6_personal_data}
