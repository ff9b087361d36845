"""Phrase collocations: frequent word n-grams found by mergeable Misra-Gries summaries,
counted exactly in a second pass, cut at their weakest place and ranked per language.

Pass 1, by lengths (words; two words; three to ``max_words``). A task cuts texts into pieces
and words on byte arrays, gives every n-gram of a piece a 64-bit hash and adds up equal
ones. Hash ranges are the partitions: per partition the tasks' counts are merged into one
Misra-Gries summary with a capacity of ``SPARE`` * mass / threshold + 1. What it subtracts
in all stays under half the threshold, and an n-gram survives if its count and what was
subtracted reach the threshold: every n-gram with ``min_count`` occurrences does. Hashes
travel as their upper 48 bits. Survivors are marked in a bitmap
of 2^20 to 2^30 bits, which the next length and the second pass use: an n-gram whose
parts are not marked cannot be frequent. A collision or a rare survivor marks too much and
costs time only.

Pass 2 counts the marked n-grams exactly, by their words: a task adds up equal 128-bit
hashes and writes each n-gram out once, and hash partitions add up equal n-grams.

Scale: shuffled are packed pairs of hash and count after adding up in the task, so an
n-gram with a third of all occurrences is a pair a task. A partition's summary holds at
most its capacity and a buffer; the number of partitions follows the bytes of text. The
driver sees bitmaps only, 128 MB at most. A language's candidates are ranked in salted
groups first. Counts, cuts and ranks are joins and groupings of frequent n-grams.

Cases: null text is empty; null language is ``und``, together with rows of that name;
texts without words give nothing; repeated rows count as often as they occur; a text of
any length is cut into slices at piece ends; an empty table gives no rows; other columns
are not read, so names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_WORDS, MIN_COUNT, TOP, INSIDE = 5, 100, 2000, 100
SLICE = 1 << 19  # bytes of text handled at once
ROWS = 256  # documents joined to one buffer
FLUSH = 1_000_000  # n-gram hashes a summary adds up at once
FLUSH_LOCAL = 3_000_000  # n-gram hashes a task adds up before it hands them on
TALLY = 200_000  # distinct n-grams a task of the second pass holds before it hands them on
PACK = 512  # hashes of a row, so that a batch of rows stays small
SPARE = 4  # capacity as a multiple of mass / threshold
PART_MASS = 1 << 25  # n-gram occurrences meant for a hash partition
SALTS = 64  # groups in which a language's candidates are ranked first
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"


# -- words and n-grams of a slice of text ----------------------------------------------

class Hashing:
    """Two hash functions of words; a task makes one, so its tables are neither sent nor
    kept. A function has a random odd number per byte value and the powers of an odd
    base modulo 2^64 and their inverses: a word's hash is a difference of running sums, moved
    to power 0."""

    def __init__(self) -> None:
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def get(self, which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if which not in self.tables or len(self.tables[which][1]) < size:
            size = max(size, SLICE)
            rng = np.random.RandomState(97 + which)
            table = rng.randint(0, 2**63, 256).astype("u8") * np.uint64(2) + np.uint64(1)
            base = int(rng.randint(2**40, 2**60)) * 8 + 5
            up, down = np.full(size, base, "u8"), np.full(size, pow(base, -1, 2**64), "u8")
            up[0] = down[0] = 1
            self.tables[which] = table, np.cumprod(up), np.cumprod(down)
        return self.tables[which]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _kinds() -> np.ndarray:
    kind = np.zeros(256, "u1")
    kind[list(BLANKS)] = 1
    kind[list(BREAKS)] = 2
    return kind


def slices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """``(language, bytes)`` of the texts of a batch (text, lang), A-Z lower-cased: whole
    pieces, about ``SLICE`` bytes each."""
    kind = _kinds()
    for at in range(0, batch.num_rows, ROWS):
        some = batch.slice(at, ROWS)
        for lang in some.column(1).unique().to_pylist():
            texts = some.column(0).filter(pc.equal(some.column(1), lang)).cast(pa.large_binary())
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(texts)], texts), pa.scalar(b"\n", pa.large_binary()))
            whole = np.frombuffer(joined[0].as_buffer(), "u1")
            start = 0
            while start < len(whole):
                end = min(start + SLICE, len(whole))
                while end < len(whole):
                    cuts = np.flatnonzero(kind[whole[start:end]] == 2)
                    if len(cuts):
                        end = start + int(cuts[-1]) + 1
                        break
                    end = min(end + SLICE, len(whole))
                part = whole[start:end].copy()
                part[(part >= 65) & (part <= 90)] += 32
                yield lang, part
                start = end


class Grams:
    """Words of a slice with the hashes of its n-grams; ``which`` names the hash function."""

    def __init__(self, lang: str, text: np.ndarray, hashing: Hashing):
        kind = _kinds()[text]
        edge = np.diff(np.concatenate([[0], (kind == 0).view("i1"), [0]]))
        self.text, self.starts, self.ends = text, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.hashing = hashing
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))

    def __len__(self) -> int:
        return len(self.starts)

    def words(self, which: int = 0) -> np.ndarray:
        table, up, down = self.hashing.get(which, len(self.text))
        run = np.zeros(len(self.text) + 1, "u8")
        np.cumsum(table[self.text] * up[:len(self.text)], out=run[1:])
        return _mixed((run[self.ends] - run[self.starts]) * down[self.starts] + self.seed)

    def inside(self, n: int) -> np.ndarray:
        """Whether n words from each word on lie in one piece."""
        return self.piece[:len(self) - n + 1] == self.piece[n - 1:] if len(self) >= n else np.zeros(0, bool)

    def all_to(self, longest: int, which: int = 0) -> list[np.ndarray]:
        """Hashes of the 1, 2, ... ``longest`` words from each word on (pieces ignored)."""
        w = self.words(which)
        out = [w]
        for n in range(2, longest + 1):
            out.append(_mixed(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + w[n - 1:]) if len(w) >= n else w[:0])
        return out

    def phrases(self, first: np.ndarray, n: int) -> list[bytes]:
        """The n words from each of these words on, one space between them."""
        starts, ends = self.starts[first], self.ends[first + n - 1]
        plain = np.ones(len(first), bool)
        for k in range(n - 1):
            gap = self.ends[first + k]
            plain &= (self.starts[first + k + 1] == gap + 1) & (self.text[gap] == 32)
        whole = self.text.tobytes()
        return [whole[s:e] if p else b" ".join(whole[s:e].split()) for s, e, p in zip(starts.tolist(), ends.tolist(), plain.tolist(), strict=True)]


def marked(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap (2^k bits) has the bit that the top k bits of a hash name."""
    bits = np.frombuffer(bitmap, "u1")
    at = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).astype(bool)


def possible(grams: Grams, hashes: Sequence[np.ndarray], maps: dict[int, bytes]) -> dict[int, np.ndarray]:
    """Per length the positions at which an n-gram may be frequent: in one piece, its
    words, pairs and itself marked as far as there are bitmaps (1, 2, 3 for longer)."""
    out: dict[int, np.ndarray] = {}
    for n, h in enumerate(hashes, 1):
        ok = grams.inside(n)
        if n == 2 and 1 in maps:
            ok = ok & out[1][:-1] & out[1][1:] if len(ok) else ok
        if n > 2 and 2 in maps:
            for k in range(n - 1):
                ok = ok & out[2][k:k + len(ok)]
        if min(n, 3) in maps:
            ok = ok & marked(maps[min(n, 3)], h)
        out[n] = ok
    return out


# -- pass 1: Misra-Gries summaries per hash range ----------------------------------------

def added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with the sums of their counts."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, "i8")
    return h[first], np.add.reduceat(c, first) if len(h) else c


class MisraGries:
    """Mergeable summary of hashes with counts. Its capacity is ``SPARE`` * mass / threshold
    + 1, mass being all counts merged so far; a merge that exceeds it subtracts the largest
    count that does not fit from all counts. ``lost`` is what was subtracted in all: no count
    falls short by more, and it is held under half the threshold (a merge that would exceed
    that, as capacities were smaller before, keeps all its counts and the next has more
    room)."""

    def __init__(self, threshold: int, spare: int = SPARE):
        self.threshold, self.spare = threshold, spare
        self.mass, self.lost, self.capacity = 0, 0, 1
        self.hashes, self.counts = np.zeros(0, "u8"), np.zeros(0, "i8")
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def merge(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes, counts))
        self.n_waiting += len(hashes)
        if self.n_waiting > max(self.capacity, FLUSH):
            self.settle()

    def settle(self) -> None:
        self.mass += sum(int(c.sum()) for _, c in self.waiting)
        h = np.concatenate([self.hashes, *[w[0] for w in self.waiting]])
        c = np.concatenate([self.counts, *[w[1] for w in self.waiting]])
        self.waiting, self.n_waiting = [], 0
        h, c = added(h, c)
        self.capacity = max(self.capacity, self.spare * self.mass // self.threshold + 1)
        if len(h) > self.capacity:
            least = int(np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1])
            if 2 * (self.lost + least) < self.threshold:
                self.lost += least
                h, c = h[c > least], c[c > least] - least
            else:
                self.capacity = 2 * len(h)
        self.hashes, self.counts = h, c

    def reaching(self, count: int) -> np.ndarray:
        """The hashes that may have this count: all that have it, none that lack more than
        what was lost."""
        self.settle()
        return self.hashes[self.counts + self.lost >= count]


def packed(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return h.astype(">u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(raw, "u1").reshape(-1, 6)
    return out.view(">u8").ravel().astype("u8")


def local_counts(texts: DataFrame, lengths: Sequence[int], maps: dict, log_parts: int) -> DataFrame:
    """Packed hashes and counts of the possible n-grams of these lengths, per task and hash
    partition."""
    maps = dict(maps)
    limits = np.arange(1 << log_parts, dtype="u8") << np.uint64(64 - log_parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, hashing = {n: m.value for n, m in maps.items()}, Hashing()

        def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, "u8"), np.zeros(0, "i8"))
            at = np.append(np.searchsorted(h, limits), len(h)).tolist()
            cut = [(p, slice(i, min(i + PACK, at[p + 1]))) for p in range(len(limits)) for i in range(at[p], at[p + 1], PACK)]
            for some in (cut[i:i + 256] for i in range(0, len(cut), 256)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _ in some], pa.int32()), pa.array([packed(h[s]) for _, s in some], pa.binary()),
                    pa.array([c[s].astype("u4").tobytes() for _, s in some], pa.binary())], names=["part", "hashes", "counts"])

        found: list[np.ndarray] = []
        for batch in batches:
            for lang, text in slices(batch):
                grams = Grams(lang, text, hashing)
                hashes = grams.all_to(max(lengths))
                good = possible(grams, hashes, bitmaps)
                found += [hashes[n - 1][good[n]] for n in lengths]
                if sum(map(len, found)) > FLUSH_LOCAL:
                    yield from flush(found)
                    found = []
        yield from flush(found)

    return texts.mapInArrow(run, "part int, hashes binary, counts binary")


def survivors(counts: DataFrame, min_count: int, log_parts: int, log_bits: int) -> bytes:
    """Bitmap of the hashes that a Misra-Gries summary per partition keeps."""
    dealt = counts.repartition("part").sortWithinPartitions("part")
    width = 1 << (log_bits - log_parts)  # bits of a partition's share of the bitmap

    def share(part: int, summary: MisraGries) -> pa.RecordBatch:
        bits = np.zeros(width, "u1")
        bits[(summary.reaching(min_count) >> np.uint64(64 - log_bits)) & np.uint64(width - 1)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                          names=["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None
        for b in batches:
            for p, h, c in zip(*[col.to_pylist() for col in b.columns], strict=True):
                if p != part:
                    if summary is not None:
                        yield share(part, summary)
                    part, summary = p, MisraGries(min_count)
                summary.merge(unpacked(h), np.frombuffer(c, "u4").astype("i8"))
        if summary is not None:
            yield share(part, summary)

    bitmap = bytearray(1 << (log_bits - 3))
    for row in dealt.mapInArrow(run, "part int, bits binary").toLocalIterator():
        bitmap[row.part * (width // 8):(row.part + 1) * (width // 8)] = row.bits
    return bytes(bitmap)


# -- pass 2: exact counts ------------------------------------------------------------------

class Tally:
    """Counts of n-grams of a task by 128-bit hash; the words are written out once each."""

    def __init__(self) -> None:
        self.known = self.second = np.zeros(0, "u8")
        self.at = self.counts = np.zeros(0, "i8")
        self.rows: list[tuple[str, int, str]] = []
        self.hashes: list[np.ndarray] = []  # first hash of each row

    def add(self, lang: str, n: int, grams: Grams, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        """The n-grams that start at the words ``at``."""
        order = np.argsort(h1, kind="stable")
        at, h1, h2 = at[order], h1[order], h2[order]
        first = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]])) if len(h1) else np.zeros(0, "i8")
        sizes = np.diff(np.append(first, len(h1)))
        where = np.searchsorted(self.known, h1[first])
        met = np.zeros(len(first), bool)
        held = where < len(self.known)
        met[held] = self.known[where[held]] == h1[first][held]
        if (h2 != np.repeat(h2[first], sizes)).any() or (self.second[where[met]] != h2[first][met]).any():
            # two n-grams share 64 bits: written out one by one
            self.rows += [(lang, n, p.decode()) for p in grams.phrases(at, n)]
            self.counts = np.append(self.counts, np.ones(len(at), "i8"))
            self.hashes.append(h1)
            return
        self.counts[self.at[where[met]]] += sizes[met]
        new = first[~met]
        place = np.searchsorted(self.known, h1[new])
        self.known, self.second = np.insert(self.known, place, h1[new]), np.insert(self.second, place, h2[new])
        self.at = np.insert(self.at, place, np.arange(len(new)) + len(self.rows))
        self.counts = np.append(self.counts, sizes[~met])
        self.rows += [(lang, n, p.decode()) for p in grams.phrases(at[new], n)]
        self.hashes.append(h1[new])

    def packs(self, log_parts: int) -> Iterator[tuple[int, list[tuple[str, int, str]], list[int]]]:
        """``(hash partition, n-grams, counts)``, ``PACK`` n-grams at most."""
        if self.rows:
            part = np.concatenate(self.hashes) >> np.uint64(64 - log_parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for some in np.split(order, cuts):
                for i in range(0, len(some), PACK):
                    rows = some[i:i + PACK].tolist()
                    yield int(part[rows[0]]), [self.rows[r] for r in rows], self.counts[rows].tolist()


COUNTED = "part int, lang array<string>, words array<int>, phrase array<string>, f array<bigint>"


def exact_counts(texts: DataFrame, maps: dict, max_words: int, min_count: int, log_parts: int) -> DataFrame:
    """``(lang, words, phrase, f)`` of all n-grams with ``min_count`` occurrences; words = 0
    holds the number of word occurrences of the language.

    Marked n-grams go to their hash partition in packs, where equal ones are added up by
    their words; a partition has at most as many as its summary kept, and collisions."""
    maps = dict(maps)

    def pack(part: int, rows: list[tuple[str, int, str]], counts: list[int]) -> pa.RecordBatch:
        lang, words, phrase = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([lang], pa.list_(pa.string())), pa.array([words], pa.list_(pa.int32())),
            pa.array([phrase], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["part", "lang", "words", "phrase", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, hashing = {n: m.value for n, m in maps.items()}, Hashing()
        tally, words = Tally(), {}
        for batch in batches:
            for lang, text in slices(batch):
                grams = Grams(lang, text, hashing)
                words[lang] = words.get(lang, 0) + len(grams)
                hashes, second = grams.all_to(max_words), grams.all_to(max_words, 1)
                good = possible(grams, hashes, bitmaps)
                for n in range(1, max_words + 1):
                    at = np.flatnonzero(good[n])
                    tally.add(lang, n, grams, at, hashes[n - 1][at], second[n - 1][at])
                if len(tally.rows) > TALLY:
                    yield from (pack(*p) for p in tally.packs(log_parts))
                    tally = Tally()
        yield from (pack(*p) for p in tally.packs(log_parts))
        if words:
            yield pack(-1, [(lang, 0, "") for lang in words], list(words.values()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, {}

        def frequent() -> Iterator[pa.RecordBatch]:
            rows = [(*k, f) for k, f in total.items() if f >= min_count or k[1] == 0]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i:i + 10_000], strict=True)], schema=out)

        for b in batches:
            for p, *lists in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != part:
                    yield from frequent()
                    part, total = p, {}
                for lang, words, phrase, f in zip(*lists, strict=True):
                    key = (lang, words, phrase)
                    total[key] = total.get(key, 0) + f
        yield from frequent()

    out = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("phrase", pa.string()), ("f", pa.int64())])
    found = texts.mapInArrow(count, COUNTED).repartition("part").sortWithinPartitions("part")
    return found.mapInArrow(add_up, "lang string, words bigint, phrase string, f bigint").withColumn("words", F.col("words").cast("int"))


def frequent_ngrams(texts: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """All n-grams of 1 to ``max_words`` words with ``min_count`` occurrences in a language
    and, with words = 0, the languages' word counts; a written table."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    words = size // 2 + 1  # a word is a byte and a blank at least
    log_parts = max(4, math.ceil(math.log2(words / PART_MASS + 1)))
    log_bits = max(min(30, math.ceil(math.log2(8 * words / min_count + 1))), 20, log_parts + 3)
    maps: dict = {}
    for lengths in ([1], [2], list(range(3, max_words + 1))):
        lengths = [n for n in lengths if n <= max_words]
        if lengths:
            counted = local_counts(texts, lengths, maps, log_parts)
            maps[lengths[0]] = spark.sparkContext.broadcast(survivors(counted, min_count, log_parts, log_bits))
    return written(exact_counts(texts, maps, max_words, min_count, log_parts))


# -- cuts and ranks ----------------------------------------------------------------------------

def _whole(c: str, digits: int) -> Column:
    return F.col(c).cast(f"decimal({digits},0)")


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
                 min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language.

    Candidates are phrases of 2 to ``max_words`` words with a = f(phrase) >= ``min_count``.
    Of the cuts after the first k words, l and r the counts of the two parts, the one with
    the least floor(1000 * a * n / (l * r)) counts (ties: smallest k). A candidate inside a
    longer one with ``inside`` percent of its count (1 to 100) is dropped. Counts up to
    10^15 are handled exactly."""
    texts = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"),
                        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("__lang"))
    known = frequent_ngrams(texts, max_words, min_count)
    total = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    f = known.filter("words > 0").select("lang", "phrase", "f")
    cand = known.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words")
    cuts = cand.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    parts = (cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
             .join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
             .join(total, "lang"))
    parts = parts.withColumn("num", (F.lit(1000).cast("decimal(4,0)") * _whole("a", 15)).cast("decimal(19,0)") * _whole("n", 18)).withColumn(
        "den", _whole("l", 18) * _whole("r", 18))
    weakest = parts.groupBy("lang", "phrase").agg(
        F.min(F.struct(F.expr("num div den").cast("bigint").alias("score"), "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    # A count falls along inclusion, so one word more is enough to look for a longer one.
    ends = F.array(F.regexp_replace("phrase", "^[^ ]* ", ""), F.regexp_replace("phrase", " [^ ]*$", ""))
    longer = cand.filter("words > 2").select("lang", F.explode(F.array_distinct(ends)).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(inside) * F.col("a")))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
