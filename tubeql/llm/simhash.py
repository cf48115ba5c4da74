"""SimHash near-dedup by the generalised pigeonhole.

1. Each document gets a fingerprint of its word shingles, of 64 bits or of several such words. Equal fingerprints are
   one class.
2. In each word, bits that go together over all classes are grouped into parts. If thresholds t_i with
   sum(t_i + 1) = T + 1 are given to the parts, two fingerprints at T differing bits or fewer differ in at most t_i
   bits of some part i. The thresholds, unequal as a rule, and the number of parts are those of least estimated cost
   (signatures and candidate pairs), found by dynamic programming. Candidates are counted by a Markov chain over a
   part's bits, whose joint frequencies come from every class, so parts of correlated bits cost what they do.
   Where T is too far for this promise (find by `recall`), the same programme takes the thresholds of least cost
   whose parts find a pair at the wanted similarity with at least that probability.
3. Each class emits, for every part, the values within half of t_i bits of its own: two that differ in t_i bits meet.
   Classes that meet are verified on all bits, a wave of a breadth-first search against those not yet reached at a
   time. Crowds are linked by a spanning forest, never by all pairs. A key of more than BLOCK classes is dealt to many
   tasks: what is near its leader is linked to that; what isn't meets all others, block by block.
4. Connected components of the links; the least doc_id of a component names it.

Where a similarity is asked for, classes are the different sets of shingles, and the components by fingerprints are
only families in which to look (module families): links are the pairs of a family whose sets have the similarity, and
they are found exactly, whatever the family's size. Fingerprints decide nothing but who is compared with whom.

Defined results
* null or empty text, or one of white space only: fingerprint zero, linked like any other.
* fewer words than a shingle: the whole sequence is the one shingle.
* rows that repeat are documents of their own with the same fingerprint; null doc_ids take part, but don't name a
  component unless it has no other (then component_id is null).
* very long texts are hashed whole; an empty table gives an empty result; other columns are not looked at, and may
  have any names.
* sets of shingles are told apart by 128-bit hashes of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import acos, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, checkpoint, longs, numbered, row_key, sized, skew_join
from .components import components
from .families import similar_pairs
from .wordvec import blocks, gram_hashes, mix, runs_inside, word_hashes, word_places

BITS = 64
SEED = 42
#: Cost of testing a candidate pair, in costs of a shuffled signature.
PAIR_COST = 0.01
#: The most signatures that a class may emit for one part.
MOST_SIGNATURES = 2_000
#: Runs of classes up to this size are compared directly.
DIRECT = 8
#: Classes near one class beyond which a group is linked by a spanning forest instead of all near pairs.
CROWD = 32
#: Classes of one key that a task takes at most, twice over.
BLOCK = 2_048
#: Fingerprints that are tested against all others at once.
WAVE = 64
PARTS = range(2, 9)
#: Large keys up to this number are sent to all tasks.
MAX_BROADCAST = 10_000
#: Sets of shingles that may share half of their hash.
MOST_SHARED = 10_000
#: Steps of the dynamic programme in which the chance of a miss is counted, as parts of its logarithm.
GRAIN = 100


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words (bytes.split and bytes.lower know ASCII only, as wanted)."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    return np.array([digest(line[a:z], SEED) for a, z in zip(starts, ends[words - 1 :])], dtype=np.uint64)


#: For each byte value, its bits, least first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes (run i is first[i]:first[i + 1]) the 64 bits that are set in over half of it.

    A word holds eight counters of a byte; runs are summed in pieces of 255, then the pieces' counters.
    """
    sizes = np.diff(first)
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    pieces = -(-sizes[some] // 255)
    run = np.cumsum(pieces) - pieces
    starts = np.repeat(first[some], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(run, pieces))
    lanes = np.uint64(0x0101010101010101)
    bits = np.zeros((len(some), 8, 8), dtype=bool)  # [run, octet, bit in it]
    for bit in range(8):
        counters = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        bits[:, :, bit] = 2 * np.add.reduceat(counters.astype(np.int64), run, axis=0) > sizes[some, None]
    out[some] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    return out


def wide_fingerprints(column: pa.Array, words: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text `width` 64-bit words, all from hashes that come from the shingle's one by mixing, and two more
    that name its set of shingles: sums over the set of two other hashes."""
    out, names = np.zeros((len(column), width), dtype=np.uint64), np.zeros((len(column), 2), dtype=np.uint64)
    for at, octets, offsets in blocks(column):
        starts, ends, first = word_places(octets, offsets)
        h = word_hashes(octets, starts, ends)
        n_words = np.diff(first)
        grams = gram_hashes(h, words)
        inside = runs_inside(first, len(h), words)
        owner = np.repeat(np.arange(len(n_words)), n_words)
        kept, whose = grams[inside], owner[: len(grams)][inside]
        short = np.flatnonzero((n_words > 0) & (n_words < words))
        if len(short):
            lone = np.array([gram_hashes(h[first[k] : first[k + 1]], int(n_words[k]))[0] for k in short], dtype=np.uint64)
            order = np.argsort(np.concatenate([whose, short]), kind="stable")
            kept, whose = np.concatenate([kept, lone])[order], np.concatenate([whose, short])[order]
        cuts = np.searchsorted(whose, np.arange(len(n_words) + 1))
        derived = lambda k: mix(kept + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))  # noqa: B023, E731
        for k in range(width):
            out[at : at + len(n_words), k] = majority(derived(k), cuts)
        order = np.lexsort((kept, whose))
        new = np.append(True, (kept[order][1:] != kept[order][:-1]) | (whose[order][1:] != whose[order][:-1]))[: len(kept)]
        some = np.flatnonzero(np.diff(cuts))
        for k in range(2):
            if len(some):
                names[at + some, k] = np.add.reduceat(np.where(new, derived(width + k)[order], np.uint64(0)), cuts[some])
    return out, names


def rows_of(column: pa.Array) -> np.ndarray:
    """An array<long> column, all of one length, as a matrix of unsigned words."""
    flat = longs(column.flatten()).view(np.uint64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lists_of(prints: np.ndarray) -> pa.Array:
    ends = np.arange(len(prints) + 1, dtype=np.int32) * prints.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(prints).view(np.int64).ravel()))


def documents_of(docs: DataFrame) -> DataFrame:
    k1, k2 = row_key()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, k1, k2, id, fp): the document's key, its class and its fingerprint, the majority of its shingles' XXH64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(shingle_hashes(t, words)) for t in as_bytes(b.column(3))], dtype=np.uint64).reshape(-1, 1)
            yield batch(["doc_id", "k1", "k2", "fp"], *b.columns[:3], lists_of(prints))

    found = documents_of(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, fp array<long>")
    return found.select("doc_id", "k1", "k2", F.col("fp")[0].alias("id"), "fp")


def set_prints(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """As fingerprints, of `bits` bits; a class is a set of shingles. Written."""
    width = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, names = wide_fingerprints(b.column(3), words, width)
            yield batch(["doc_id", "k1", "k2", "h1", "h2", "fp"], *b.columns[:3], names[:, 0].view(np.int64), names[:, 1].view(np.int64), lists_of(prints))

    found = checkpoint(documents_of(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, h1 long, h2 long, fp array<long>"))
    # A set is named by the first half of its hash, unless two sets share that: at 4 * 10**10 of them some 40 pairs do.
    shared = found.groupBy("h1").agg(F.min("h2").alias("a"), F.max("h2").alias("z")).where("a <> z").select("h1").limit(MOST_SHARED + 1).collect()
    if len(shared) > MOST_SHARED:
        raise ValueError("hashes of sets collide more often than chance allows")
    name = F.when(F.col("h1").isin([r["h1"] for r in shared]), F.xxhash64("h1", "h2")).otherwise(F.col("h1")) if shared else F.col("h1")
    return found.select("doc_id", "k1", "k2", name.alias("id"), "fp")


def bit_matrix(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(classes: DataFrame, bits: int = BITS) -> tuple[int, np.ndarray]:
    """The number of classes, and for each word and each two of its bits how many classes set both."""
    width = bits // 64
    cells = width * 64 * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, 64, 64)), 0
        for b in batches:
            prints = rows_of(b.column(0))
            for at in range(0, len(prints), 1 << 16):
                for k in range(width):
                    x = bit_matrix(prints[at : at + (1 << 16), k]).astype(np.float32)
                    total[k] += x.T @ x
            n += len(prints)
        if n:
            yield batch(["cell", "n"], np.arange(cells + 1, dtype=np.int32), np.append(total.ravel(), n).astype(np.int64))

    sums = classes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # one row a cell
    flat = np.zeros(cells + 1)
    flat[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return int(flat[-1]), flat[:-1].reshape(width, 64, 64)


def correlated_order(n: int, both: np.ndarray) -> list[int]:
    """The bits of a word, each followed by the one left that goes with it most."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    order, left = [0], set(range(1, 64))
    while left:
        order.append(max(left, key=lambda b: (round(strength[order[-1], b], 9), -b)))
        left.remove(order[-1])
    return order


def within(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """For k up to most: the chance that two classes differ in at most k of the bits.

    Whether a bit differs depends on whether the one before does, as far as all classes' joint frequencies say.
    """
    share = both / max(n, 1)
    p = np.diag(share)
    differ = 2 * p * (1 - p)
    counts = np.zeros((2, most + 2))  # [the last bit differs, number so far]
    counts[0, 0], counts[1, 1] = 1 - differ[bits[0]], differ[bits[0]]
    for a, b in zip(bits, bits[1:]):
        both_differ = np.clip(2 * (share[a, b] * (1 - p[a] - p[b] + share[a, b]) + (p[a] - share[a, b]) * (p[b] - share[a, b])), 0, min(differ[a], differ[b]))
        after = both_differ / differ[a] if differ[a] > 1e-12 else differ[b]
        alone = (differ[b] - both_differ) / (1 - differ[a]) if differ[a] < 1 - 1e-12 else differ[b]
        step = np.zeros_like(counts)
        step[0] = counts[0] * (1 - alone) + counts[1] * (1 - after)
        step[1, 1:] = counts[0, :-1] * alone + counts[1, :-1] * after
        counts = step
    return np.cumsum(counts.sum(0))[: most + 1]


def apart(similarity: float) -> float:
    """The chance that a bit differs between two documents whose shingle sets have this Jaccard similarity."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def at_most(n: int, chance: float) -> np.ndarray:
    """For k = 0 ... n: the chance that at most k of n bits differ."""
    return np.cumsum([comb(n, k) * chance**k * (1 - chance) ** (n - k) for k in range(n + 1)])


def limit_for(bits: int, similarity: float, recall: float) -> int:
    """The least number of differing bits that pairs of this similarity stay within, with probability recall."""
    return int(np.searchsorted(at_most(bits, apart(similarity)), recall))


@dataclass(frozen=True)
class Plan:
    """The (word, bits) of each part, its threshold (-1: not used), and the estimated cost in signatures."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float
    words: tuple[int, ...]


def radius(threshold: int) -> int:
    """How far from its own a class's values are emitted."""
    return (threshold + 1) // 2


def costs(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """By threshold, from -1 (not used) on: signatures of n classes and the candidates they give."""
    top = min(most, len(bits))
    pair = within(n, both, bits, 2 * radius(top))
    row = [0.0]
    for t in range(top + 1):
        sent = sum(comb(len(bits), k) for k in range(radius(t) + 1))
        row.append(n * sent + PAIR_COST * n * n / 2 * pair[2 * radius(t)] if sent <= MOST_SIGNATURES else np.inf)
    return row


def cheapest(rows: list[list[tuple[int, float]]], goal: int) -> tuple[float, tuple[int, ...]]:
    """One entry (gain, cost) of each row, so that gains reach the goal, at least cost: the cost and the entries taken."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in rows:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (cost, chosen) in best.items():
            for k, (gain, c) in enumerate(row):
                at = min(goal, have + gain)
                if cost + c < step.get(at, (np.inf,))[0]:
                    step[at] = (cost + c, (*chosen, k))
        best = step
    return best.get(goal, (np.inf, ()))


def allocate(n: int, both: np.ndarray, parts: list[list[int]], limit: int) -> Plan:
    """The thresholds of least cost for these parts of a word that promise every pair within limit."""
    rows = [[(k, c) for k, c in enumerate(costs(n, both, bits, limit))] for bits in parts]
    cost, chosen = cheapest(rows, limit + 1)
    return Plan(tuple(map(tuple, parts)), tuple(k - 1 for k in chosen), cost, (0,) * len(parts))


def allocate_for(n: int, both: np.ndarray, parts: list[tuple[int, list[int]]], chance: float, recall: float) -> Plan:
    """The thresholds of least cost that find a pair whose bits differ with this chance, with probability recall."""
    rows = []
    for word, bits in parts:
        found = at_most(len(bits), chance)
        gains = [0] + [int(-log(max(1 - found[2 * radius(t)], 1e-9)) * GRAIN) for t in range(0, 5, 2)]
        paid = costs(n, both[word], bits, 4)
        rows.append(list(zip(gains, [paid[0], paid[1], paid[3], paid[5]])))
    cost, chosen = cheapest(rows, int(-log(1 - recall) * GRAIN) + 1)
    return Plan(tuple(tuple(bits) for _, bits in parts), tuple((-1, 0, 2, 4)[k] for k in chosen), cost, tuple(w for w, _ in parts))


def cut(order: list[int], m: int, wide: int = 0) -> list[list[int]]:
    """The bits in m parts of about equal width, the first of them wider."""
    rest = len(order) - wide
    widths = [rest // m + (i < rest % m) for i in range(m)]
    widths[0] += wide
    cuts = [0, *accumulate(widths)]
    return [order[a:z] for a, z in zip(cuts, cuts[1:])]


def make_plan(n: int, both: np.ndarray, limit: int, chance: float | None = None, recall: float = 0.95) -> Plan:
    """The cheapest plan over numbers of parts a word; without a chance, one that promises every pair within limit."""
    both = both.reshape(-1, 64, 64)
    orders = [correlated_order(n, x) for x in both]
    if chance is None:
        if len(both) != 1:
            raise ValueError("the promise for every pair is made for fingerprints of 64 bits")
        plans = [allocate(n, both[0], cut(orders[0], m, wide), limit) for m in PARTS for wide in (0, 4, 8, 12)]
    else:
        plans = [allocate_for(n, both, [(k, bits) for k, order in enumerate(orders) for bits in cut(order, m)], chance, recall) for m in range(2, 11)]
    plan = min(plans, key=lambda x: x.cost)
    if not np.isfinite(plan.cost):
        raise ValueError(f"no thresholds for {limit} differing bits with {MOST_SIGNATURES} signatures a part or fewer")
    return plan


def gather(prints: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The value of a part: its bits, packed."""
    out = np.zeros(len(prints), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def signatures(classes: DataFrame, plan: Plan) -> DataFrame:
    """(key, id, fp): for each part the values around its own; the part's number is the key's last 8 bits."""
    balls = []
    for bits, t in zip(plan.parts, plan.thresholds):
        masks = [sum(1 << k for k in ks) for size in range(radius(t) + 1) for ks in combinations(range(len(bits)), size)] if t >= 0 else []
        balls.append(np.array(masks, dtype=np.int64))
    step = max(1, 200_000 // max(1, max(map(len, balls))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, every = longs(b.column(0)), rows_of(b.column(1))
            for at in range(0, len(every), step):
                prints = every[at : at + step]
                for i, (word, bits, masks) in enumerate(zip(plan.words, plan.parts, balls)):
                    if len(masks):
                        keys = ((gather(prints[:, word], bits)[:, None] ^ masks[None, :]) << 8) | i
                        yield batch(["key", "id", "fp"], keys.ravel(), np.repeat(ids[at : at + step], len(masks)), lists_of(np.repeat(prints, len(masks), axis=0)))

    return classes.select("id", "fp").mapInArrow(run, "key long, id long, fp array<long>")


def near(left: np.ndarray, right: np.ndarray, limit: int) -> np.ndarray:
    """Whether each row of left is within limit of each row of right."""
    total = np.zeros((len(left), len(right)), dtype=np.uint16)
    width = left.shape[1]
    for k in range(width):
        total += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
        if k == 3 and width > 4:  # what is further apart already is out; as a rule that is nearly all
            some = np.flatnonzero((total <= limit).any(0))
            if 4 * len(some) < len(right):
                out = np.zeros(total.shape, dtype=bool)
                rest = total[:, some]
                for j in range(4, width):
                    rest += np.bitwise_count(left[:, j, None] ^ right[None, some, j])
                out[:, some] = rest <= limit
                return out
    return total <= limit


def joined(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row that it is connected with."""
    reach = links | np.eye(len(links), dtype=bool)
    while True:
        further = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (further == reach).all():
            return reach.argmax(1)
        reach = further


def spanning(ids: np.ndarray, prints: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (one, another) that connect what distances up to limit connect: all of a wave, or where there are many, a
    spanning forest."""
    left, out = np.arange(len(ids)), []
    front = left[:0]
    while len(front) or len(left) > 1:
        if len(front):
            wave, front = front[:WAVE], front[WAVE:]
        else:
            wave, left = left[:WAVE], left[WAVE:]
        close, inner = near(prints[wave], prints[left], limit), near(prints[wave], prints[wave], limit)
        met = close.any(0)
        found = left[met]
        close = close[:, met]
        if max((close.sum(1) + inner.sum(1)).max(initial=0) - 1, 0) > CROWD:
            out.append((ids[wave[close.argmax(0)]], ids[found]))
            # What two of the wave both reach connects them.
            reach = close.astype(np.float32)
            out.append((ids[wave[joined(inner | ((reach @ reach.T) > 0))]], ids[wave]))
        else:
            for (a, b), others in ((np.nonzero(close), found), (np.nonzero(np.triu(inner, 1)), wave)):
                out.append((ids[wave[a]], ids[others[b]]))
        front, left = np.concatenate([front, found]), left[~met]
    return out


def settle(key: np.ndarray, ids: np.ndarray, prints: np.ndarray, limit: int) -> pa.RecordBatch:
    """Links of whole keys; rows are sorted by key."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none)]
    small = np.repeat(np.where(sizes <= DIRECT, sizes, 0), sizes)
    for d in range(1, min(DIRECT, int(sizes.max()))):
        at = np.flatnonzero((key[d:] == key[:-d]) & (small[d:] > d))
        at = at[np.bitwise_count(prints[at] ^ prints[at + d]).sum(1, dtype=np.int64) <= limit]
        found.append((ids[at], ids[at + d]))
    for k in np.flatnonzero(sizes > DIRECT):
        found += spanning(ids[starts[k] : starts[k] + sizes[k]], prints[starts[k] : starts[k] + sizes[k]], limit)
    a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    other = a != b
    return batch(["a", "b"], np.minimum(a, b)[other], np.maximum(a, b)[other])


def compared(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b): the links inside each key of rows (key, id, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the last key's rows so far
        for b in batches:
            if not b.num_rows:
                continue
            key, ids, prints = longs(b.column(0)), longs(b.column(1)), rows_of(b.column(2))
            last = int(np.searchsorted(key, key[-1]))
            if last or (held and held[0][0][0] != key[0]):
                parts = [*held, (key[:last], ids[:last], prints[:last])]
                held = []
                yield settle(*[np.concatenate(x) for x in zip(*parts)], limit)
            held.append((key[last:], ids[last:], prints[last:]))
        if held:
            yield settle(*[np.concatenate(x) for x in zip(*held)], limit)

    return rows.select("key", "id", "fp").repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def large_links(rows: DataFrame, leaders: DataFrame, limit: int, block: int) -> DataFrame:
    """(a, b): the links inside large keys. leaders: (key, n, leader, leader_fp), one row a key."""
    few = leaders.count() <= MAX_BROADCAST
    meet = lambda fact, dim: fact.join(F.broadcast(dim), "key") if few else skew_join(fact, dim, "key")
    led = checkpoint(meet(rows, leaders).withColumn("far", distance(F.col("fp"), F.col("leader_fp")) > limit))
    direct = led.where(~F.col("far") & (F.col("id") != F.col("leader"))).select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"))
    # Those near the leader are connected. Each of the others meets all, a block of them and a block of all at a time.
    far = led.where("far").groupBy("key").agg(F.count("*").alias("n_far"))
    blocks_of = lambda n: F.ceil(F.col(n) / block).cast("int")
    tasks = checkpoint(far.join(leaders.select("key", "n"), "key").select("key", blocks_of("n").alias("wide"), blocks_of("n_far").alias("tall")))
    dealt = meet(led, tasks)
    i, j = F.pmod(F.xxhash64("id"), F.col("tall")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("wide"))
    cells = lambda x, y: F.xxhash64("key", x, y).alias("key")
    tall = dealt.where("far").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    wide = dealt.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)))
    crossed = tall.unionByName(wide).select(cells(F.col("i"), F.col("j")), "id", "fp")
    return direct.unionByName(compared(crossed, limit))


def links(classes: DataFrame, plan: Plan, limit: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all classes at limit differing bits or fewer that the plan's parts find."""
    rows = signatures(classes, plan)
    large = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp")).alias("l")).where(F.col("n") > block).select("key", "n", F.col("l.id").alias("leader"), F.col("l.fp").alias("leader_fp")))
    n = large.count()
    if not n:
        return compared(rows, limit).distinct()
    sizes = large.select("key", "n")
    if n <= MAX_BROADCAST:
        marked = rows.join(F.broadcast(sizes), "key", "left")
    else:
        marked = skew_join(rows, sizes, "key", "left")
    marked = checkpoint(marked)
    small = compared(marked.where("n IS NULL"), limit)
    return small.unionByName(large_links(marked.where("n IS NOT NULL").drop("n"), large, limit, block)).distinct()


def groups(docs: DataFrame, limit: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, k1, k2, id, fp, head) for each row of docs; head is the struct (lone, k1, k2) of its component's first
    document, by doc_id, nulls last. Fingerprints of 64 bits; all links within limit."""
    prints = checkpoint(fingerprints(docs, words))
    classes = classes_of(prints)
    n, both = bit_statistics(classes)
    return heads_of(prints, classes, components(links(classes, make_plan(n, both, limit), limit)))


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, bits: int = 512, inside: float = 0.95, found_by: float = 0.98) -> DataFrame:
    """As groups, of documents whose sets of shingles have a Jaccard similarity of `similarity` or more.

    A pair at that similarity is within the limit of the fingerprints with probability `inside`, and the parts find it
    with probability `found_by`; more similar ones are found more often, and so are those that others connect. Every
    link is then verified on the shingles themselves.
    """
    prints = set_prints(docs, words, bits)
    classes = classes_of(prints)
    n, both = bit_statistics(classes, bits)
    limit = limit_for(bits, similarity, inside)
    plan = make_plan(n, both, limit, apart(similarity), found_by)
    families = components(links(classes, plan, limit)).select(F.col("node").alias("id"), F.col("root").alias("family"))
    members = checkpoint(families.join(classes, "id").select("family", "id", F.col("head.k1").alias("k1"), F.col("head.k2").alias("k2")))
    k1, k2 = row_key()
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text")).join(sized(members), ["k1", "k2"])
    return heads_of(prints, classes, components(similar_pairs(texts.select("family", "id", "text"), words, similarity)))


def classes_of(prints: DataFrame) -> DataFrame:
    """(id, fp, head): one row a fingerprint."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "k1", "k2"))
    return checkpoint(prints.groupBy("id").agg(F.min("fp").alias("fp"), head.alias("head")))


def heads_of(prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """prints with the head of each row's component, from the classes' heads and the components (node, root)."""
    rooted = checkpoint(classes.join(found, F.col("id") == F.col("node"), "left").select("id", "head", F.coalesce("root", "id").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("head").alias("head"))
    named = checkpoint(skew_join(rooted.select("id", "root"), heads, "root").select("id", "head"))
    return skew_join(prints, named, "id")


def report(docs: DataFrame, limit: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    found = groups(docs, limit, words)
    name = F.when(~F.col("head.lone"), F.col("head.k1"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), name.alias("component_id"))


def deduplicate(docs: DataFrame, similarity: float = 0.8, words: int = 5, bits: int = 512) -> DataFrame:
    """The rows of docs that stay: each group's first document, by doc_id; one row where it is repeated."""
    return kept_rows(docs, similar_groups(docs, similarity, words, bits))


def kept_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that are the head of their component in found, as groups gives it."""
    head = (F.col("k1") == F.col("head.k1")) & (F.col("k2") == F.col("head.k2"))
    keys = checkpoint(found.groupBy("k1", "k2", head.alias("stays")).agg(F.count("*").alias("n")).where(~F.col("stays") | (F.col("n") > 1)))
    gone, again = keys.where(~F.col("stays")).select("k1", "k2"), keys.where("stays").select("k1", "k2")
    rows, name = numbered(docs)
    k1, k2 = row_key(name("text"), name("doc_id"))
    left = rows.withColumns({"k1": k1, "k2": k2}).join(sized(gone), ["k1", "k2"], "left_anti")
    again = sized(again)
    once, repeated = left.join(again, ["k1", "k2"], "left_anti"), left.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return once.unionByName(repeated).select(*rows.columns).toDF(*docs.columns)
