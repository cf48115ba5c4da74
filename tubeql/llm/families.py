"""Exact similarity links inside families: pairs of members whose sets of shingles have a Jaccard similarity.

A family is a group of members in which links are to be looked for; it may have any size and any number of links. What
is found connects exactly what all links connect:
* families of up to SMALL members and SMALL_BYTES of text are searched in one task each, breadth first: a member is
  compared, on all shingles, with those not reached yet. The task streams family after family.
* larger ones are searched by joins. In a few rounds everything is compared with one more member (a leader) of its
  family, which settles the crowds that are alike. What is then still apart is compared by prefixes: with a family's
  shingles in order of their frequency, rare ones first, two sets of sizes s <= t that are similar share one of the
  first s - ceil(2ps / (p + q)) + 1 of the smaller and the first t - ceil(pt / q) + 1 of the larger (similarity p / q).
  A crowd of documents that share a template, but aren't similar, has nothing in common among its rare shingles, so it
  costs no pairs. Candidates are verified on all shingles.
Both ways compare the same sets by the same rule, so a family's size decides the way, never the result.

Defined results
* rows of a member that repeat count once. Two members without shingles are similar; one without and one with aren't.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, checkpoint, longs, sized, skew_join
from .components import components
from .wordvec import blocks, gram_hashes, runs_inside, word_hashes, word_places

#: A family of more members, or more bytes of text, is searched by joins.
SMALL, SMALL_BYTES = 1_000, 16 << 20
#: Members that everything in a large family is compared with before prefixes are.
LEADERS = 4


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The different shingles of each text, as 64-bit hashes, sorted."""
    out: list[np.ndarray] = []
    for _, octets, offsets in blocks(column):
        starts, ends, first = word_places(octets, offsets)
        hashes = word_hashes(octets, starts, ends)
        grams, inside = gram_hashes(hashes, words), runs_inside(first, len(hashes), words)
        for a, z in zip(first, first[1:]):
            if z - a >= words:
                own = grams[a : z - words + 1][inside[a : z - words + 1]]
            else:
                own = gram_hashes(hashes[a:z], int(z - a)) if z > a else grams[:0]
            out.append(np.unique(own).view(np.int64))
    return out


def linked(sets: list[np.ndarray], share: Fraction) -> list[tuple[int, int]]:
    """Links (one, another), similar, that connect all that is: a breadth-first forest."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    names, counts = np.unique(flat, return_counts=True)
    ends = np.cumsum(counts)
    owner = owner[order]
    p, q = share.numerator, share.denominator
    left, out = np.ones(len(sets), dtype=bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], front = False, [seed]
        while front and left.any():
            x = front.pop()
            at = np.searchsorted(names, sets[x])
            n = counts[at]
            places = np.repeat(ends[at] - np.cumsum(n), n) + np.arange(n.sum()) if len(at) else at
            common = np.bincount(owner[places], minlength=len(sets))
            near = np.flatnonzero(left & (common * (p + q) >= (sizes + sizes[x]) * p))
            left[near] = False
            out += [(x, int(k)) for k in near]
            front += near.tolist()
    return out


def small_links(texts: DataFrame, words: int, share: Fraction) -> DataFrame:
    """(a, b): links of families that fit into a task, from rows (family, id, text)."""

    def found(ids: list[int], held: list[pa.Array]) -> pa.RecordBatch:
        pairs = linked([s for column in held for s in shingle_sets(column, words)], share) if len(ids) > 1 else []
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        names = np.array(ids, dtype=np.int64)
        return batch(["a", "b"], names[ends[:, 0]], names[ends[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []
        for b in batches:
            families, members = longs(b.column(0)), longs(b.column(1))
            cuts = np.flatnonzero(np.append(True, families[1:] != families[:-1])) if len(families) else []
            for a, z in zip(cuts, [*cuts[1:], len(families)]):
                if families[a] != now and ids:
                    yield found(ids, held)
                    ids, held = [], []
                now = families[a]
                new = np.append(True, members[a + 1 : z] != members[a : z - 1])
                new[0] &= not ids or ids[-1] != members[a]
                ids += members[a:z][new].tolist()
                held.append(pc.filter(b.column(2).slice(a, z - a), pa.array(new)))
        if ids:
            yield found(ids, held)

    return texts.select("family", "id", "text").repartition("family").sortWithinPartitions("family", "id").mapInArrow(run, "a long, b long")


def similar(a: Column, b: Column, share: Fraction) -> Column:
    """Whether two arrays of different values have the Jaccard similarity."""
    return F.size(F.array_intersect(a, b)) * (share.numerator + share.denominator) >= (F.size(a) + F.size(b)) * share.numerator


def verified(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """The similar ones of pairs (a, b); sets: (id, grams)."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("grams").alias(f"g{x}"))
    both = skew_join(skew_join(pairs.select("a", "b"), side("a"), "a"), side("b"), "b")
    return both.where(similar(F.col("ga"), F.col("gb"), share)).select("a", "b")


def labelled(sets: DataFrame, found: DataFrame | None) -> DataFrame:
    """(family, id, part): the component of each member by the links found so far."""
    plain = sets.select("family", "id")
    if found is None:
        return plain.withColumn("part", F.col("id"))
    return plain.join(components(found), F.col("id") == F.col("node"), "left").select("family", "id", F.coalesce("root", "id").alias("part"))


def large_links(texts: DataFrame, words: int, share: Fraction, leaders: int = LEADERS) -> DataFrame:
    """(a, b): links of families of any size, from rows (family, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(["family", "id", "grams"], b.column(0), b.column(1), pa.array(shingle_sets(b.column(2), words), pa.list_(pa.int64())))

    made = texts.select("family", "id", "text").mapInArrow(run, "family long, id long, grams array<long>")
    sets = checkpoint(made.groupBy("family", "id").agg(F.first("grams").alias("grams")))  # repeated rows have one set
    found: DataFrame | None = None
    for k in range(leaders):
        now = checkpoint(labelled(sets, found))
        # The next leader is a member of the part that holds most: what it reaches is likely to be reached soon.
        parts = now.groupBy("family", "part").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(k))).alias("leader"))
        best = parts.groupBy("family").agg(F.max(F.struct("n", "leader", "part")).alias("best"), F.count("*").alias("parts")).where("parts > 1")
        chosen = checkpoint(best.select("family", F.col("best.leader").alias("leader"), F.col("best.part").alias("own")))
        if not chosen.count():
            return found
        led = skew_join(now, chosen, "family").where(F.col("part") != F.col("own"))
        more = checkpoint(verified(led.select(F.col("leader").alias("a"), F.col("id").alias("b")), sets, share))
        found = more if found is None else found.unionByName(more)
    now = checkpoint(labelled(sets, found))
    apart = now.groupBy("family").agg(F.count_distinct("part").alias("n")).where("n > 1").select("family")
    rest = checkpoint(skew_join(now, apart, "family"))
    return found.unionByName(verified(by_prefix(rest, sets, share), sets, share))


def by_prefix(members: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """(a, b): pairs of members (family, id, part) of different parts that share a shingle of their prefixes."""
    p, q = share.numerator, share.denominator
    up = lambda a, b: F.ceil(a / F.lit(b)).cast("int")
    own = checkpoint(members.join(sets.select("id", "grams"), "id"))
    tokens = own.select("family", "id", "part", F.size("grams").alias("size"), F.explode("grams").alias("gram")).withColumn("token", F.xxhash64("family", "gram"))
    often = checkpoint(tokens.groupBy("token").agg(F.count("*").alias("often")))
    placed = skew_join(tokens, often, "token").groupBy("family", "id", "part", "size").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("ts"))
    ranked = checkpoint(placed.select("family", "id", "part", "size", F.posexplode(F.slice(F.col("ts.token"), F.lit(1), F.col("size") - up(F.col("size") * p, q) + 1)).alias("at", "token")))
    index = ranked.where(F.col("at") < F.col("size") - up(F.col("size") * 2 * p, p + q) + 1)
    x, y = index.alias("x"), ranked.alias("y")
    smaller = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    fits = (F.col("x.size") * q >= F.col("y.size") * p) & (F.col("x.part") != F.col("y.part")) & (F.col("x.family") == F.col("y.family"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & smaller & fits)
    return checkpoint(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())


def similar_pairs(texts: DataFrame, words: int, similarity: float, small: int = SMALL, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(a, b): links that connect all members of a family that similar pairs connect, from rows (family, id, text)."""
    share = Fraction(similarity).limit_denominator(10_000)
    kept = checkpoint(texts)
    sizes = kept.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = checkpoint(sizes.where((F.col("n") > small) | (F.col("bytes") > small_bytes)).select("family"))
    if not large.count():
        return small_links(kept, words, share)
    large = sized(large)
    return small_links(kept.join(large, "family", "left_anti"), words, share).unionByName(large_links(kept.join(large, "family", "left_semi"), words, share))
