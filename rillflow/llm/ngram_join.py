"""N-gram Jaccard join: a size-aware heavy-light set join, exact at any size.

A document's set is its distinct k-word shingles (A-Z lower-cased). Two sets of n and m shingles link when they share
    need(n, m) = ceil(num * (n + m) / (num + den)) shingles, that is, when their similarity is num / den or more.

Light sets are enumerated: every subset of each size need(n, m) that a partner could call for is a key. Two light sets under
one key of size s share s shingles, so they link if need(n, m) <= s, without a look at the sets; as need grows with n and m,
links to the smallest set under a key connect all that any pair under it would.

Heavy sets are found by scanning inverted lists of single shingles. Every set's shingles are put in one order, rarest first
(by counts of all shingles in a table of fixed size, then by digest). Of two linked sets, each holds a shared shingle among
its first n - ceil(num * n / den) + 1, so a set is entered only in the lists of these and the lists of common shingles are
hardly scanned. Sizes fall in bands; a set is listed in its own and, if a larger partner may be there, in the next band.

The boundary between light and heavy is the size at which the cost of enumeration, summed over the sizes of all documents,
is least against that of list entries; an entry's cost is the length of the lists of rare shingles, read off the table of
counts. Light sets near the boundary are also listed, for their heavy partners.

Most lists have one member. A first pass sends only 32-bit pieces of the keys to find those that occur again, and marks them
in a bitmap of bounded size; a second pass writes list entries only where the bitmap lets them through. In a band, linked
sets share not one but `overlap` shingles among overlap - 1 more first ones, so the first pass takes these as well, and a
set of which fewer than overlap occur again is in no list: chance puts it under a common shingle or two, not under so many.

Under each list the smallest set is the pivot; no group's pairs are ever emitted, only (pivot, member). What is compared
first are sketches: parities of a set's shingles over some bits, which differ in no more bits than the sets in shingles, so
a pair beyond the bound is none and sets need not be sent. Then the pivot that is nearest to each member is verified with
the sets themselves, a pivot's once for a block of members; then, of the other pivots, those that would connect something
new. Members of a list that are still not connected to its pivot are compared with the others in blocks of bounded size, by
sketch, and those that remain, by their sets.

Defined cases: null, empty and blank texts have no shingles and link with nothing; rows that repeat an id are one document
that links where any of its texts does; a null id is never linked (its component is null); ties in size go to the smaller
id; an empty table gives an empty result; other columns are ignored. Shingles are compared by 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, restrict
from .kernels import U, mix, shingle_sets, slices

#: Bits of a sketch for each shingle by which linked sets may differ, and the fewest.
SKETCH, LEAST_SKETCH = 4, 256
#: Members of a block, and bytes of their sketches, when the rest of a list is compared by sketch.
BLOCK, BLOCK_BYTES = 2000, 4 << 20
#: Shingles of a block's sets when they are compared.
BLOCK_SHINGLES = 1 << 18


@dataclass(frozen=True)
class Measure:
    """Similarity num / den, and what follows from it for sizes."""

    num: int
    den: int

    def need(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({s for m in self.partners(n) if m > 0 and (s := self.need(n, m)) <= min(n, m)})

    def bands(self, top: int) -> list[int]:
        """Lowest size of every band up to the size top; the partners of a set are in its band and the next ones to it."""
        out = [1]
        while out[-1] <= top:
            out.append(-(-out[-1] * max(2 * self.num, self.den) // self.num))
        return out

    def apart(self, both):
        """Most shingles in which linked sets of so many shingles in all differ."""
        return both - 2 * (-(-self.num * both // (self.num + self.den)))

    def entries(self, n: int) -> int:
        """List entries of a set in its own band."""
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, lo: int) -> int:
        """Shared shingles asked for in the band from size lo on; no more than any two linked sets of the band share."""
        return max(1, min(2 * self.entries(lo), -(-self.num * lo // self.den)))

    def subsets(self, n: int) -> int:
        return sum(comb(n, s) for s in self.subset_sizes(n))

    def candidates(self, entry: float) -> int:
        """First size of which no set, nor any larger one, is cheaper to enumerate; entry: cost of a list entry in subsets'."""
        n = 1
        while n < 32 or self.subsets(n) < 100 * entry * self.entries(n):
            n += 1
        return n

    def boundary(self, counts: dict[int, int], entry: float) -> int:
        """First heavy size. counts: documents of each size below candidates(entry)."""
        best, cost, least = 1, 0.0, 0.0
        for n in range(1, self.candidates(entry)):
            cost += counts.get(n, 0) * (self.subsets(n) - entry * self.entries(n))
            if cost < least:
                best, least = n + 1, cost
        return best


#: Shingles are counted in this many bins, kept in pieces of PIECE bins.
FREQUENCY_BITS, PIECE = 20, 1 << 14
#: Most bits of the bitmap of keys that occur again, as a power of two (8 MB). A full one lets every entry through.
AGAIN_BITS = 26
_PROFILE = "doc_id long, n int, d1 long, d2 long, piece int, counts binary"
_PROFILE_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])


def _profile(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document its id, set size and a 128-bit digest of the set; then, for the task, counts of shingles by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQUENCY_BITS, np.int32)
        for batch in batches:
            for rows, data, off in slices(batch):
                sh, so = shingle_sets(data, off, k)
                c1, c2 = (np.concatenate([[U(0)], np.cumsum(mix(sh ^ U(x)))]) for x in (0x51ED27, 0xC2B2AE))
                d1, d2 = (mix(c[so[1:]] - c[so[:-1]]).view(np.int64) for c in (c1, c2))
                total += np.bincount((sh >> U(64 - FREQUENCY_BITS)).astype(np.int64), minlength=len(total)).astype(np.int32)
                m = len(so) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(np.diff(so), pa.int32()), pa.array(d1), pa.array(d2), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=_PROFILE_ARROW)
        if total.any():
            pieces = total.reshape(-1, PIECE)
            m = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array([-1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], schema=_PROFILE_ARROW)

    return run


def _sum_counts(g: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in g["counts"].to_pylist())
    return pa.Table.from_pydict({"piece": pa.array([g["piece"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


@dataclass(frozen=True)
class Counts:
    """Classes of bins of shingles, from 0 for as many as chance puts there upwards by powers of the root of two, and the
    mean length of the lists of the rarest shingles."""

    classes: bytes
    length: float


def count_bins(profile: DataFrame, measure: Measure) -> Counts:
    rows = profile.where("n = -1").select("piece", "counts").groupBy("piece").applyInArrow(_sum_counts, "piece int, counts binary").collect()  # 2 ** FREQUENCY_BITS numbers
    total = np.zeros((1 << FREQUENCY_BITS) // PIECE * PIECE, np.int64).reshape(-1, PIECE)
    for r in rows:
        total[r.piece] = np.frombuffer(bytes(r.counts), np.int64)
    total = total.ravel()
    mean = total.mean()
    chance = mean + 6 * mean**0.5 + 2
    classes = np.where(total > chance, np.clip(1 + 2 * np.log2(np.maximum(total, 1) / chance), 1, 255), 0).astype(np.uint8)
    rare = np.sort(total[total > 0])
    rare = rare[np.cumsum(rare) <= max(rare[:1].sum(), (1 - measure.num / measure.den) * rare.sum())]
    length = float((rare * np.maximum(1.0, rare - mean)).sum() / rare.sum()) if len(rare) else 1.0
    return Counts(classes.tobytes(), length)


def light_keys(shingles: np.ndarray, measure: Measure) -> list[tuple[int, int]]:
    """(key, subset size) of every subset of a light set that a partner could share."""
    n = len(shingles)
    each = mix(shingles ^ U(0x5BD1E995))
    total = each.sum(dtype=U)
    out = []
    for s in measure.subset_sizes(n):
        drop = [np.concatenate([[U(0)], each[list(c)]]).sum(dtype=U) for c in combinations(range(n), n - s)] if s < n else [U(0)]
        keys = mix((total - np.array(drop, U)) ^ U(s * 0x9E3779B1 + 7))
        out += [(int(x), s) for x in keys.view(np.int64)]
    return out


def heavy_keys(sh: np.ndarray, so: np.ndarray, docs: np.ndarray, band: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of so many first shingles of documents docs in bands band: document numbers, keys, whether it is a list's key
    (that of the `first` ones) and the number of the entry in docs."""
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    entry = np.repeat(np.arange(len(docs)), length)
    key = mix(sh[so[docs][entry] + place] ^ mix(band.astype(U) + U(0x2545F491))[entry])
    return docs[entry], key.view(np.int64), place < first[entry], entry


@dataclass(frozen=True)
class Plan:
    """What keys depend on, the same for every document."""

    k: int
    measure: Measure
    boundary: int
    bands: list[int]
    classes: bytes

    def slices(self, batches: Iterator[pa.RecordBatch], marked: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, set sizes, document of each key, keys, subset sizes: 0 for a list of heavy sets); marked: whether a key occurs
        again, for only those keys that are to be entered."""
        overlap = np.array([self.measure.overlap(lo) for lo in self.bands])
        starts = np.array([*self.bands, 1 << 60])
        classes = np.frombuffer(self.classes, np.uint8)
        m = self.measure
        for batch in batches:
            for rows, data, off in slices(batch):
                sh, so = shingle_sets(data, off, self.k)
                n = np.diff(so)
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False)
                # Rarest first: by class, and within one by digest, as the sets are sorted already.
                common = classes[(sh >> U(64 - FREQUENCY_BITS)).astype(np.int64)].astype(np.int64)
                order = np.argsort((np.repeat(np.arange(len(n)), n) << 8) | common, kind="stable") if common.any() else slice(None)
                listed = np.flatnonzero((n > 0) & (n * m.den >= self.boundary * m.num))
                size = n[listed]
                band = np.searchsorted(starts, size, "right") - 1
                after = starts[band + 1]
                # A partner in the next band has at most den * n / num shingles, and shares need(n, first of the band) or more.
                up = np.flatnonzero(m.den * size >= m.num * after)
                full = size - -(-m.num * size // m.den) + 1
                less = size[up] - -(-m.num * (size[up] + after[up]) // (m.num + m.den)) + 1
                docs, bands, first = np.concatenate([listed, listed[up]]), np.concatenate([band, band[up] + 1]), np.concatenate([full, less])
                doc, key, own, entry = heavy_keys(sh[order], so, docs, bands, first + overlap[bands] - 1, first)
                if marked is not None:
                    again = marked(key)
                    enough = np.bincount(entry, again, len(docs)) >= overlap[bands]
                    keep = own & again & enough[entry]
                    doc, key = doc[keep], key[keep]
                kind = np.zeros(len(doc), np.int8)
                light = np.flatnonzero((n > 0) & (n < self.boundary))
                if len(light):
                    found = [(d, *x) for d in light.tolist() for x in light_keys(sh[so[d] : so[d + 1]], m)]
                    one, k, s = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int8)
                    if marked is not None:
                        keep = marked(k)
                        one, k, s = one[keep], k[keep], s[keep]
                    doc, key, kind = np.concatenate([doc, one]), np.concatenate([key, k]), np.concatenate([kind, s])
                yield ids, n, doc, key, kind


def _pieces(plan: Plan, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(group, packed): a key's first bits are its group, the next 32 are packed; once for each task, twice if it repeats."""

    def out(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, c = np.unique(np.concatenate(keys).view(U), return_counts=True)
        u = np.sort(np.concatenate([u, u[c > 1]]))
        group = (u >> U(64 - bits)).astype(np.int64)
        piece = (u >> U(32 - bits)).astype(np.uint32)
        at = np.searchsorted(group, np.arange((1 << bits) + 1))
        some = np.flatnonzero(np.diff(at))
        yield pa.RecordBatch.from_pydict({"g": pa.array(some, pa.int32()), "p": pa.array([piece[at[i] : at[i + 1]].tobytes() for i in some.tolist()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for _, _, _, key, _ in plan.slices(batches):
            keys.append(key)
            held += len(key)
            if held > 500_000:
                yield from out(keys)
                keys, held = [], 0
        if held:
            yield from out(keys)

    return run


def _repeats(bits: int, top: int) -> Callable[[pa.Table], pa.Table]:
    def run(g: pa.Table) -> pa.Table:
        x = np.sort(np.concatenate([np.frombuffer(p.as_buffer(), np.uint32) for p in g["p"]]))
        again = x[1:][x[1:] == x[:-1]]
        marks = np.zeros(1 << (top - bits), bool)
        marks[again >> np.uint32(32 - (top - bits))] = True
        return pa.Table.from_pydict({"g": pa.array([g["g"][0].as_py()], pa.int32()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    return run


def keys_again(docs: DataFrame, plan: Plan, total: int) -> bytes:
    """Packed bits, by a key's first bits, of keys that occur more than once. total: list entries and subsets, about.

    Groups grow in number with the input, so that none needs more than tens of megabytes.
    """
    bits = 6
    while bits < 16 and (total >> bits) > 2_000_000:
        bits += 1
    top = min(AGAIN_BITS, max(bits + 6, total.bit_length() + 3))
    rows = docs.mapInArrow(_pieces(plan, bits), "g int, p binary").groupBy("g").applyInArrow(_repeats(bits, top), "g int, marks binary").collect()  # 2 ** AGAIN_BITS bits
    size = (1 << (top - bits)) // 8
    out = bytearray(size << bits)
    for r in rows:
        out[r.g * size : (r.g + 1) * size] = bytes(r.marks)
    return bytes(out)


def _keys(plan: Plan, again: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, doc_id, n, s of keys that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(again, np.uint8)
        top = U(64 - (len(again).bit_length() + 2))

        def marked(key: np.ndarray) -> np.ndarray:
            at = (key.view(U) >> top).astype(np.int64)
            return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0

        for ids, n, doc, key, size in plan.slices(batches, marked):
            for a in range(0, len(doc), 100_000):
                d = doc[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000]), pa.array(ids[d], pa.int64()), pa.array(n[d], pa.int32()), pa.array(size[a : a + 100_000])], names=["key", "doc_id", "n", "s"])

    return run


def sketch(sh: np.ndarray, measure: Measure) -> np.ndarray:
    """Parities of the set's shingles, in as many bits as its size calls for (a power of two)."""
    bits, worst = LEAST_SKETCH, measure.apart(len(sh) + measure.den * len(sh) // measure.num)
    while bits < SKETCH * worst:
        bits *= 2
    return np.packbits((np.bincount((mix(sh) >> U(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(bool))


def folded(sk: np.ndarray, size: int) -> np.ndarray:
    """The same set's sketch of fewer bytes."""
    return np.bitwise_xor.reduce(sk.reshape(-1, size), axis=0)


def _sets(k: int, make: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, n and what make makes of each set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in slices(batch):
                sh, so = shingle_sets(data, off, k)
                made = pa.array([make(sh[a:b]).tobytes() for a, b in zip(so[:-1], so[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(np.diff(so), pa.int32()), made], names=["doc_id", "n", "x"])

    return run


_NEAR = pa.schema([("pivot", pa.int64()), ("member", pa.int64()), ("n", pa.int32()), ("apart", pa.int32())])


def _by_sketch(measure: Measure) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pivot, member, np, n, sp, sm): the bits in which the sketches differ, or null if the pair cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            bound = measure.apart(a + b)
            out = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                d = max(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()), abs(int(a[i] - b[i])))
                out.append(d if d <= bound[i] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.int32())], schema=_NEAR)

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _by_set(measure: Measure) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of members to their pivots. Rows (pivot, part, member, shingles) are sorted; a pivot's own have no member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for pivot, part, member, s in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                x = np.frombuffer(s.as_buffer(), U)
                if (pivot, part) != at:
                    at, sets = (pivot, part), []
                if member is None:
                    sets.append(x.copy())
                elif any(len(np.intersect1d(x, p, assume_unique=True)) >= measure.need(len(x), len(p)) for p in sets):
                    out.append((pivot, member))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=_LINK)

    return run


def verified(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """(a, b) of the pairs (pivot, member, n) that link. A pivot's set is sent once for each block of its members."""
    parts = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    members = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("part"), "member")
    members = members.join(sets.select(F.col("doc_id").alias("member"), "shingles"), "member").select("pivot", "part", "member", "shingles")
    pivots = parts.join(sets.select(F.col("doc_id").alias("pivot"), "shingles"), "pivot")
    pivots = pivots.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("member"), "shingles")
    rows = members.unionByName(pivots).repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.asc_nulls_first("member"))
    return rows.mapInArrow(_by_set(measure), "a long, b long")


_CLOSE = "pivot long, member long, n int, comp long, linked boolean"


def _close(measure: Measure) -> Callable[[pa.Table], pa.Table]:
    """Members that are not connected to their pivot and may link to another member that they are not connected to, and
    these others."""

    def run(g: pa.Table) -> pa.Table:
        role, n, comp = (g[c].to_numpy().astype(np.int64) for c in ("role", "n", "comp"))
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in g["sk"]]
        size = min(map(len, raw))
        sk = np.stack([folded(x, size) for x in raw]).view(U)
        every = np.flatnonzero(role == 1)
        near = np.zeros(len(role), bool)
        for i in np.flatnonzero(role == 0).tolist():
            apart = np.maximum(np.bitwise_count(sk[every] ^ sk[i]).sum(1), np.abs(n[every] - n[i]))
            hit = every[(apart <= measure.apart(n[i] + n[every])) & (comp[every] != comp[i])]
            if len(hit):
                near[i] = True
                near[hit] = True
        return g.select(["pivot", "member", "n", "comp", "linked"]).take(pa.array(np.flatnonzero(near)))

    return run


def blocks(rows: DataFrame, weight, most: int) -> DataFrame:
    """rows (pivot, member, comp, linked, ...) of the lists that have a member which is not connected to the pivot, dealt to
    blocks of at most so much weight: all members of a block (role 1) and the loose ones of each block against it (role 0)."""
    weights = F.sum(weight).alias("all"), F.sum(F.when(~F.col("linked"), weight)).alias("loose")
    sizes = rows.groupBy("pivot").agg(*weights, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("loose > 0 and lo < hi")
    sizes = sizes.select("pivot", F.ceil(F.col("all") / most).cast("int").alias("nb"), F.ceil(F.col("loose") / most).cast("int").alias("nu"))
    cut, h = rows.join(sizes, "pivot"), F.xxhash64("member")
    members = cut.select(*rows.columns, F.pmod(h, "nb").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("ub"), F.lit(1).alias("role"))
    loose = cut.where("not linked").select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("mb"), F.pmod(h, "nu").cast("int").alias("ub"), F.lit(0).alias("role"))
    return members.unionByName(loose)


def _settle(measure: Measure) -> Callable[[pa.Table], pa.Table]:
    """Links of members that are not connected to their pivot, to one another and to the others, one for each new join."""

    def run(g: pa.Table) -> pa.Table:
        role, n, member, comp = (g[c].to_numpy().astype(np.int64) for c in ("role", "n", "member", "comp"))
        sets = [np.frombuffer(x.as_buffer(), U) for x in g["shingles"]]
        every = np.flatnonzero(role == 1)
        tokens = np.concatenate([sets[i] for i in every]) if len(every) else np.zeros(0, U)
        owner = np.repeat(np.arange(len(every)), n[every])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in np.flatnonzero(role == 0).tolist():
            a, b = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
            hit = b > a
            at = np.concatenate([owner[p:q] for p, q in zip(a[hit], b[hit], strict=True)]) if hit.any() else np.zeros(0, np.int64)
            both = np.bincount(at, minlength=len(every))
            linked = both * (measure.num + measure.den) >= measure.num * (n[i] + n[every])
            for j in every[linked].tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[x] = y
                    out.append((int(member[i]), int(member[j])))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=_LINK)

    return run


def named(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs with the component of each member, and whether it is its pivot's."""
    comp = comp.select(F.col("node"), F.col("component"))
    out = pairs.join(comp.withColumnRenamed("node", "member"), "member", "left").withColumn("comp", F.coalesce("component", "member")).drop("component")
    out = out.join(comp.withColumnRenamed("node", "pivot"), "pivot", "left").withColumn("linked", F.col("comp") == F.coalesce("component", "pivot"))
    return out.drop("component")


def links(docs: DataFrame, k: int, measure: Measure, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, copies, components): every document's set size; for ids whose one set a smaller id has, that id; and
    (node, component) of the others that link."""
    spark = docs.sparkSession
    profile = ws.put(docs.mapInArrow(_profile(k), _PROFILE), "profile")
    sizes = profile.where("n >= 0").select("doc_id", "n", "d1", "d2")
    counts = count_bins(profile, measure)
    entry = 1 + counts.length
    few = sizes.where(f"n < {measure.candidates(entry)}").groupBy("n").count().collect()  # a row for each such size
    boundary = measure.boundary({r.n: r["count"] for r in few}, entry)
    top, total, count = (x or 1 for x in sizes.agg(F.max("n"), F.sum("n"), F.count("*")).first())
    plan = Plan(k, measure, boundary, measure.bands(top), counts.classes)
    # Equal sets are one class: only its smallest document goes on.
    keyed = sizes.where("n > 0 and doc_id is not null")
    classes = ws.put(keyed.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "classes")
    copies = ws.put(keyed.join(classes, ["d1", "d2", "n"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    known = docs.where("doc_id is not null")
    # An id leaves only if all its texts are one set that a smaller id has; one with several sets stays with all its rows.
    own = restrict(keyed, "doc_id", copies, "doc_id").groupBy("doc_id")
    one = own.agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("d1", "d2", "n") for f in (F.min, F.max)]).where("d1_min = d1_max and d2_min = d2_max and n_min = n_max").select("doc_id")
    gone = ws.put(copies.join(one, "doc_id", "left_semi"), "gone")
    stay = copies.join(one, "doc_id", "left_anti").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    unique = restrict(known, "doc_id", gone, "doc_id", inside=False).unionByName(restrict(known, "doc_id", gone, "doc_id").join(gone.select("doc_id"), "doc_id", "left_anti"))
    about = count + 4 * (total - measure.num * total // measure.den) + sum(r["count"] * measure.subsets(r.n) for r in few if 0 < r.n < boundary)
    keys = ws.put(unique.mapInArrow(_keys(plan, keys_again(unique, plan, about)), "key long, doc_id long, n int, s byte"), "keys", "lz4")
    lists = keys.groupBy("key", "s").agg(F.min(F.struct("n", "doc_id")).alias("p"), F.count("*").alias("c")).where("c > 1")
    lists = ws.put(lists.select("key", "s", F.col("p.n").alias("np"), F.col("p.doc_id").alias("pivot")), "lists", "lz4")
    found = keys.join(lists, ["key", "s"]).where("doc_id <> pivot").select("pivot", "np", F.col("doc_id").alias("member"), "n", F.col("s").cast("int").alias("s"))
    found = ws.put(found.groupBy("pivot", "member").agg(F.max(F.when((F.col("s") > 0) & ((F.col("np") + F.col("n")) * measure.num <= F.col("s") * (measure.num + measure.den)), 1).otherwise(0)).alias("light"), F.max(F.when(F.col("s") == 0, 1).otherwise(0)).alias("listed")), "found")
    ws.drop("keys", "lists")
    light = found.where("light = 1").select(F.col("pivot").alias("a"), F.col("member").alias("b"))

    def made(pairs: DataFrame, make: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
        """Of all rows of the ids in pairs (and of some others: the filter is not exact), without a shuffle of texts."""
        ids = pairs.select(F.explode(F.array("pivot", "member")).alias("doc_id")).distinct()
        out = restrict(known, "doc_id", ids, "doc_id").mapInArrow(_sets(k, make), "doc_id long, n int, x binary")
        return ws.put(out.withColumnRenamed("x", name), name, "lz4")

    # By sketch: each member against its pivots.
    listed = found.where("listed = 1").select("pivot", "member")
    sk = made(listed, partial(sketch, measure=measure), "sk")
    both = listed.join(sk.select(F.col("doc_id").alias("member"), F.col("n").alias("nm"), F.col("sk").alias("sm")), "member")
    both = both.join(sk.select(F.col("doc_id").alias("pivot"), F.col("n").alias("np"), F.col("sk").alias("sp")), "pivot").select("pivot", "member", "np", "nm", "sp", "sm")
    near = ws.put(both.mapInArrow(_by_sketch(measure), "pivot long, member long, n int, apart int"), "near", "lz4")
    # By set: each member's nearest pivot, then those pivots that would connect something new.
    maybe = near.where("apart is not null")
    sets = made(maybe, np.asarray, "shingles")
    best = ws.put(maybe.groupBy("member").agg(F.min_by(F.struct("pivot", "n"), F.struct("apart", "pivot")).alias("x")).select("x.pivot", "member", "x.n"), "best")
    comp = components(spark, light.unionByName(verified(best, sets, measure)).unionByName(stay), ws, name="first")
    rest = named(maybe.join(best.select("pivot", "member"), ["pivot", "member"], "left_anti"), comp).where("not linked").select("pivot", "member", "n").dropDuplicates(["pivot", "member"])
    more = ws.put(verified(ws.put(rest, "rest"), sets, measure), "more")
    if more.limit(1).count():
        comp = components(spark, comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), ws, name="second")
    # Members that are not connected to a pivot, against the others of its lists: by sketch, then by set.
    lists = ws.put(named(near.select("pivot", "member", "n"), comp), "members")
    lists = blocks(lists.join(sk.select(F.col("doc_id").alias("member"), "sk"), "member"), F.greatest(F.lit(BLOCK_BYTES / BLOCK), F.length("sk")), BLOCK_BYTES)
    # Dealt by block: else the blocks of a pivot stay in the task that the join by pivot brought them to.
    close = ws.put(lists.repartition("pivot", "ub", "mb").groupBy("pivot", "ub", "mb").applyInArrow(_close(measure), _CLOSE).distinct(), "close")
    if close.limit(1).count():
        ws.drop("shingles")
        sets = made(close, np.asarray, "shingles")
        left = blocks(close, F.col("n"), BLOCK_SHINGLES).join(sets.select(F.col("doc_id").alias("member"), F.col("n").alias("m"), "shingles"), "member").drop("n").withColumnRenamed("m", "n")
        settled = left.repartition("pivot", "ub", "mb").groupBy("pivot", "ub", "mb").applyInArrow(_settle(measure), "a long, b long")
        comp = components(spark, comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(settled), ws, name="third")
    ws.drop("shingles")
    return sizes, gone, comp


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    ws = ws or Workspace(docs.sparkSession, "jaccard")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes, gone, comp = links(d, k, Measure(num, den), ws)
    out = sizes.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(gone, "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    return out.join(comp, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
