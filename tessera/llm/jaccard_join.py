"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets with Jaccard similarity >= 0.8 differ in at most k = n // 4 elements,
n being the smaller size.  Every size band hashes the universe of shingles
into m > k segments; a pair differs in at most k of them, so at least e - k of
a set's e non-empty segments are equal in its partner.

- Index.  A set's signatures are the contents of its non-empty segments.  Sets
  of 4 to 7 shingles (k = 1) are one segment with its one-deletion
  neighbourhood; sets of 8 to 63 have a segment for each shingle.  A set just
  above a band is indexed in that band too, so partners meet in one band.
- Cost-based allocation.  With every signature's frequency known, a set that
  shares fewer than e - k signatures with any other set has no partner and
  leaves.  Any other set probes only its k + 1 rarest signatures, which is
  still complete, and costs least; unshared signatures need no probe at all.
- Verification, on words and not on hashes, of pairs that sizes
  and parity bits of the shingles do not rule out.  Each set is compared with the
  leading set of its signature groups; what is left in groups that hold several
  components is compared with a few pivots of each; then, in groups that still
  hold several, pairs across components are compared.  So every link that could
  join two components is verified exactly, and no group is expanded into all
  its pairs.

Equal sets are one class from the start.  A signature is sent as 5 bytes and the
group they lie in; a false match only costs a comparison.  Signatures of very
large groups of near copies are found by counting in a sample and marked as
shared where they stand; what the sample misses goes through the exchange, so
results do not depend on it.  Only texts of sets that probe are exchanged; a
bit map of fixed size keeps most others back.  Should a set be left with no more
than k non-empty segments, or two classes share a fingerprint, the next hash
seed is taken, so the pigeonhole argument always holds.

Cases: null, empty and blank texts have no shingles and link with nothing;
texts of fewer words than a shingle are one shingle; repeated rows get equal
results, other rows that share a doc_id one each by their text; null doc_ids
come back with a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.storage import drop_staged, small_batches, staged
from tessera.llm.textops import chunks, encoded, from_planes, from_steps, mix, planes, sequences, steps, word_table

SHINGLE = 5
# 100 * intersection >= PERCENT * union.
PERCENT = 80
TINY, SMALL = 7, 63
# Signatures packed together, or documents where they have few.
SLICE_SIGNATURES, SLICE_DOCS = 1_000_000, 32_768
SIGNATURES_PER_GROUP = 1_000_000
# Bytes of a signature that are sent.
SIGNATURE_BYTES = 5
# Signatures that more sets than this seem to have, by a count over one class in HEAVY_SAMPLE, are known
# to be shared and need no exchange; at most HEAVY_MOST, the heaviest, so that they can be broadcast.
HEAVY, HEAVY_SAMPLE, HEAVY_MOST = 100_000, 64, 100_000
# Words of the bit map of documents, of 64 bits each.
MAP_WORDS = 1 << 18
BLOCK_BYTES = 8_000_000
PIVOTS = 3
_C1, _C2, _C3 = (np.uint64(c) for c in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


def shingle_sets(data: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (A-Z lower-cased)."""
    out: list[np.ndarray] = []
    for a, b in chunks(data):
        table = word_table(data[a:b], lower=True)
        h = table.hashes()
        seq = sequences(h, n)
        for s, e in zip(table.first[:-1].tolist(), table.first[1:].tolist()):
            if e - s >= n:
                out.append(np.unique(seq[s : e - n + 1]))
            elif e > s:
                out.append(sequences(h[s:e], e - s))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def band_top(n: int) -> int:
    """The largest size in n's band."""
    if n <= TINY:
        return TINY
    top = SMALL
    while top < n:
        top = 2 * top + 1
    return top


def _signatures(s: np.ndarray, top: int, seed: int) -> tuple[np.ndarray, int]:
    """(signatures, k) of a set in the band that ends at `top`."""
    tag = mix(np.array([top * 1_000_003 + seed], dtype=np.uint64))[0]
    x = mix(s + _C3)
    if top == TINY:
        whole = x.sum(dtype=np.uint64)
        sig = np.unique(mix(np.append(whole - x, whole) + tag))
        return sig, len(sig) - 1
    k = min(len(s), top) // 4
    if top == SMALL:
        return mix(x + tag), k
    m = int(1.3 * (top // 4)) + 8
    seg = ((mix(s + tag) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, seg, x)
    ids = np.flatnonzero(np.bincount(seg, minlength=m))
    return mix(sums[ids] + mix(ids.astype(np.uint64) + tag)), k


def _class(s: np.ndarray) -> int:
    return int(mix((mix(s + _C1).sum(dtype=np.uint64) + np.uint64(len(s))).reshape(1))[0].astype(np.int64))


def _profiles(seed: int):
    """One row per slice of documents: their ids, sizes and classes, and each class's signatures by band.

    heads: (class, band, k, number of signatures, size) of each class and band;
    sigs: the signatures in that order.  A class is there once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict = {}
        seen: set[int] = set()
        held = 0

        def full() -> pa.RecordBatch:
            packed = row | {"heads": np.array(row["heads"], dtype=np.int64).tobytes(), "sigs": b"".join(row["sigs"])}
            return pa.RecordBatch.from_pylist([packed], _PROFILE)

        for batch in batches:
            data, doc_ids = encoded(batch.column("text")), batch.column("doc_id").to_pylist()
            for a in range(0, len(data), 512):
                for doc_id, s in zip(doc_ids[a : a + 512], shingle_sets(data[a : a + 512])):
                    if not row:
                        row = {"doc_id": [], "n": [], "cls": [], "cls2": [], "bad": 0, "heads": [], "sigs": []}
                    c = _class(s)
                    row["doc_id"].append(doc_id), row["n"].append(len(s)), row["cls"].append(c)
                    row["cls2"].append(int((mix(s + _C2).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)))
                    if doc_id is not None and len(s) > 3 and c not in seen:
                        seen.add(c)
                        top = band_top(len(s))
                        below = TINY if top == SMALL else (top - 1) // 2 if top > SMALL else 0
                        for t in [top, *([below] if len(s) * 4 <= below * 5 else [])]:
                            sig, k = _signatures(s, t, seed)
                            row["bad"] += int(len(sig) <= k)
                            row["sigs"].append(sig.tobytes())
                            row["heads"].append((c, t, k, len(sig), len(s)))
                            held += len(sig)
                    if held >= SLICE_SIGNATURES or len(row["n"]) >= SLICE_DOCS:
                        yield full()
                        row, seen, held = {}, set(), 0
        if row:
            yield full()
    return run


_LONGS = pa.list_(pa.int64())
_PROFILE = pa.schema([("doc_id", _LONGS), ("n", _LONGS), ("cls", _LONGS), ("cls2", _LONGS), ("bad", pa.int64()), ("heads", pa.binary()), ("sigs", pa.binary())])
_FOUND = "slice long, g long, owners binary, sigs binary, dfs binary, heads binary, places binary"
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]
_LOW = np.uint64((1 << 8 * SIGNATURE_BYTES) - 1)


def _entries(heads: bytes, sigs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place of its head, signature) of every entry of a slice."""
    h = np.frombuffer(heads, np.int64).reshape(-1, 5)
    return np.repeat(np.arange(len(h), dtype=np.int32), h[:, 3]), np.frombuffer(sigs, np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for heads, sigs in zip(*(batch.column(c).to_pylist() for c in ("heads", "sigs"))):
            owner, sig = _entries(heads, sigs)
            cls = np.frombuffer(heads, np.int64).reshape(-1, 5)[:, 0][owner]
            use = cls % HEAVY_SAMPLE == 0
            yield pa.RecordBatch.from_arrays([pa.array(sig[use]), pa.array(cls[use])], ["sig", "cls"])


def _split(sig: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, the bytes of it that are sent) of each signature."""
    sig = sig.view(np.uint64)
    return (sig % np.uint64(groups)).astype(np.int64), sig // np.uint64(groups) & _LOW


def _packed(slices: list[int], group: list[int], parts: list[tuple[np.ndarray, ...]]) -> list[pa.Array]:
    """parts: owner, signature, its number of sets, and slice and place of its leading set, by entry."""
    wide = lambda i, width: pa.array([planes(p[i].astype(np.int64), width) for p in parts], pa.binary())
    return [pa.array(slices, pa.int64()), pa.array(group, pa.int64()), pa.array([steps(p[0]) for p in parts], pa.binary()), pa.array([planes(p[1], SIGNATURE_BYTES) for p in parts], pa.binary()), wide(2, 6), wide(3, 8), wide(4, 4)]


def _by_group(group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cut)).tolist():
        yield g, order[cut[g] : cut[g + 1]]


def _marked(groups: int, heavy: np.ndarray, df: np.ndarray):
    """The heavy signatures of each slice, as rows like those of _shared; their leading set's place is theirs in `heavy`, in slice -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sl, heads, sigs in zip(*(batch.column(c).to_pylist() for c in ("slice", "heads", "sigs"))):
                owner, sig = _entries(heads, sigs)
                place = np.minimum(np.searchsorted(heavy, sig), len(heavy) - 1)
                hit = heavy[place] == sig
                owner, place = owner[hit], place[hit]
                group, low = _split(sig[hit], groups)
                found = list(_by_group(group, groups))
                parts = [(owner[x], low[x], df[place[x]], np.full(len(x), -1), place[x]) for _, x in found]
                yield pa.RecordBatch.from_arrays(_packed([sl] * len(found), [g for g, _ in found], parts), _FOUND_NAMES)
    return run


def _deal(groups: int, heavy: np.ndarray):
    """Signatures of a slice but the heavy ones, packed by the group their hash belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sl, heads, sigs in zip(*(batch.column(c).to_pylist() for c in ("slice", "heads", "sigs"))):
                owner, sig = _entries(heads, sigs)
                if len(heavy):
                    light = ~np.isin(sig, heavy)
                    owner, sig = owner[light], sig[light]
                group, low = _split(sig, groups)
                found = list(_by_group(group, groups))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in found], pa.int64()), pa.array([sl] * len(found), pa.int64()), pa.array([steps(owner[x]) for _, x in found], pa.binary()),
                     pa.array([planes(low[x], SIGNATURE_BYTES) for _, x in found], pa.binary())],
                    ["g", "slice", "owners", "sigs"],
                )
    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one group, the signatures found twice or more, with their number and the last set that has them, by slice."""
    slices = table.column("slice").to_numpy()
    owners = [from_steps(o) for o in table.column("owners").to_pylist()]
    row = np.repeat(np.arange(len(slices), dtype=np.int32), [len(o) for o in owners])
    owner = np.concatenate(owners)
    sig = np.concatenate([from_planes(x, SIGNATURE_BYTES, np.uint64) for x in table.column("sigs").to_pylist()])
    order = np.argsort(sig, kind="stable")
    start = np.flatnonzero(np.diff(sig[order], prepend=~sig[order[0]]) != 0)
    df = np.diff(np.append(start, len(sig)))
    lead = np.repeat(order[start + df - 1], df)
    many = np.repeat(df, df)
    order, lead, df = order[many > 1], lead[many > 1], many[many > 1]
    back = np.argsort(order, kind="stable")
    at, lead, df = order[back], lead[back], df[back]
    used, begin = np.unique(row[at], return_index=True)
    parts = [(owner[at[a:b]], sig[at[a:b]], df[a:b], slices[row[lead[a:b]]], owner[lead[a:b]]) for a, b in zip(begin, np.append(begin[1:], len(at)))]
    return pa.Table.from_arrays(_packed(slices[used].tolist(), [table.column("g")[0].as_py()] * len(parts), parts), _FOUND_NAMES)


_ALLOCATED = "cls long, band long, n long, sigs array<long>, head array<long>, place array<int>"


def _allocated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes of each class and band that can have a partner: of e signatures the k + 1 rarest, without those not shared.

    head, place: slice and place of each probe's leading set.
    """
    for batch in batches:
        for heads, found in zip(*(batch.column(c).to_pylist() for c in ("heads", "found"))):
            h = np.frombuffer(heads, np.int64).reshape(-1, 5)
            owner = np.concatenate([from_steps(f["owners"]) for f in found])
            sig = np.concatenate([from_planes(f["sigs"], SIGNATURE_BYTES, np.uint64).astype(np.int64) + (f["g"] << 8 * SIGNATURE_BYTES) for f in found])
            df, head, place = (np.concatenate([from_planes(f[c], width, np.int64) for f in found]) for c, width in (("dfs", 6), ("heads", 8), ("places", 4)))
            order = np.lexsort((sig, df, owner))
            owner = owner[order]
            count = np.bincount(owner, minlength=len(h))
            nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            spare = h[:, 2] + 1 - (h[:, 3] - count)
            keep = nth < spare[owner]
            owner, order = owner[keep], order[keep]
            used, begin = np.unique(owner, return_index=True)
            cut = pa.array(np.append(begin, len(owner)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x[order])) for x in (sig, head, place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[used, 0], h[used, 1], h[used, 4])] + lists, [f.split()[0] for f in _ALLOCATED.split(", ")])


def _head_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sl, heads in zip(*(batch.column(c).to_pylist() for c in ("slice", "heads"))):
            cls = np.ascontiguousarray(np.frombuffer(heads, np.int64).reshape(-1, 5)[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), sl)), pa.array(np.arange(len(cls), dtype=np.int32)), pa.array(cls)], ["head", "place", "a"])


def exact_sets(data: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingles, named by numbers that stand for the very words.

    Texts of fewer than n words get a name of their own.
    """
    table = word_table(data, lower=True)
    name = table.codes()
    size = max(0, len(name) - n + 1)
    word, many = name.astype(np.int64), int(name.max(initial=0)) + 1
    run = word[:size]
    for j in range(1, n):
        run = pa.array(run * many + word[j : j + size]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return [np.unique(run[s : e - n + 1]) if e - s >= n else np.array([-1 - i]) for i, (s, e) in enumerate(zip(table.first[:-1].tolist(), table.first[1:].tolist()))]


def _vector(s: np.ndarray) -> np.ndarray:
    """A set's shingles hashed to bits, each bit the parity of its number; more bits for a larger band."""
    bits = 512
    while bits < 4096 and bits < 2 * band_top(len(s)):
        bits *= 2
    odd = np.bincount((mix(s + _C2) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


_CODEC = pa.Codec("zstd")


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, number of shingles, parity bits, bytes and compressed text."""
    for batch in batches:
        data = encoded(batch.column("text"))
        for a in range(0, len(data), 512):
            part = data[a : a + 512]
            sets = shingle_sets(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_vector(s) for s in sets], pa.list_(pa.int64())),
                 pa.array(list(map(len, part)), pa.int64()), pa.array([_CODEC.compress(t, asbytes=True) for t in part], pa.binary())],
                ["cls", "n", "v", "size", "text"],
            )


def _verify_block(table: pa.Table) -> pa.Table:
    rows = table.filter(table.column("text").is_valid())
    data = [_CODEC.decompress(t, n, asbytes=True) for t, n in zip(rows.column("text").to_pylist(), rows.column("b").to_pylist())]
    sets = dict(zip(rows.column("a").to_pylist(), exact_sets(data)))
    pairs = table.filter(table.column("text").is_null())
    a, b = [], []
    for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        p, q = sets[x], sets[y]
        if len(p) > len(q):
            p, q = q, p
        if 100 * len(p) < PERCENT * len(q):
            continue
        at = np.searchsorted(q, p)
        at[at == len(q)] = 0
        both = int((q[at] == p).sum())
        if 100 * both >= PERCENT * (len(p) + len(q) - both):
            a.append(x), b.append(y)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _near(x: str, y: str) -> Column:
    """Whether two sets (structs of n and v) may link: by size, and by their parity bits.

    Bits that differ are a lower bound of the shingles that only one set has,
    of which sets that link have (n + m) / 9 at most; only vectors of one length
    are compared.
    """
    n, m, v, w = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.v"), F.col(f"{y}.v")
    differ = F.aggregate(F.zip_with(v, w, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT) & ((F.size(v) != F.size(w)) | (differ * (100 + PERCENT) <= (n + m) * (100 - PERCENT)))


def verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that link.  pairs: distinct; texts: (cls, size, text compressed), sets: (cls, n, v, size), staged.

    A pair belongs to a block of its a, or to a part of it where very much text
    is compared with a; so a b that has one a is sent once.
    """
    known = lambda c: sets.select(F.col("cls").alias(c), F.struct("n", "v", "size").alias(f"{c}_"))
    pairs = staged(pairs.join(known("a"), "a").join(known("b"), "b").filter(_near("a_", "b_")).select("a", "b", F.col("b_.size").alias("size")), "pairs")
    blocks = max(1, int((sets.agg(F.sum("size")).first()[0] or 0) / BLOCK_BYTES) + 1)
    heavy = pairs.groupBy("a").agg(F.ceil(F.sum("size") / BLOCK_BYTES).alias("parts")).filter("parts > 1")
    part = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts")))
    placed = staged(pairs.join(heavy, "a", "left").select("a", "b", F.coalesce(part, F.pmod(F.xxhash64("a"), F.lit(blocks))).alias("block")), "placed")
    needed = staged(placed.select(F.col("a").alias("cls"), "block").unionByName(placed.select(F.col("b").alias("cls"), "block")).distinct(), "needed")
    held = _mapped(texts.select("cls", "size", "text"), needed.select("cls"), "cls")
    sent = needed.join(held, "cls").select("block", F.col("cls").alias("a"), F.col("size").alias("b"), "text")
    rows = placed.select("block", "a", "b", F.lit(None).cast("binary").alias("text")).unionByName(sent)
    links = staged(rows.groupBy("block").applyInArrow(_verify_block, "a long, b long"), "links")
    drop_staged(pairs, placed, needed)
    return links


def _mapped(texts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of texts whose key is in ids, and a few others: a bit map of MAP_WORDS words tells them apart."""
    hashed = F.xxhash64(key)
    word, bit = F.pmod(hashed, F.lit(MAP_WORDS)), F.shiftrightunsigned(hashed, 40).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    table = ids.select(word.alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    # At most MAP_WORDS rows of two numbers.
    return texts.join(F.broadcast(table), word == F.col("_word")).filter(F.col("_bits").bitwiseAND(one) != 0).select(*texts.columns)


class _Labels:
    """Component of every class that probes; its table has (cls, comp) of those whose component is not their own name."""

    def __init__(self):
        self.table: DataFrame | None = None

    def of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        if self.table is None:
            return rows.withColumn(name, F.col(column))
        moved = self.table.select(F.col("cls").alias(column), F.col("comp").alias("_comp"))
        return rows.join(moved, column, "left").withColumn(name, F.coalesce("_comp", column)).drop("_comp")

    def take(self, links: DataFrame) -> None:
        """Joins the components that links (a, b), staged, connect."""
        edges = self.of(self.of(links, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(edges).filter("node <> component")
        now = joined.select(F.col("node").alias("cls"), F.col("component").alias("comp"))
        if self.table is not None:
            now = self.table.join(joined, F.col("comp") == F.col("node"), "left").select("cls", F.coalesce("component", "comp").alias("comp")).unionByName(now)
        before, self.table = self.table, staged(now, "labels")
        drop_staged(links, *([before] if before is not None else []))


def link_components(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document.  docs: doc_id, text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    while True:
        schema = "doc_id array<long>, n array<long>, cls array<long>, cls2 array<long>, bad long, heads binary, sigs binary"
        profile = staged(texts.mapInArrow(_profiles(seed), schema).withColumn("slice", F.monotonically_increasing_id()), "profile")
        slim = staged(profile.select(F.inline(F.arrays_zip("doc_id", "n", "cls", "cls2"))), "classes")
        state = profile.agg(F.sum("bad").alias("bad"), F.sum(F.length("sigs")).alias("size")).first()
        clash = slim.groupBy("cls").agg(F.min("cls2").alias("a"), F.max("cls2").alias("b")).filter("a <> b").limit(1).count()
        if not state.bad and not clash:
            break
        drop_staged(profile, slim)
        seed += 1
    named = slim.filter("doc_id is not null")
    groups = max(1, -(-(state.size or 0) // (8 * SIGNATURES_PER_GROUP)))
    entries = profile.select("slice", "heads", "sigs").filter(F.length("heads") > 0)
    seen = entries.select("heads", "sigs").mapInArrow(_sampled, "sig long, cls long").groupBy("sig").agg(F.count(F.lit(1)).alias("df"), F.max("cls").alias("a"))
    most = seen.filter(F.col("df") * HEAVY_SAMPLE >= HEAVY).orderBy(F.desc("df"), "sig").limit(HEAVY_MOST).toArrow().sort_by("sig")
    heavy = most.column("sig").to_numpy()
    found = entries.mapInArrow(_deal(groups, heavy), "g long, slice long, owners binary, sigs binary").groupBy("g").applyInArrow(_shared, _FOUND)
    if len(heavy):
        found = found.unionByName(entries.mapInArrow(_marked(groups, heavy, most.column("df").to_numpy() * HEAVY_SAMPLE), _FOUND))
    found = found.groupBy("slice").agg(F.collect_list(F.struct("g", "owners", "sigs", "dfs", "heads", "places")).alias("found"))
    probes = found.join(entries.select("slice", "heads"), "slice").select("heads", "found").mapInArrow(_allocated, _ALLOCATED)
    # A class that several slices hold is there from each of them, alike.
    first = [F.first(c).alias(c) for c in ("n", "sigs", "head", "place")]
    probes = staged(probes.groupBy("cls", "band").agg(*first), "probes", "zstd")

    heads = probes.select("cls").distinct()
    picked = named.join(heads, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    chosen = _mapped(texts, picked, "doc_id").select("text").mapInArrow(_classed, "cls long, n long, v array<long>, size long, text binary").join(heads, "cls", "left_semi")
    first = [F.first(c).alias(c) for c in ("n", "v", "size", "text")]
    chosen = staged(chosen.groupBy("cls").agg(*first), "texts")
    sets = staged(chosen.select("cls", "n", "v", "size"), "sets")
    labels = _Labels()
    apart = lambda rows: labels.of(labels.of(rows, "a", "x"), "b", "y").filter("x <> y").select("a", "b")

    # Every set and the leading sets of its signatures.
    leads = entries.select("slice", "heads").mapInArrow(_head_rows, "head long, place int, a long")
    if len(heavy):
        leads = leads.unionByName(docs.sparkSession.createDataFrame(pa.table({"head": np.full(len(heavy), -1), "place": np.arange(len(heavy), dtype=np.int32), "a": most.column("a")})))
    meets = probes.select("cls", F.explode(F.array_distinct(F.arrays_zip("head", "place"))).alias("at")).select("cls", "at.head", "at.place")
    meets = staged(meets.join(leads, ["head", "place"]).filter("a <> cls").select("a", F.col("cls").alias("b")).distinct(), "meets")
    drop_staged(profile)
    labels.take(verified(meets, chosen, sets))

    # Signatures of several components, and all their sets.
    members = probes.select("cls", F.explode("sigs").alias("sig"))
    reach = labels.of(members, "cls", "comp").groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = staged(reach.filter("low < high").select("sig"), "mixed")
    split = staged(_mapped(members, mixed, "sig").join(mixed, "sig"), "split")
    turns = [F.max_by("cls", F.xxhash64("cls", F.lit(j))) for j in range(PIVOTS)]
    pivots = split.groupBy("sig").agg(F.array_distinct(F.array(*turns)).alias("pivots")).select("sig", F.explode("pivots").alias("a"))
    led = split.select("sig", F.col("cls").alias("b")).join(pivots, "sig").filter("a <> b").select("a", "b").distinct()
    led = staged(_untested(apart(led), meets), "led")
    labels.take(verified(led, chosen, sets))

    left = labels.of(split, "cls", "comp")
    mixed = staged(left.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("sig"), "mixed")
    left = staged(left.join(mixed, "sig").select("sig", "cls", "comp"), "left")
    whole = left.join(sets.select("cls", "n", "v"), "cls")
    across = whole.alias("x").join(whole.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") < F.col("y.comp")) & _near("x", "y"))
    across = across.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    labels.take(verified(_untested(across, meets.select("a", "b").unionByName(led)), chosen, sets))
    drop_staged(probes, chosen, sets, meets, mixed, split, led, left)

    rows = named.join(labels.table, "cls", "left").select("doc_id", "n", F.coalesce("comp", "cls").alias("comp"))
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    full = rows.filter("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = slim.filter("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = staged(full.unionByName(rest), "linked")
    drop_staged(slim, labels.table)
    return out


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """pairs (a, b) without those in tested, whichever way round."""
    tested = tested.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    return pairs.join(tested, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")
