"""Substring dedup by recompression.

Recompression rewrites every text level by level: runs of one word become one
symbol, then in each round neighbouring symbols whose names hash to "left" and
"right" become one pair symbol.  A symbol's name is a 64-bit hash of what it is
made of, so all tasks name alike without exchanging a dictionary, and equal
passages get equal symbols, but for a few at their edges.  For every window of
20 words the symbols fixed by the window alone are known exactly; its key is
made of all of them on the highest level that has one (of its words if none
has).  Equal windows have equal keys, and neighbouring windows mostly share one.

1. Every slice of documents sends its keys, each once.  Keys that occur once in
   the corpus prove that their windows do not repeat; a bit for each key comes
   back.
2. The other windows are sent as a hash of all their words, and the first place
   (doc_id, start) of each hash comes back to those who are not first.
3. Words covered by a window that is not its first place are removed.
4. Verification on the words: every stretch of removed windows is compared with
   the stretch it repeats, by a cryptographic digest of both texts.  If any
   differs, steps 2 to 4 run again under the next hash seed, so a collision of
   hashes never removes a word.

Slices are packed, compressed rows; what travels for a key is 5 bytes at most,
sorted and as differences, combined in its slice, so a passage that a third of
all documents share sends no more than a rare one.  Answers are bits and places,
never groups of documents.

Cases: null text has no words; texts under 20 words lose nothing; rows equal in
doc_id and text are one document and are treated alike; other rows that share
a doc_id come in a fixed order by text hash; a null doc_id comes last; an empty
table gives no rows; other columns are passed on only where asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.storage import drop_staged, quoted, small_batches, staged
from tessera.llm.textops import WHITE, Words, chunks, encoded, from_planes, from_steps, mix, planes, sequences, steps, word_table

WINDOW = 20
ROUNDS = 5
ENTRIES_PER_GROUP = 2_000_000
# Documents, and bytes of text, whose entries are combined before an exchange.
SLICE, SLICE_BYTES = 4096, 8_000_000
_G = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max
# Bytes of a key that are sent, besides the group it lies in: a filter's false match only costs a verification.
KEY_BYTES = 5
DIGEST_BYTES = 16


def window_starts(first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of all windows that lie in one text."""
    counts = np.maximum(np.diff(first) - (window - 1), 0)
    return np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def window_keys(h: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys, places): of each window its key and a number for the key's own place, ascending by text."""
    starts = window_starts(first, window)
    n = len(h)
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.int64)
    head = np.zeros(n, dtype=bool)
    head[first[:-1][np.diff(first) > 0]] = True
    # Runs.  A window fixes all runs but its first and last.
    new = head.copy()
    new[1:] |= h[1:] != h[:-1]
    index = np.cumsum(new, dtype=np.int32) - np.int32(1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    sym, head = h[at], head[at]
    many = length > 1
    sym[many] = mix(sym[many] * _G + length[many].astype(np.uint64))
    lo, hi = index[starts] + np.int32(1), index[starts + window - 1]
    levels = []
    for r in range(rounds):
        left = mix(sym + np.uint64((r + 1) * int(_G) % (1 << 64))) >> np.uint64(63) == 0
        # At its edges a window fixes a symbol only if that cannot pair outwards.
        some = lo < hi
        lo, hi = np.where(some, lo, 0), np.where(some, hi, 1)
        lo = lo + ~left[lo]
        hi = hi - left[hi - 1]
        some &= lo < hi
        pair = np.zeros(len(sym), dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~head[1:]
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = ~pair[:-1]
        index = np.cumsum(keep, dtype=np.int32) - np.int32(1)
        own = np.flatnonzero(keep)
        both = pair[own]
        joined = own[both]
        name = sym[own]
        name[both] = mix(mix(sym[joined]) * _G + sym[joined + 1] + np.uint64(r))
        at, head, sym = at[own], head[own], name
        lo = np.where(some, index[np.where(some, lo, 0)], 0)
        hi = np.where(some, index[np.where(some, hi, 1) - 1] + 1, 0)
        levels.append((sym, at, lo, hi))
    keys = np.zeros(len(starts), dtype=np.uint64)
    places = np.zeros(len(starts), dtype=np.int64)
    todo = np.arange(len(starts))
    for level in range(rounds, 0, -1):
        sym, at, lo, hi = levels[level - 1]
        a, b = lo[todo], hi[todo]
        has = a < b
        mine, a, b = todo[has], a[has], b[has]
        if len(mine):
            name = sym[a]
            for j in range(1, int((b - a).max())):
                more = a + j < b
                name[more] = mix(name[more] * _G + sym[a[more] + j])
            keys[mine] = name
            # Start word, number of symbols, level.
            places[mine] = at[a].astype(np.int64) * 256 + (b - a).astype(np.int64) * 8 + level
        todo = todo[~has]
    if len(todo):
        keys[todo] = sequences(h, window)[starts[todo]]
        places[todo] = starts[todo].astype(np.int64) * 256
    return starts, keys, places


def _blob(parts: list[bytes]) -> bytes:
    raw = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _parts(blob: bytes) -> list[bytes]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], np.int64))])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _one_row(column) -> pa.Array:
    """All values of a column as the one list of one row."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _in_slices(carry: list[str]):
    """One row per slice: the carried columns as lists, doc_ids and rids as numbers, texts as a blob."""

    def full(batches: list[pa.RecordBatch], texts: list[bytes]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        docs = [pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("doc_id", "rid")]
        return pa.RecordBatch.from_arrays([*[_one_row(table.column(c)) for c in carry], *docs, pa.array([_blob(texts)], pa.binary())], [*carry, "docs", "rids", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for batch in batches:
            data = encoded(batch.column("text"))
            for a, b in chunks(data, SLICE_BYTES, SLICE):
                more = sum(map(len, data[a:b]))
                if held and (size + more > SLICE_BYTES or len(texts) + b - a > SLICE):
                    yield full(held, texts)
                    held, texts, size = [], [], 0
                held.append(batch.slice(a, b - a))
                texts += data[a:b]
                size += more
        if held:
            yield full(held, texts)
    return run


def _by_group(key: np.ndarray, groups: int, *order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its keys in the given order)."""
    group = (key % np.uint64(groups)).astype(np.int64)
    at = np.lexsort((*order, group))
    cut = np.searchsorted(group[at], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cut)).tolist():
        yield g, at[cut[g] : cut[g + 1]]


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns))


def _slice_keys(data: list[bytes]) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk of texts: range of texts, words, windows' starts, their keys, and the number of each window's key place."""
    for a, b in chunks(data):
        table = word_table(data[a:b])
        starts, key, place = window_keys(table.hashes(), table.first)
        _, one, back = np.unique(place, return_index=True, return_inverse=True)
        yield a, b, table, starts, key[one], back


def _key_rows(groups: int):
    """A slice's distinct keys by group: sorted, in differences, with a bit for those it has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sl, texts in _rows(batch, "slice", "texts"):
                keys = [key for *_, key, _ in _slice_keys(_parts(texts))]
                key, many = np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64), return_counts=True)
                out = []
                for g, at in _by_group(key, groups, key):
                    low = key[at] // np.uint64(groups) & _LOW
                    order = np.argsort(low, kind="stable")
                    out.append((g, sl, planes(np.diff(low[order], prepend=np.uint64(0)), KEY_BYTES), np.packbits(many[at][order] > 1).tobytes()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, ["g", "slice", "keys", "many"])
    return run


def _key_answers(table: pa.Table) -> pa.Table:
    """Of one group: a bit for each sent key, set where it is shared."""
    lows = [np.cumsum(from_planes(k, KEY_BYTES, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    twice = [_bits(m, len(k)) for m, k in zip(table.column("many").to_pylist(), lows)]
    _, back, many = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
    shared = (many > 1)[back]
    cut = np.cumsum([0, *map(len, lows)])
    bits = [np.packbits(shared[a:b] | t).tobytes() for a, b, t in zip(cut[:-1], cut[1:], twice)]
    return pa.table({"slice": table.column("slice"), "g": table.column("g"), "bits": pa.array(bits, pa.binary())})


_LOW = np.uint64((1 << 8 * KEY_BYTES) - 1)


def _joined_words(table: Words, i: int, kept: np.ndarray | None = None) -> bytes:
    """Text i's words, or those of `kept` (a mask over all words), with one space between."""
    a, b = int(table.first[i]), int(table.first[i + 1])
    raw = table.buf
    at = range(a, b) if kept is None else (np.flatnonzero(kept[a:b]) + a).tolist()
    start, end = table.start, table.end
    return b" ".join([raw[start[w] : end[w]].tobytes() for w in at]) if kept is not None else b" ".join(raw[table.at[i] : table.at[i + 1]].tobytes().translate(_SPACES).split())


_SPACES = bytes(0x20 if i in (0x20, *range(0x09, 0x0E)) else i for i in range(256))


def _finish(words: bytes, digest: bool):
    return hashlib.sha256(words).hexdigest() if digest else words.decode()


def _candidates(carry: list[str], digest: bool, groups: int):
    """Per slice: documents in which no window can repeat, finished; and the others with their open windows as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (sl, docs, rids, texts, answers) in enumerate(_rows(batch, "slice", "docs", "rids", "texts", "answers")):
                docs, rids, data = np.frombuffer(docs, np.int64), np.frombuffer(rids, np.int64), _parts(texts)
                parts = list(_slice_keys(data))
                keys = [key for *_, key, _ in parts]
                key = np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64))
                shared = np.zeros(len(key), dtype=bool)
                bits = {x["g"]: x["bits"] for x in answers or ()}
                for g, at in _by_group(key, groups, key):
                    order = np.argsort(key[at] // np.uint64(groups) & _LOW, kind="stable")
                    shared[at[order]] = _bits(bits[g], len(at))
                n_words, done, kept, opened = np.zeros(len(data), dtype=np.int64), [], [], []
                for a, b, table, starts, own, back in parts:
                    mask = np.zeros(len(table.start) + 1, dtype=bool)
                    if len(starts):
                        mask[starts[shared[np.searchsorted(key, own)][back]]] = True
                    n_words[a:b] = table.counts()
                    for j in range(b - a):
                        m = mask[table.first[j] : table.first[j + 1]]
                        if m.any():
                            opened.append((a + j, np.packbits(m).tobytes()))
                        else:
                            done.append(a + j)
                            kept.append(_finish(_joined_words(table, j), digest))
                left, go = pa.array(done, pa.int64()), pa.array([k for k, _ in opened], pa.int64())
                lists = [batch.column(c)[i].values for c in carry]
                row = [pa.array([sl], pa.int64())]
                row += [_one_row(x.take(left)) for x in lists] + [_one_row(pa.array(x)) for x in (docs[done], n_words[done])] + [_one_row(pa.array(kept, pa.string()))]
                row += [_one_row(x.take(go)) for x in lists] + [pa.array([x], pa.binary()) for x in (
                    docs[go].tobytes(), rids[go].tobytes(), _blob([data[k] for k, _ in opened]), _blob([m for _, m in opened]))]
                row.append(pa.array([sum(int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) for _, m in opened)], pa.int64()))
                yield pa.RecordBatch.from_arrays(row, ["slice", *[f"d{c}" for c in carry], "ddoc_id", "dn_words", "dkept", *[f"o{c}" for c in carry], "docs", "rids", "texts", "bits", "open"])
    return run


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _open_windows(data: list[bytes], bits: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start) of each open window, in order of texts and starts."""
    keys, owners, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in chunks(data):
        table = word_table(data[a:b])
        counts = table.counts()
        at = np.flatnonzero(np.concatenate([_bits(bits[a + i], int(n)) for i, n in enumerate(counts)]))
        owner = np.repeat(np.arange(b - a), counts)[at]
        keys.append(sequences(table.hashes(seed), WINDOW)[at]), owners.append(owner + a), places.append(at - table.first[owner])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)


def _firsts(key: np.ndarray, doc: np.ndarray, rid: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of each distinct key the entry first by (doc, rid, place), each entry's key's number); keys ascending."""
    order = np.lexsort((place, rid, doc, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.empty(0, bool)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


_SENT = "g long, slice long, docs binary, owners binary, places binary, keys binary"


def _sent(key: np.ndarray, owner: np.ndarray, place: np.ndarray, docs: np.ndarray, rids: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, the first places of its hashes), in the order in which they are sent."""
    first, _ = _firsts(key, docs[owner], rids[owner], place)
    for g, at in _by_group(key[first], groups, place[first], owner[first]):
        yield g, first[at]


def _window_rows(groups: int, seed: int):
    """A slice's open windows by group, each hash once, with its first place in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sl, docs, rids, texts, bits in _rows(batch, "slice", "docs", "rids", "texts", "bits"):
                docs, rids = np.frombuffer(docs, np.int64), np.frombuffer(rids, np.int64)
                key, owner, place = _open_windows(_parts(texts), _parts(bits), seed)
                out = []
                for g, at in _sent(key, owner, place, docs, rids, groups):
                    used = np.unique(owner[at])
                    named = np.stack([docs[used], rids[used], used], axis=1).tobytes()
                    out.append((g, sl, named, steps(owner[at]), steps(place[at]), planes(key[at] // np.uint64(groups), 8)))
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], [f.split()[0] for f in _SENT.split(", ")])
    return run


def _window_answers(table: pa.Table) -> pa.Table:
    """Of one group: for each sent hash whether its first place is elsewhere, and where (slice, text, start)."""
    slices = table.column("slice").to_numpy()
    owners = [from_steps(x).astype(np.int64) for x in table.column("owners").to_pylist()]
    place = np.concatenate([from_steps(x) for x in table.column("places").to_pylist()]).astype(np.int64)
    key = np.concatenate([from_planes(x, 8, np.uint64) for x in table.column("keys").to_pylist()])
    named = []
    for blob, owner in zip(table.column("docs").to_pylist(), owners):
        docs = np.frombuffer(blob, np.int64).reshape(-1, 3)
        named.append(docs[np.searchsorted(docs[:, 2], owner)])
    named = np.concatenate(named)
    row = np.repeat(np.arange(len(slices)), [len(o) for o in owners])
    first, number = _firsts(key, named[:, 0], named[:, 1], place)
    source = first[number]
    # Equal rows are one document: its windows are first wherever it lies.
    away = (named[source, 0] != named[:, 0]) | (named[source, 1] != named[:, 1]) | (place[source] != place)
    cut = np.cumsum([0, *map(len, owners)])
    out = []
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        far = source[a:b][away[a:b]]
        wide = lambda x, width: planes(x.astype(np.int64), width)
        out.append((np.packbits(away[a:b]).tobytes(), wide(slices[row[far]], 8), wide(named[far, 2], 4), wide(place[far], 4)))
    bits, held, texts, starts = (pa.array(c, pa.binary()) for c in zip(*out))
    return pa.table({"slice": table.column("slice"), "g": table.column("g"), "away": bits, "slices": held, "texts": texts, "starts": starts})


_ANSWERS = "slice long, g long, away binary, slices binary, texts binary, starts binary"
_REQUEST = {"rslice": pa.int64(), "rtext": pa.int64(), "rstart": pa.int64(), "rlength": pa.int64(), "rdigest": pa.binary()}


def _stretch(table: Words, a: int, b: int) -> bytes:
    """A digest of words a..b-1: of their lengths and their bytes."""
    h = hashlib.blake2b((table.end[a:b] - table.start[a:b]).astype(np.int64).tobytes(), digest_size=DIGEST_BYTES)
    raw = table.buf[table.start[a] : table.end[b - 1]]
    h.update(raw[~WHITE[raw]].tobytes())
    return h.digest()


def _resolve(carry: list[str], digest: bool, groups: int, seed: int):
    """Per slice: its documents without repeated windows' words, and for each stretch of such windows the stretch it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (sl, docs, rids, texts, bits, answers) in enumerate(_rows(batch, "slice", "docs", "rids", "texts", "bits", "answers")):
                docs, rids, data = np.frombuffer(docs, np.int64), np.frombuffer(rids, np.int64), _parts(texts)
                key, owner, place = _open_windows(data, _parts(bits), seed)
                first, number = _firsts(key, docs[owner], rids[owner], place)
                # Where each hash is first: slice, text, start; here unless an answer says otherwise.
                source = np.stack([np.full(len(first), sl, dtype=np.int64), owner[first], place[first]], axis=1)
                answer = {x["g"]: x for x in answers or ()}
                again = (docs[owner] != docs[owner[first[number]]]) | (rids[owner] != rids[owner[first[number]]]) | (place != place[first[number]])
                for g, at in _sent(key, owner, place, docs, rids, groups):
                    x = answer[g]
                    far = number[at[_bits(x["away"], len(at))]]
                    source[far] = np.stack([from_planes(x["slices"], 8, np.int64), from_planes(x["texts"], 4, np.int64), from_planes(x["starts"], 4, np.int64)], axis=1)
                    mine = np.zeros(len(first), dtype=bool)
                    mine[far] = True
                    again |= mine[number]
                at = np.flatnonzero(again)
                to = source[number[at]]
                # A stretch: windows that follow each other and repeat windows that follow each other.
                new = np.ones(len(at), dtype=bool)
                if len(at):
                    new[1:] = (np.diff(owner[at]) != 0) | (np.diff(place[at]) != 1) | (np.diff(to[:, 0]) != 0) | (np.diff(to[:, 1]) != 0) | (np.diff(to[:, 2]) != 1)
                begin = np.flatnonzero(new)
                length = np.diff(np.append(begin, len(at))) + WINDOW - 1
                stretches = np.searchsorted(owner[at][begin], np.arange(len(data) + 1))
                windows = np.searchsorted(owner[at], np.arange(len(data) + 1))
                n_words, removed, kept, asked = [], [], [], []
                for a, b in chunks(data):
                    table = word_table(data[a:b])
                    step = np.zeros(len(table.start) + WINDOW + 1, dtype=np.int32)
                    w = slice(windows[a], windows[b])
                    p = place[at[w]] + table.first[owner[at[w]] - a]
                    step[p] += 1
                    step[p + WINDOW] -= 1
                    keep = np.cumsum(step)[: len(table.start)] == 0
                    for k in range(stretches[a], stretches[b]):
                        s = int(place[at[begin[k]]] + table.first[owner[at[begin[k]]] - a])
                        asked.append((*to[begin[k]].tolist(), int(length[k]), _stretch(table, s, s + int(length[k]))))
                    for j in range(b - a):
                        own = keep[table.first[j] : table.first[j + 1]]
                        n_words.append(len(own)), removed.append(len(own) - int(own.sum()))
                        kept.append(_finish(_joined_words(table, j, None if own.all() else keep), digest))
                asked = list(dict.fromkeys(asked))
                row = [_one_row(batch.column(f"o{c}")[i].values) for c in carry]
                row += [_one_row(pa.array(docs)), *[_one_row(pa.array(x, pa.int64())) for x in (n_words, removed)], _one_row(pa.array(kept, pa.string()))]
                row += [_one_row(pa.array(c, t)) for c, t in zip(zip(*asked) if asked else [[]] * 5, _REQUEST.values())]
                yield pa.RecordBatch.from_arrays(row, [*[f"d{c}" for c in carry], "ddoc_id", "dn_words", "dn_removed", "dkept", *_REQUEST])
    return run


def _unequal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of asked stretches whose words are others here."""
    for batch in batches:
        wrong = 0
        for texts, asked in _rows(batch, "texts", "asked"):
            data = _parts(texts)
            by: dict[int, list] = {}
            for x in asked:
                by.setdefault(x["rtext"], []).append(x)
            for t, own in by.items():
                table = word_table([data[t]])
                wrong += sum(_stretch(table, x["rstart"], x["rstart"] + x["rlength"]) != x["rdigest"] for x in own)
        yield pa.RecordBatch.from_arrays([pa.array([wrong], pa.int64())], ["wrong"])


def _unpacked(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per document from lists; names: list column by result column."""
    zipped = rows.select(F.inline(F.arrays_zip(*names.values())))
    return zipped.select(*[F.col(a).alias(n) for n, a in names.items()])


def dedup(docs: DataFrame, carry: list[str] = (), digest: bool = False) -> DataFrame:
    """One row a document: the columns of carry, doc_id, n_words, n_removed, kept.

    docs: doc_id, text.  kept is the kept words joined by one space, or with
    digest their SHA-256 in lowercase hex.  carry must not hold doc_id, text or
    the names of new columns.
    """
    small_batches(docs.sparkSession)
    own = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(*[quoted(c).alias(a) for c, a in zip(carry, own)], F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    kinds = {a: T.ArrayType(rows.schema[a].dataType) for a in own}
    number, binary, text = T.ArrayType(T.LongType()), T.BinaryType(), T.ArrayType(T.StringType())
    schema = lambda **fields: T.StructType([T.StructField(n, t) for n, t in fields.items()])
    lists = lambda mark: {f"{mark}{a}": t for a, t in kinds.items()}
    slices = rows.mapInArrow(_in_slices(own), schema(**kinds, docs=binary, rids=binary, texts=binary))
    slices = staged(slices.withColumn("slice", F.monotonically_increasing_id()), "slices")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # A word and its space are 6 characters or so, and a key serves some 2 windows.
    groups = max(1, -(-size // (6 * 2 * ENTRIES_PER_GROUP)))
    keys = slices.select("slice", "texts").mapInArrow(_key_rows(groups), "g long, slice long, keys binary, many binary")
    answers = keys.groupBy("g").applyInArrow(_key_answers, "slice long, g long, bits binary")
    answers = staged(answers.groupBy("slice").agg(F.collect_list(F.struct("g", "bits")).alias("answers")), "answers")
    done = dict(ddoc_id=number, dn_words=number, dkept=text)
    table = slices.join(answers, "slice", "left").select("slice", *own, "docs", "rids", "texts", "answers")
    table = table.mapInArrow(_candidates(own, digest, groups), schema(slice=T.LongType(), **lists("d"), **done, **lists("o"), docs=binary, rids=binary, texts=binary, bits=binary, open=T.LongType()))
    table = staged(table, "windows")
    drop_staged(slices, answers)
    opened = table.filter(F.length("docs") > 0)
    groups = max(1, -(-(opened.agg(F.sum("open").alias("n")).first().n or 0) // ENTRIES_PER_GROUP))
    asked = {c: T.ArrayType(T.BinaryType() if c == "rdigest" else T.LongType()) for c in _REQUEST}
    seed = 0
    while True:
        sent = opened.select("slice", "docs", "rids", "texts", "bits").mapInArrow(_window_rows(groups, seed), _SENT)
        answers = sent.groupBy("g").applyInArrow(_window_answers, _ANSWERS)
        answers = staged(answers.groupBy("slice").agg(F.collect_list(F.struct("g", "away", "slices", "texts", "starts")).alias("answers")), "answers")
        found = opened.join(answers, "slice", "left").select("slice", *[f"o{a}" for a in own], "docs", "rids", "texts", "bits", "answers")
        found = staged(found.mapInArrow(_resolve(own, digest, groups, seed), schema(**lists("d"), ddoc_id=number, dn_words=number, dn_removed=number, dkept=text, **asked)), "resolved")
        requests = _unpacked(found, {c: c for c in _REQUEST}).distinct()
        requests = staged(requests.groupBy(F.col("rslice").alias("slice")).agg(F.collect_list(F.struct("rtext", "rstart", "rlength", "rdigest")).alias("asked")), "requests")
        wrong = requests.join(opened.select("slice", "texts"), "slice").select("texts", "asked").mapInArrow(_unequal, "wrong long").agg(F.sum("wrong").alias("n")).first().n
        drop_staged(answers, requests)
        if not wrong:
            break
        drop_staged(found)
        seed += 1
    names = {**{c: f"d{a}" for c, a in zip(carry, own)}, "doc_id": "ddoc_id", "n_words": "dn_words", "n_removed": "dn_removed", "kept": "dkept"}
    resolved = _unpacked(found, names)
    finished = _unpacked(table, {c: a for c, a in names.items() if c != "n_removed"}).withColumn("n_removed", F.lit(0).cast("long")).select(*[quoted(c) for c in names])
    return finished.unionByName(resolved).withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))
