"""Substring dedup by super-k-mer partitioning.

A window is WIDTH consecutive words.  Its minimiser is the least hash among its word GRAM-grams; consecutive
windows with one minimiser travel as one packed string, a super-k-mer, to the bucket of that minimiser.
All copies of a window meet there; sorting the bucket's windows counts them exactly (words are compared, not
hashes) and gives each the smallest doc_id that has it.  A word is removed if a window that covers it also
starts in a document with a smaller id.

Buckets share bins, and a task's super-k-mers for one bin leave as one zstd block in text order: the windows
overlap and would be several times the corpus as plain rows.  The number of bins follows from the measured
bytes of text, BIN_BYTES to a bin, so what a task unpacks at once doesn't grow with the data; within a bin
buckets are judged SLICE_BYTES at a time.  Words, windows and places are numpy and Arrow buffers throughout.

Hot passages: a super-k-mer that a task finds more than FEW times in a batch of texts is sent once, and its
places are parked in rows of their own that are dealt out evenly and joined with the verdict afterwards.
The places of one batch of texts then meet again, and what they remove of a text in a row is one run.
Hot minimisers (estimated on every 32nd document; placement alone depends on that, never the result) give
way to the hash of the whole window, so their windows are spread.  They are marked in a bitmap of fixed size
by a hash, so any number of them fits; another minimiser of the same bit is spread as well, for nothing.
Grams of few distinct words rank last.

Nulls: a null text has no words.  A row without an id is neither smaller nor larger than another: nothing
of it is removed, nor is anything removed on its account.  Repeated rows get equal results.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from terrane.llm.common import forget, settle, table, thin_filter

WIDTH, GRAM = 13, 3
#: Places that travel along with a super-k-mer, and windows of one super-k-mer.
FEW, LONGEST = 4, 256
#: Windows of parked places that are looked at at once, and runs there that are held to be joined.
SPREAD, RUNS = 1 << 18, 1 << 19
#: Bytes of text that are cut into words at once, words that are hashed at once, bytes of super-k-mers in a batch.
PIECE_BYTES, PIECE_WORDS, BATCH_BYTES = 1 << 19, 1 << 17, 16 << 20
#: Bytes of text to a bin, and of super-k-mers that are judged at once.
BIN_BYTES, SLICE_BYTES = 2 << 20, 4 << 20
#: Documents sampled to find hot minimisers, and the least count there.
EVERY, HOT_LEAST = 32, 48
#: Bits of the bitmap of hot minimisers.
HOT_BITS = 1 << 24
PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("pos", "<i4")])
MANY = np.dtype([("ref", "V24"), ("lo", "<i8"), ("hi", "<i8")])
BLOCK, PARKED = 0, 1
PACKED = "bin int, kind int, ref binary, blob binary"
FOUND = "kind int, tag long, ref binary, doc long, start int, n int, blob binary"
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PRIME, FINGERPRINT = np.uint64(0x100000001B3), np.uint64(0xD1342543DE82EF95)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _cumulated(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums of counts."""
    return np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(counts, dtype=np.int64)))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on, count[0] of them, then those of start[1]."""
    ends = _cumulated(count)
    return np.repeat(start - ends[:-1], count) + np.arange(ends[-1])


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of data, one up to each of ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and where each value ends, after a 0."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words with a space after each, where each starts, where the last ends, whose it is, and its place there."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    kept = ~space
    kept[1:] |= space[1:] & ~space[:-1]  # the first white space after a word
    buffer = np.where(space, np.uint8(32), raw)[kept]
    starts = np.concatenate(([0], np.flatnonzero(buffer == 32) + 1))
    limits = np.cumsum([len(t) + 1 for t in texts])
    whose = np.searchsorted(limits, begins, side="right")
    first = np.searchsorted(whose, np.arange(len(texts)))
    return buffer, starts, whose, np.arange(len(whose)) - first[whose]


def word_hashes(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word: the words' polynomials, mixed."""
    begin, size = starts[:-1], np.diff(starts)
    inside = _ranges(np.zeros(len(size), dtype=np.int64), size)
    powers = np.cumprod(np.full(int(size.max(initial=1)), PRIME))
    terms = (buffer[starts[0] : starts[-1]].astype(np.uint64) + np.uint64(1)) * powers[inside]
    return _mixed(np.add.reduceat(terms, begin - starts[0]))


def minimisers(h: np.ndarray) -> np.ndarray:
    """The minimiser of each window from the hashes of the words: a function of the window's words alone."""
    n = len(h) - GRAM + 1
    gram, distinct = h[:n], np.ones(n, dtype=np.int8)
    for k in range(1, GRAM):
        gram = gram * PRIME + h[k : n + k]
        new = np.ones(n, dtype=bool)
        for j in range(k):
            new &= h[j : n + j] != h[k : n + k]
        distinct += new
    gram = (_mixed(gram) >> np.uint64(1)) | ((distinct < GRAM - 1).astype(np.uint64) << np.uint64(63))
    span, least = 1, gram
    width = WIDTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (width - span)], least[width - span :]) if span < width else least


def _window_hashes(h: np.ndarray) -> np.ndarray:
    n = len(h) - WIDTH + 1
    out = h[:n]
    for k in range(1, WIDTH):
        out = out * PRIME + h[k : n + k]
    return _mixed(out)


def _slot(bucket: np.ndarray) -> np.ndarray:
    """A minimiser's bit in the bitmap of hot ones."""
    return (_mixed(bucket.view(np.uint64)) % np.uint64(HOT_BITS)).astype(np.int64)


def super_kmers(h: np.ndarray, whose: np.ndarray, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and bucket of each super-k-mer of texts' words, whose hashes are h; no window spans two texts."""
    if len(h) < WIDTH:
        return (np.zeros(0, dtype=np.int64),) * 3
    least = minimisers(h).view(np.int64)
    valid = np.flatnonzero(whose[: len(least)] == whose[WIDTH - 1 :])
    if not len(valid):
        return (np.zeros(0, dtype=np.int64),) * 3
    if hot is not None:
        slot = _slot(least)
        is_hot = (hot[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
        if is_hot.any():
            least = np.where(is_hot, _window_hashes(h).view(np.int64), least)
    bucket = least[valid]
    cut = np.flatnonzero((np.diff(valid) != 1) | (bucket[1:] != bucket[:-1])) + 1
    at = np.concatenate(([0], cut))
    start, count = valid[at], np.diff(np.concatenate((at, [len(valid)])))
    bucket = bucket[at]
    if count.max() > LONGEST:
        parts = -(-count // LONGEST)
        inside = _ranges(np.zeros(len(parts), dtype=np.int64), parts)
        end = np.repeat(start + count, parts)
        start, bucket = np.repeat(start, parts) + inside * LONGEST, np.repeat(bucket, parts)
        count = np.minimum(end - start, LONGEST)
    return start, count, bucket


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """cut_words() in pieces of PIECE_WORDS words; a piece starts WIDTH - 1 words before the last one's end."""
    buffer, starts, whose, place = cut_words(texts)
    for at in range(0, max(0, len(whose) - WIDTH + 1), PIECE_WORDS):
        to = min(len(whose), at + PIECE_WORDS + WIDTH - 1)
        yield buffer, starts[at : to + 1], whose[at:to], place[at:to]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, PIECE_BYTES at a time, and the row of the first."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE_BYTES, side="right")))
        yield at, batch.column("text").slice(at, to - at).to_pylist()
        at = to


def _block(compress, kmers: tuple[np.ndarray, np.ndarray], bucket: np.ndarray, held: np.ndarray, places: np.ndarray, many: np.ndarray) -> bytes:
    """Super-k-mers with their buckets and places, compressed; many instead of places where held is 0."""
    data, ends = kmers
    parts = [
        np.array([len(held), len(places), len(many)], dtype="<u4"),
        held.astype("<u4"),
        (bucket & 0xFFFFFFFF).astype("<u4"),
        np.diff(ends).astype("<u4"),
        *(np.diff(places[c], prepend=places[c].dtype.type(0)) for c in PLACE.names),
        many,
        data,
    ]
    return compress(b"".join(x.tobytes() for x in parts))


def _unblock(raw: bytes) -> tuple[np.ndarray, ...]:
    """What _block packed: held, buckets, sizes, places, many and the super-k-mers' bytes."""
    n, n_places, n_many = np.frombuffer(raw, "<u4", 3).tolist()
    at = 12

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    held, buckets, sizes = take("<u4", n), take("<u4", n), take("<u4", n)
    places = np.empty(n_places, dtype=PLACE)
    for c in PLACE.names:
        places[c] = np.cumsum(take(PLACE[c].str, n_places), dtype=PLACE[c])
    return held, buckets, sizes, places, take(MANY, n_many), np.frombuffer(raw, np.uint8, offset=at)


def _packer(hot, bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor().compress
        waiting: list[tuple] = []
        volume = 0

        def flush() -> pa.RecordBatch:
            encoded = pa.chunked_array([w[0] for w in waiting]).combine_chunks().dictionary_encode()
            code, distinct = encoded.indices.to_numpy(), encoded.dictionary
            places = np.empty(len(code), dtype=PLACE)
            for k, c in enumerate(PLACE.names):
                places[c] = np.concatenate([w[2 + k] for w in waiting])
            here = hashlib.blake2b(places[0].tobytes() + places[-1].tobytes(), digest_size=8).digest()
            bucket = np.empty(len(distinct), dtype=np.int64)
            bucket[code] = np.concatenate([w[1] for w in waiting])
            held = np.bincount(code, minlength=len(distinct))
            bin_of = (bucket >> 32) % bins
            order = np.argsort(bin_of, kind="stable")  # super-k-mers by bin, in text order
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            places = places[np.argsort(rank[code], kind="stable")]
            bin_of, bucket, held = bin_of[order], bucket[order], held[order]
            data, ends = _bytes_of(distinct.take(pa.array(order)))
            at, parked = _cumulated(held), held > FEW
            many, out = np.empty(int(parked.sum()), dtype=MANY), []
            for k, i in enumerate(np.flatnonzero(parked).tolist()):
                own = places[at[i] : at[i + 1]]
                ref = here + hashlib.blake2b(data[ends[i] : ends[i + 1]].tobytes() + own[0].tobytes(), digest_size=16).digest()
                many[k] = (np.void(ref), own["doc"].min(), own["doc"].max())
                out += [((int.from_bytes(ref[8:12], "little") + s) % bins, PARKED, ref, own[s : s + 64].tobytes()) for s in range(0, len(own), 64)]
            held = np.where(parked, 0, held)
            places = places[np.repeat(~parked, np.diff(at))]
            at, nth = _cumulated(held), _cumulated(parked)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bin_of)) + 1, [len(bin_of)])).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                kmers = data[ends[a] : ends[b]], ends[a : b + 1]
                out.append((int(bin_of[a]), BLOCK, None, _block(compress, kmers, bucket[a:b], held[a:b], places[at[a] : at[b]], many[nth[a] : nth[b]])))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bin", "kind", "ref", "blob"])

        for batch in batches:
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            for row, texts in _groups(batch):
                for buffer, starts, whose, place in _pieces(texts):
                    first, count, bucket = super_kmers(word_hashes(buffer, starts), whose, hot and hot.value)
                    if not len(first):
                        continue
                    begin, size = starts[first], starts[first + count + WIDTH - 1] - starts[first]
                    kmers = _binary(buffer[_ranges(begin, size)], _cumulated(size))
                    waiting.append((kmers, bucket, ids[row + whose[first]], tags[row + whose[first]], place[first]))
                    volume += int(size.sum())
                    if volume >= BATCH_BYTES:
                        yield flush()
                        waiting.clear()
                        volume = 0
                        pa.default_memory_pool().release_unused()
        if waiting:
            yield flush()

    return pack


def _hot_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): documents with a minimiser of the slot."""
    for batch in batches:
        found = [np.zeros(0, dtype=np.int64)]
        for _, texts in _groups(batch):
            for buffer, starts, whose, _ in _pieces(texts):
                first, _, bucket = super_kmers(word_hashes(buffer, starts), whose, None)
                found.append(np.unique(_slot(bucket) * len(texts) + whose[first]) // len(texts))
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["slot", "n"])


def _runs(places: np.ndarray, of: np.ndarray, first: np.ndarray, count: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of removed windows: places[i] has the windows least[first[of[i]]:][:count[of[i]]]; (doc, tag, start, words) of each run."""
    n = count[of]
    which = np.repeat(np.arange(len(of)), n)
    inside = _ranges(np.zeros(len(of), dtype=np.int64), n)
    gone = least[np.repeat(first[of], n) + inside] < places["doc"][which]
    which, inside = which[gone], inside[gone]
    new = np.ones(len(which), dtype=bool)
    new[1:] = (which[1:] != which[:-1]) | (inside[1:] != inside[:-1] + 1)
    at = np.flatnonzero(new)
    words = np.diff(np.concatenate((at, [len(which)]))) + WIDTH - 1
    who = which[at]
    return places["doc"][who], places["tag"][who], (places["pos"][who] + inside[at]).astype(np.int32), words.astype(np.int32)


def _found(kind: int, size: int, **columns) -> pa.RecordBatch:
    kinds = {"tag": pa.int64(), "ref": pa.binary(), "doc": pa.int64(), "start": pa.int32(), "n": pa.int32(), "blob": pa.binary()}
    arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *arrays], names=["kind", *kinds])


def _sorted_windows(word: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal windows together, and which of them are the first of their kind.

    Windows are sorted by a fingerprint of their words; neighbours with one fingerprint are compared word by
    word, and if two differ all are sorted by their words.
    """
    same_words = lambda a, b: np.logical_and.reduce([word[a + k] == word[b + k] for k in range(WIDTH)])
    mark = word[begin].astype(np.uint64)
    for k in range(1, WIDTH):
        mark = mark * FINGERPRINT + word[begin + k].astype(np.uint64)
    mark = _mixed(mark)
    order = np.argsort(mark)
    alike = np.flatnonzero(mark[order][1:] == mark[order][:-1])
    equal = same_words(begin[order[alike]], begin[order[alike + 1]])
    if not equal.all():
        order = np.lexsort([word[begin + k] for k in range(WIDTH)])
        alike = np.arange(len(order) - 1)
        equal = same_words(begin[order[:-1]], begin[order[1:]])
    new = np.ones(len(order), dtype=bool)
    new[alike[equal] + 1] = False
    return order, new


def _judged(data: np.ndarray, size: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of super-k-mers that hold all copies of their windows: where the windows of each start, how many, and the least id of each window."""
    ends = np.concatenate(([0], np.flatnonzero(data == 32) + 1))
    word = _binary(data, ends).dictionary_encode().indices.to_numpy()
    words = np.diff(np.searchsorted(ends, _cumulated(size)))
    count = words - (WIDTH - 1)
    begin, owner = _ranges(_cumulated(words)[:-1], count), np.repeat(np.arange(len(count)), count)
    order, new = _sorted_windows(word, begin)
    heads = np.flatnonzero(new)
    least = np.empty(len(order), dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(lo[owner[order]], heads), np.diff(np.concatenate((heads, [len(order)]))))
    return _cumulated(count)[:-1], count, least


def _resolve(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
    """All blocks of a bin: removed runs (kind 0) and verdicts (1)."""
    held, buckets, size, places, many, data = (np.concatenate(x) for x in zip(*map(_unblock, blocks), strict=True))
    held, size, parked = held.astype(np.int64), size.astype(np.int64), held == 0
    lo, hi = np.empty(len(held), dtype=np.int64), np.empty(len(held), dtype=np.int64)
    lo[parked], hi[parked] = many["lo"], many["hi"]
    at, offset, nth = _cumulated(held), _cumulated(size), _cumulated(parked)
    if len(places):
        lo[~parked], hi[~parked] = (f.reduceat(places["doc"], at[:-1][~parked]) for f in (np.minimum, np.maximum))
    order = np.argsort(buckets, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(buckets[order])) + 1))
    shared = np.minimum.reduceat(lo[order], cut) < np.maximum.reduceat(hi[order], cut)
    rows = order[np.repeat(shared, np.diff(np.concatenate((cut, [len(order)]))))]
    if not len(rows):
        return
    total = np.cumsum(size[rows])
    borders = np.flatnonzero(np.diff(buckets[rows])) + 1  # a slice ends with a bucket
    a = 0
    while a < len(rows):
        far = np.searchsorted(total, (total[a - 1] if a else 0) + SLICE_BYTES)
        b = int(borders[k]) if (k := np.searchsorted(borders, max(far, a + 1))) < len(borders) else len(rows)
        some, a = rows[a:b], b
        first, count, least = _judged(data[_ranges(offset[some], size[some])], size[some], lo[some])
        of = np.repeat(np.arange(len(some)), held[some])
        doc, tag, start, n = _runs(places[_ranges(at[some], held[some])], of, first, count, least)
        if len(doc):
            yield _found(0, len(doc), doc=doc, tag=tag, start=start, n=n)
        told = [i for i in np.flatnonzero(parked[some]).tolist() if (least[first[i] : first[i] + count[i]] < hi[some[i]]).any()]
        if told:
            refs = [many["ref"][nth[some[i]]].tobytes() for i in told]
            yield _found(1, len(told), ref=refs, blob=[least[first[i] : first[i] + count[i]].tobytes() for i in told])


def _resolver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bin; parked places pass through (kind 2)."""
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    now, blocks = None, []
    for batch in batches:
        parked = batch.filter(pc.equal(batch.column("kind"), PARKED))
        if k := parked.num_rows:
            yield _found(2, k, ref=parked.column("ref"), blob=parked.column("blob"))
        packed = batch.filter(pc.equal(batch.column("kind"), BLOCK))
        for b, blob in zip(packed.column("bin").to_pylist(), packed.column("blob"), strict=True):
            if b != now:
                if blocks:
                    yield from _resolve(blocks)
                now, blocks = b, []
            blocks.append(decompress(blob.as_buffer()))
    if blocks:
        yield from _resolve(blocks)


def _joined(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Runs as _runs() gives them; those that touch or overlap in a text become one."""
    doc, tag, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, tag, doc))
    doc, tag, start, n = doc[order], tag[order], start[order], n[order]
    text = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) << 32
    reach = np.maximum.accumulate(text + start + n)
    at = np.flatnonzero(np.concatenate(([True], (text + start)[1:] > reach[:-1])))
    words = reach[np.concatenate((at[1:], [len(reach)])) - 1] - (text + start)[at]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (tag[at], doc[at], start[at], words.astype(np.int32))], names=["tag", "doc", "start", "n"])


def _unpark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs at parked places, joined over the rows that come near each other."""
    waiting, volume = [], 0
    for batch in batches:
        (blobs, ends), (verdicts, limits) = (_bytes_of(batch.column(c)) for c in ("places", "least"))
        places, least, at = blobs.view(PLACE), verdicts.view(np.int64), ends // PLACE.itemsize
        held, count, first = np.diff(at), np.diff(limits) // 8, limits[:-1] // 8
        cuts = [*np.flatnonzero(np.diff(np.cumsum(held * count) // SPREAD, prepend=-1)).tolist(), len(held)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            waiting.append(_runs(places[at[a] : at[b]], np.repeat(np.arange(a, b), held[a:b]), first, count, least))
            volume += len(waiting[-1][0])
            if volume >= RUNS:
                yield _joined(waiting)
                waiting, volume = [], 0
    if volume:
        yield _joined(waiting)


def _surveyed(docs: DataFrame) -> tuple[Column, int]:
    """What tells apart rows that share an id, and the bytes of all texts.

    The first is a hash of the text, or 0 where no id has two texts, as then it would only be carried along.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tag"), F.octet_length("text").cast("long").alias("size"))
    ids = rows.groupBy("doc_id").agg(F.min("tag").alias("a"), F.max("tag").alias("b"), F.sum("size").alias("size"))
    seen = ids.agg(F.max(F.col("a") != F.col("b")).alias("two"), F.sum("size").alias("size")).first()
    return F.xxhash64("text") if seen.two else F.lit(0).cast("long"), seen["size"] or 0


def _hot(rows: DataFrame):
    """The bitmap of hot minimisers as a broadcast of HOT_BITS bits; None if there are none."""
    sampled = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(EVERY)) == 0).select("text").mapInArrow(_hot_counter, "slot long, n long")
    marked = sampled.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).select((F.col("slot") + 1).alias("h"))
    bits = marked.groupBy(F.expr("bitmap_bucket_number(h)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits"))
    parts = bits.collect()  # HOT_BITS bits in rows of 4 KB
    if not parts:
        return None
    whole = np.zeros(HOT_BITS // 8, dtype=np.uint8)
    for r in parts:
        whole[(r.part - 1) * 4096 :][:4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return rows.sparkSession.sparkContext.broadcast(whole)


def removed_runs(docs: DataFrame, tag: Column, size: int) -> DataFrame:
    """(doc_id, tag, start, n): runs of words to remove.  Runs may overlap.  size: the bytes of all texts."""
    bins = max(1, -(-size // BIN_BYTES))
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", tag.alias("tag"), F.col("text").cast("binary").alias("text"))
    blocks = rows.mapInArrow(_packer(_hot(rows), bins), PACKED)
    found = settle(blocks.repartition("bin").sortWithinPartitions("bin").mapInArrow(_resolver, FOUND))
    direct = found.where("kind = 0").select("tag", "doc", "start", "n")
    verdicts = found.where("kind = 1").select("ref", F.col("blob").alias("least"))
    parked = found.where("kind = 2").select("ref", F.col("blob").alias("places")).join(verdicts, "ref")
    texts = F.expr("substring(ref, 1, 8)")  # those that were packed together
    parked = parked.repartition(texts).sortWithinPartitions(texts).select("places", "least")
    out = settle(direct.union(parked.mapInArrow(_unpark, "tag long, doc long, start int, n int")).select(F.col("doc").alias("doc_id"), "tag", "start", "n"))
    forget(found)
    return out


@F.arrow_udf(StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]))
def _cut(text: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
    total, removed, kept = [], [], []
    for t, ss, ns in zip(text, starts, lengths, strict=True):
        words = t.as_py().split()
        total.append(len(words))
        if ss.is_valid:
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            ss = ss.values.to_numpy()
            np.add.at(gone, ss, 1)
            np.add.at(gone, ss + ns.values.to_numpy(), -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        removed.append(total[-1] - len(words))
        kept.append(b" ".join(words).decode("utf-8", "replace"))
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])


def touched(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with `_hit`, false for a row that certainly has no run."""
    key = F.xxhash64("doc_id", "tag")
    return thin_filter(rows, key, runs, key)


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by one space, of each row of docs.

    Only texts that may have runs, by common.thin_filter(), are shuffled to them.
    """
    tag, size = _surveyed(docs)
    runs = removed_runs(docs, tag, size)
    gathered = runs.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("runs"))  # rows that repeat have the same ones
    rows = touched(runs, docs.select("doc_id", tag.alias("tag"), "text"))
    hit = rows.where("_hit").join(gathered, ["doc_id", "tag"], "left").select("doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.n").alias("lengths"))
    none = F.lit(None).cast("array<int>")
    missed = rows.where("NOT _hit").select("doc_id", "text", none.alias("starts"), none.alias("lengths"))
    done = lambda df: df.select("doc_id", _cut(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.col("starts"), F.col("lengths")).alias("c")).select("doc_id", "c.*")
    return done(missed).union(done(hit))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS least FROM v GROUP BY s),
g AS (SELECT DISTINCT rid, i + j AS nth FROM (SELECT rid, i, unnest(range(13)) AS j FROM v JOIN m USING (s) WHERE least < doc_id)),
k AS (SELECT x.rid, x.nth, x.word FROM (SELECT rid, unnest(range(1, len(w) + 1)) AS nth, unnest(w) AS word FROM d) AS x ANTI JOIN g ON g.rid = x.rid AND g.nth = x.nth),
a AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY nth) AS kept FROM k GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""
