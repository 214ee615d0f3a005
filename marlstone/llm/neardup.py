"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are five consecutive words, by 64-bit hash. A shingle's weight in a text is 1 + log10 of its count there (a line repeated a
hundred times doesn't make two texts alike) times its inverse document frequency: FLOOR + (1 - FLOOR) * log((N + PRIOR) / n) /
log(FREQUENT), at most 1, for n of N documents. So a shingle of every document weighs about FLOOR, and those of less than one document in
FREQUENT weigh 1: below that, counts of a bounded size tell no frequencies apart. PRIOR empty documents are added, so that a small
table has no other rule. Document frequencies are exact, in two scans: blocks report what reaches one in 2 * FREQUENT of their own
documents (a shingle over the limit does so in blocks that hold half of its documents, so few candidates remain: at most 2 * FREQUENT
times the mean number of a document's shingles), then candidates are counted over all documents.

Texts of equal words are one content with one signature. Contents that share a band meet in a bucket; of buckets with the same members
one is kept. The members of a bucket are dealt into blocks (SIDE members, LOAD shingles), and all pairs of a block are compared exactly, as
one product of the block's matrix of shingle weights; a block answers with a spanning forest of its links, never with its pairs. Nothing
but sharing no band keeps a link from being found. Buckets of several blocks take more steps:

1. Each block also holds two leaders of the bucket (the member that shares most buckets with others, as the original of edited copies
   does, and one by hash), so that large classes form without the square of their size. Buckets of one class are done then.
2. A member with more than 1 - similarity of its weight in shingles that no other member of the bucket has can be similar to none, and
   goes: that is what texts are that merely share a passage. Shingles are counted by blocks and parts, linear in the bucket's size.
3. What remains is dealt into blocks of the bucket's largest class and blocks of the rest. Each two blocks meet under a key of their own,
   but two of the largest class don't. So work grows with the number of members times that of members outside the largest class.

Classes are connected components, by hooking to smaller neighbours on tables of links; no links come to the driver.

Defined results: a text without words (null, empty) is a class of its own. Fewer than five words are one shingle. Repeated rows are
documents of one class; the representative is the row of least doc_id (null last). All columns, whatever their names, are kept.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bound_arrow, columns_of, cut, freeing, shared_dir

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 9, 3
#: Members and shingles of a block, about.
SIDE, LOAD = 512, 400_000
#: Shingles of one document in FREQUENT, or more, have an idf below 1; FLOOR is that of a shingle of all documents, PRIOR documents are added.
FREQUENT, PRIOR, FLOOR = 1000, 1000, 0.5
#: Contents are broadcast if they are members of at most so many blocks, which are counted.
BROADCAST_ROWS = 200_000
#: Bytes of text that are hashed at a time; documents (or shingles, whichever come first) that are counted together; bytes of a counting task.
BLOCK, SEGMENT, SEGMENT_SHINGLES, SEGMENT_BYTES = 4_000_000, 8 * FREQUENT, 4_000_000, 64_000_000
#: Entries of a block's dense matrix at a time, and shingles of a batch of members' sets.
DENSE, SENT = 4_000_000, 1_000_000


#: Bytes of a word that are hashed all words at once; longer words are hashed each for itself.
LONG_WORD = 48


def word_hashes(texts):
    """(64-bit hashes of the words of all texts, in order, and each text's number of words).

    A word is a run of letters, digits, underscores and characters outside ASCII, lower-cased. All words are hashed together, byte
    by byte, in order of length, so that nothing is made for each word in Python.
    """
    import numpy as np
    import xxhash

    parts = [t.lower().encode() if t else b"" for t in texts]
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    wordy = np.zeros(256, bool)
    wordy[128:] = wordy[48:58] = wordy[65:91] = wordy[97:123] = wordy[95] = True
    edge = np.flatnonzero(np.diff(wordy[buf].view(np.int8), prepend=np.int8(0)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1).astype(np.int16), kind="stable")
    at, active = starts[order], np.searchsorted(-lengths[order], -np.arange(LONG_WORD), "left") if len(order) else np.zeros(LONG_WORD, np.int64)
    h, m = lengths[order].astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(LONG_WORD):
        n = int(active[k])
        if not n:
            break
        x = (h[:n] ^ buf[at[:n] + k]) * m
        h[:n] = x ^ (x >> np.uint64(32))
    for i in np.flatnonzero(lengths[order] > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[at[i] : at[i] + lengths[order[i]]].tobytes())
    out = np.zeros(len(h), np.uint64)
    out[order] = h
    ends = np.cumsum([len(x) + 1 for x in parts])
    return out, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingles(texts):
    """(word hashes of all texts, ends of texts in them, shingle hashes, ends of texts in those), repeated shingles included."""
    import numpy as np

    h, n = word_hashes(texts)
    m = np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(n)
    h = np.concatenate([h, np.zeros(WORDS, np.uint64)])  # so that windows at the end exist
    s = np.zeros(len(h) - WORDS, np.uint64)
    for j in range(WORDS):
        s = (s ^ (s >> np.uint64(29))) * m + h[j : j + len(s)]
    s ^= s >> np.uint64(32)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    for i in np.flatnonzero((n > 0) & (n < WORDS)).tolist():  # one shingle of the words that there are
        x = np.zeros(1, np.uint64)
        for w in h[ends[i] - n[i] : ends[i]]:
            x = (x ^ (x >> np.uint64(29))) * m + w
        s[ends[i] - n[i]] = (x ^ (x >> np.uint64(32)))[0]
    keep = np.arange(len(s)) - np.repeat(ends - n, n) < np.repeat(count, n)
    return h[:-WORDS], ends, s[keep], np.cumsum(count)


def weighted_sets(s, ends):
    """(distinct shingles sorted within each text, counts, ends of texts) from :func:`shingles`."""
    import numpy as np

    s = s.copy()
    at = 0
    for end in ends.tolist():
        s[at:end].sort()
        at = end
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    fresh[starts[starts < len(s)]] = True
    first = np.flatnonzero(fresh)
    return s[first], np.diff([*first, len(s)]), np.searchsorted(first, ends)


def weights_of(distinct, counts, heavy):
    """(1 + log10 of the count) times inverse document frequency. ``heavy``: sorted hashes and their idf."""
    import numpy as np

    w = 1 + np.log10(counts.astype(np.float64))
    if len(heavy[0]) and len(distinct):
        at = np.minimum(np.searchsorted(heavy[0], distinct), len(heavy[0]) - 1)
        w = np.where(heavy[0][at] == distinct, w * heavy[1][at], w)
    return w


def log_weights(distinct, counts, heavy):
    import numpy as np

    return np.log(weights_of(distinct, counts, heavy))


def samples(hashes, logw, starts):
    """Improved consistent weighted samples of several sets at once: BANDS * ROWS x sets, as 64-bit (shingle, level) hashes.

    For sample k, shingle s has r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; level t = floor(log w / r + b), log y = r (t - b),
    and the set's sample is the (s, t) of least log c - log y - r. Ties go to the smaller hash.
    """
    import numpy as np

    lens = np.diff([*starts, len(hashes)])
    out = np.zeros((BANDS * ROWS, len(starts)), np.uint64)
    u64, scale = np.uint64, np.float32(2.0**-24)
    other = np.flatnonzero(logw)  # elsewhere the weight is 1: t = 0 and log y = -r b
    unit = lambda v: (v.astype(np.int32).astype(np.float32) + np.float32(0.5)) * scale
    for k in range(BANDS * ROWS):
        z = []
        for salt in (2 * k + 1, 2 * k + 2):
            x = (hashes ^ u64(salt * 0xD1342543DE82EF95 % (1 << 64))) * u64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> u64(32))) * u64(0x94D049BB133111EB)
            z.append(x ^ (x >> u64(31)))
        low = u64(0xFFFFFF)
        r = -np.log(unit(z[0] >> u64(40)) * unit((z[0] >> u64(16)) & low))
        log_c = np.log(-np.log(unit(z[1] >> u64(40)) * unit((z[1] >> u64(16)) & low)))
        b = unit((z[0] & u64(0xFFFF)) << u64(8) | (z[1] & u64(0xFF)))
        a = log_c + r * (b - np.float32(1))
        if len(other):
            ro, bo = r[other], b[other]
            t = np.floor(logw[other] / ro + bo)
            a[other] = log_c[other] - ro * (t - bo) - ro
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, lens))
        first = at[np.searchsorted(at, starts)]
        out[k] = hashes[first] * u64(0x9E3779B97F4A7C15)
        if len(other):
            j = np.minimum(np.searchsorted(other, first), len(other) - 1)
            level = np.where(other[j] == first, t[j], 0).astype(np.int64).view(u64)
            out[k] += level * u64(0xC2B2AE3D27D4EB4F)
    return out


def band_keys(sampled):
    """sets x BANDS 64-bit keys; the band's number is part of a key."""
    import numpy as np

    out = np.zeros((sampled.shape[1], BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(sampled.shape[1], b + 1, np.uint64)
        for k in range(ROWS):
            h = (h ^ sampled[b * ROWS + k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
        out[:, b] = h.view(np.int64)
    return out


def heavy_shingles(docs: DataFrame, text: str) -> list[tuple[int, float]]:
    """(hash, idf) of the shingles whose idf is below 1."""
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    if not total:
        return []
    least = (total + PRIOR) / FREQUENT

    def local(batches):
        import numpy as np
        import pyarrow as pa

        def report(parts, found):
            s = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
            s.sort()
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(s)))
            often = n >= found / (2 * FREQUENT)  # places, which are no fewer than documents
            return pa.RecordBatch.from_arrays([pa.array(s[first[often]].view(np.int64)), pa.array(n[often])], ["s", "n"])

        # parts of SEGMENT documents or SEGMENT_SHINGLES at least; what is left at the end goes to the last one
        done, held = [], []
        for table in blocks(batches, text, BLOCK):
            held.append((shingles(table.column(text).to_pylist())[2], table.num_rows))
            if sum(n for _, n in held) >= SEGMENT or sum(len(x) for x, _ in held) >= SEGMENT_SHINGLES:
                if done:
                    yield report(done, sum(n for _, n in done))
                done, held = held, []
        yield report(done + held, sum(n for _, n in done + held))

    # small partitions are read by one task, up to a segment of documents or some MB
    parts = max(1, total // SEGMENT, (size or 0) // SEGMENT_BYTES)
    sums = docs.select(text).coalesce(parts).mapInArrow(freeing(local), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    # parts that report nothing hold less than total / (2 * FREQUENT) of a shingle's documents
    chosen = sums.where(F.col("n") > least - total / (2 * FREQUENT)).select("s").toArrow().column("s").to_numpy()
    if not len(chosen):
        return []

    def exact(batches):
        import numpy as np
        import pyarrow as pa

        wanted = np.sort(chosen.view(np.uint64))
        counts = np.zeros(len(wanted), np.int64)
        for table in blocks(batches, text, BLOCK):
            _, _, s, ends = shingles(table.column(text).to_pylist())
            at = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
            hits = np.flatnonzero(wanted[at] == s)
            in_doc = np.unique(np.searchsorted(ends, hits, "right") * len(wanted) + at[hits])
            counts += np.bincount(in_doc % len(wanted), minlength=len(wanted))
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(counts[some])], ["s", "n"])

    rows = docs.select(text).mapInArrow(freeing(exact), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
    return [(s, FLOOR + (1 - FLOOR) * log((total + PRIOR) / n) / log(FREQUENT)) for s, n in zip(rows["s"].to_pylist(), rows["n"].to_pylist(), strict=True)]


def as_arrays(heavy):
    import numpy as np

    pairs = sorted((s % (1 << 64), min(1.0, w)) for s, w in heavy)
    return np.array([s for s, _ in pairs], np.uint64), np.array([w for _, w in pairs], np.float64)


def signed(docs: DataFrame, text: str, heavy) -> DataFrame:
    """``docs`` in one struct column ``doc``, with rid (unique), content (128-bit hash of the words, null without words), band keys and number of distinct shingles."""
    known = as_arrays(heavy)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, contents = ([None] * batch.num_rows for _ in range(2))
            h, word_ends, s, ends = shingles(batch.column("text").to_pylist())
            distinct, counts, ends = weighted_sets(s, ends)
            logw = log_weights(distinct, counts, known).astype(np.float32)
            begins, at = np.concatenate([[0], ends[:-1]]), 0
            some = np.flatnonzero(ends > begins)
            while at < len(some):  # texts of some thousand shingles at a time stay within the processor's cache
                to = max(at + 1, int(np.searchsorted(ends[some], begins[some[at]] + 6000)))
                here = some[at:to]
                low, high = begins[here[0]], ends[here[-1]]
                sampled = samples(distinct[low:high], logw[low:high], begins[here] - low)
                for i, k in zip(here.tolist(), band_keys(sampled).tolist(), strict=True):
                    keys[i] = k
                at = to
            for i, (a, b) in enumerate(zip([0, *word_ends[:-1].tolist()], word_ends.tolist(), strict=True)):
                if b > a:
                    contents[i] = xxhash.xxh128_digest(h[a:b].tobytes())
            ids = pa.array(np.arange(rid, rid + batch.num_rows))
            rid += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc"), ids, pa.array(contents, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(ends - begins, pa.int64())], ["doc", "rid", "content", "bands", "size"])

    doc = F.struct(*columns_of(docs))
    rows = docs.select(doc.alias("doc"), F.col(text).alias("text"))
    own = T._parse_datatype_string("rid long, content binary, bands array<long>, size long")
    return rows.mapInArrow(freeing(run), T.StructType([rows.schema["doc"], *own.fields]))


def block_rows(members: DataFrame, texts_of, *keys: str) -> DataFrame:
    """One row for each block of ``members`` (``keys``, content, rid, root): ``keys`` and ``held``, its members with their sets (distinct
    shingles in order, and the places and counts of repeated ones). Each text is read and hashed once and goes to all its blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        listed = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
        for batch in batches:
            _, _, s, ends = shingles(batch.column("text").to_pylist())
            distinct, counts, ends = weighted_sets(s, ends)
            more = np.flatnonzero(counts > 1)
            begins = np.concatenate([[0], ends[:-1]])
            place = (more - begins[np.searchsorted(ends, more, "right")]).astype(np.int32)
            more_ends = np.searchsorted(more, ends)
            sets = {"shingles": listed(distinct.view(np.int64), ends), "at": listed(place, more_ends), "times": listed(counts[more].astype(np.int32), more_ends)}
            to = batch.column("blocks")
            n = np.diff(to.offsets.to_numpy())
            of, goals = np.repeat(np.arange(len(n)), n), to.flatten()
            heaps = np.cumsum((ends - begins)[of]) // SENT
            for k in np.unique(heaps).tolist():  # some MB at a time
                lo, hi = (int(x) for x in np.searchsorted(heaps, [k, k + 1]))
                here = pa.array(of[lo:hi])
                some = goals.slice(lo, hi - lo)
                columns = [*(some.field(c) for c in (*keys, "root")), batch.column("content").take(here), *(x.take(here) for x in sets.values())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "root", "content", *sets])

    per_text = members.groupBy("rid", "content").agg(F.collect_list(F.struct(*keys, "root")).alias("blocks"))
    own = T._parse_datatype_string("root binary, content binary, shingles array<long>, at array<int>, times array<int>")
    rows = texts_of(per_text).select("content", "blocks", "text").mapInArrow(freeing(run), T.StructType([*(T.StructField(c, members.schema[c].dataType) for c in keys), *own.fields]))
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("content", "root", "shingles", "at", "times")).alias("held"))


class Block:
    """The members of one row of :func:`block_rows`: content, root, and shingles and weights of all, with ``who`` has them."""

    def __init__(self, held, heavy):
        import numpy as np

        flat = held.values
        self.content, self.root = flat.field("content").to_pylist(), flat.field("root").to_pylist()
        parts = {}
        for name in ("shingles", "at", "times"):
            column = flat.field(name)
            ends = column.offsets.to_numpy()
            parts[name] = column.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)
        self.shingles, sizes = parts["shingles"][0].view(np.uint64), parts["shingles"][1]
        begins, (at, more), counts = np.cumsum(sizes) - sizes, parts["at"], np.ones(len(self.shingles), np.int64)
        counts[np.repeat(begins, more) + at] = parts["times"][0]
        self.weights, self.who = weights_of(self.shingles, counts, heavy), np.repeat(np.arange(len(sizes)), sizes)
        self.total = np.bincount(self.who, self.weights, len(sizes))

    def common(self):
        """Sums of the lesser weights, members x members.

        A shingle of several weights stands in one column for each of them, with what that weight has more than the one below, so that
        lesser weights are products of columns. Columns of one member don't matter; those of two are added one by one.
        """
        import numpy as np

        m = len(self.total)
        order = np.lexsort((self.weights, self.shingles))
        s, w, who = self.shingles[order], self.weights[order], self.who[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = s[1:] != s[:-1]
        column = fresh.copy()
        column[1:] |= w[1:] != w[:-1]
        more = w.copy()
        more[1:] -= np.where(fresh[1:], 0, w[:-1])
        more, col = more[column], np.cumsum(column) - 1
        lowest = np.repeat(col[fresh], np.diff([*np.flatnonzero(fresh), len(s)]))
        depth = col - lowest + 1
        if len(depth) and depth.max() > 1:
            who = np.repeat(who, depth)
            col = np.repeat(lowest, depth) + np.arange(len(who)) - np.repeat(np.cumsum(depth) - depth, depth)
            order = np.argsort(col, kind="stable")
            who, col = who[order], col[order]
        n = np.bincount(col, minlength=len(more))
        out = np.zeros((m, m))
        first = np.flatnonzero(n[col] == 2)[::2]
        np.add.at(out, (who[first], who[first + 1]), more[col[first]])
        out += out.T
        many = np.flatnonzero(n > 2)
        begins = np.cumsum(n) - n
        step = max(1, DENSE // max(1, m))
        for k in range(0, len(many), step):
            cols = many[k : k + step]
            x = np.zeros((m, len(cols)))
            sizes = n[cols]
            at = np.repeat(begins[cols] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            x[who[at], np.repeat(np.arange(len(cols)), sizes)] = np.repeat(np.sqrt(more[cols]), sizes)
            out += x @ x.T
        return out

    def links(self, similarity: float) -> list[tuple[bytes, bytes]]:
        """Roots of similar members of different roots: a spanning forest of them."""
        import numpy as np

        codes: dict[bytes, int] = {}
        label = np.array([codes.setdefault(r, len(codes)) for r in self.root])
        if len(codes) < 2:
            return []
        common, found = self.common(), []
        near = common >= similarity * (self.total[:, None] + self.total[None, :] - common) - 1e-9
        for i in range(len(label)):
            others = np.flatnonzero(near[i] & (label != label[i]))
            if len(others):
                classes, first = np.unique(label[others], return_index=True)
                found += [(self.root[i], self.root[j]) for j in others[first].tolist()]
                label[np.isin(label, classes)] = label[i]
        return found

    def rarely_shared(self, elsewhere, similarity: float):
        """Members more than 1 - ``similarity`` of whose weight is in shingles that no other has, here or in ``elsewhere`` (sorted)."""
        import numpy as np

        _, back, n = np.unique(self.shingles, return_inverse=True, return_counts=True)
        own = n[back] == 1
        if len(elsewhere):
            own &= elsewhere[np.minimum(np.searchsorted(elsewhere, self.shingles), len(elsewhere) - 1)] != self.shingles
        return np.bincount(self.who, self.weights * own, len(self.total)) > (1 - similarity) * self.total + 1e-9


def compared(members: DataFrame, texts_of, heavy, similarity: float, *keys: str) -> DataFrame:
    """Links (a, b) between roots of ``members`` (``keys``, content, rid, root) that meet under the same keys."""
    known = as_arrays(heavy)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for held in batch.column("held"):
                if found := Block(held, known).links(similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])

    return block_rows(members, texts_of, *keys).select("held").mapInArrow(freeing(run), "a binary, b binary").distinct()


def linkable(members: DataFrame, texts_of, heavy, similarity: float, folder: str) -> DataFrame:
    """The ``members`` (bucket, sides, content, rid, root) that may be similar to another of their bucket by what they share at all."""
    known = as_arrays(heavy)

    def own(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for bucket, side, sides, held in zip(*(batch.column(c).to_pylist() for c in ("bucket", "side", "sides")), batch.column("held"), strict=True):
                distinct = np.unique(Block(held, known).shingles)
                part = (distinct >> np.uint64(33)) % np.uint64(sides)
                for p in np.unique(part).tolist():
                    some = distinct[part == p].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([side], pa.int32()), pa.array([p], pa.int32()), pa.array([some], pa.list_(pa.int64()))], ["bucket", "side", "part", "own"])

    def repeated(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for bucket, blocks_ in zip(batch.column("bucket").to_pylist(), batch.column("blocks"), strict=True):
                flat = blocks_.values
                sides, lists = flat.field("side").to_pylist(), flat.field("own")
                arrays = [x.values.to_numpy() for x in lists]
                values, n = np.unique(np.concatenate(arrays), return_counts=True)
                several = values[n > 1]
                for side, x in zip(sides, arrays, strict=True):
                    shared = x[np.isin(x, several)]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([side], pa.int32()), pa.array([shared], pa.list_(pa.int64()))], ["bucket", "side", "shared"])

    def chosen(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for bucket, shared, held in zip(batch.column("bucket").to_pylist(), batch.column("shared"), batch.column("held"), strict=True):
                block = Block(held, known)
                elsewhere = np.sort(shared.values.to_numpy().view(np.uint64)) if shared.is_valid else np.zeros(0, np.uint64)
                kept = np.flatnonzero(~block.rarely_shared(elsewhere, similarity)).tolist()
                columns = [pa.array([bucket] * len(kept), pa.int64()), *(pa.array([x[i] for i in kept], pa.binary()) for x in (block.content, block.root))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "content", "root"])

    held = cut(block_rows(members.withColumn("side", F.pmod(F.xxhash64("content"), "sides").cast("int")), texts_of, "bucket", "side", "sides"), folder)
    parts = held.select("bucket", "side", "sides", "held").mapInArrow(freeing(own), "bucket long, side int, part int, own array<long>")
    shared = parts.groupBy("bucket", "part").agg(F.collect_list(F.struct("side", "own")).alias("blocks")).select("bucket", "blocks").mapInArrow(freeing(repeated), "bucket long, side int, shared array<long>")
    shared = shared.groupBy("bucket", "side").agg(F.flatten(F.collect_list("shared")).alias("shared"))
    kept = held.join(shared, ["bucket", "side"], "left").select("bucket", "shared", "held").mapInArrow(freeing(chosen), "bucket long, content binary, root binary")
    return kept.join(members.select("bucket", "content", "rid"), ["bucket", "content"])


def several(members: DataFrame) -> DataFrame:
    """The ``members`` (bucket, content, root) of buckets that hold several classes."""
    kinds = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    return members.join(kinds.select("bucket"), "bucket", "left_semi")


def block_pairs(members: DataFrame, sides) -> DataFrame:
    """(bucket, lo, hi, content, rid, root): blocks of each bucket's largest class (lo below 0) meet the blocks of its other ``members``, which meet each other."""
    n = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    # shares of the bucket's blocks
    whole = n.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n_all")).join(sides, "bucket")
    share = lambda x: F.greatest(F.lit(1), F.ceil(x * F.col("sides") / F.col("n_all")).cast("int"))
    whole = whole.select("bucket", "major", share(F.col("n_major")).alias("a"), share(F.col("n_all") - F.col("n_major")).alias("b"))
    placed = members.join(whole, "bucket").withColumn("of_major", F.col("root") == F.col("major"))
    side = F.pmod(F.xxhash64("content", F.lit(2)), F.when(F.col("of_major"), F.col("a")).otherwise(F.col("b"))).cast("int")
    key = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    rest = F.sequence(F.lit(0), F.col("b") - 1)
    of_major = F.transform(rest, lambda k: key(-1 - F.col("side"), k))
    of_rest = F.concat(F.transform(F.sequence(F.lit(1), F.col("a")), lambda k: key(-k, F.col("side"))), F.transform(rest, lambda k: key(F.least(k, "side"), F.greatest(k, "side"))))
    met = placed.withColumn("side", side).select("bucket", "content", "rid", "root", F.explode(F.when(F.col("of_major"), of_major).otherwise(of_rest)).alias("k"))
    return met.select("bucket", "k.lo", "k.hi", "content", "rid", "root")


def followed(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``labels`` (node, root) with each root replaced by its own root in ``further``, if it has one."""
    return labels.join(further.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root"))


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): connected components.

    Each round a node points to its least neighbour (or itself), pointers are followed twice, and links are redrawn between the
    ends; a node that isn't least among its neighbours vanishes, so a star takes two rounds whatever its size.
    """
    steps = []
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), folder)
        up = cut(followed(up, up), folder)
        steps.append(up)
        ends = links.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = cut(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), folder)
        if links.isEmpty():
            break
    labels = steps[0]
    for step in steps[1:]:
        labels = followed(labels, step)
    return cut(labels, folder) if len(steps) > 1 else labels


def linked(contents: DataFrame, texts_of, heavy, similarity: float, folder: str) -> DataFrame | None:
    """(node, root) of the ``contents`` (content, rid, bands, size) that are linked to others; None if none is. ``texts_of``: rows with rid -> with text, too."""
    every = contents.select("content", "rid", "size", F.explode("bands").alias("bucket"))
    same = [F.bit_xor(F.xxhash64(F.lit(i), "content")).alias(f"x{i}") for i in range(2)]
    sizes = every.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("load"), *same).where("n > 1")
    kept = sizes.groupBy("n", "load", "x0", "x1").agg(F.min("bucket").alias("bucket"))
    kept = kept.select("bucket", "n", F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("load") / LOAD)).cast("int").alias("sides"))
    members = cut(every.join(kept, "bucket").select("bucket", "n", "sides", "content", "rid", F.col("content").alias("root")), folder)
    if members.isEmpty():
        return None
    large = members.where("sides > 1")
    score = large.groupBy("content").agg(F.sum("n").alias("score"))
    one = F.struct("content", "rid")
    chosen = F.array(F.max_by(one, F.struct("score", "content")), F.min_by(one, F.xxhash64("content", "bucket")))
    leaders = large.join(score, "content").groupBy("bucket", "sides").agg(F.array_distinct(chosen).alias("leaders"))
    leaders = leaders.select("bucket", "sides", F.explode("leaders").alias("x")).select("bucket", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), "x.content", "x.rid")
    dealt = members.select("bucket", F.pmod(F.xxhash64("content"), "sides").cast("int").alias("side"), "content", "rid").union(leaders).distinct()
    links = cut(compared(dealt.withColumn("root", F.col("content")), texts_of, heavy, similarity, "bucket", "side"), folder)
    labels = None if links.isEmpty() else components(links, folder)
    if large.isEmpty():
        return labels
    if labels is not None:
        large = large.drop("root").join(labels.select(F.col("node").alias("content"), "root"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    sides = members.where("sides > 1").select("bucket", "sides").distinct()
    rest = several(linkable(several(large.select("bucket", "sides", "content", "rid", "root")), texts_of, heavy, similarity, folder))
    links = cut(compared(block_pairs(cut(rest, folder), sides), texts_of, heavy, similarity, "bucket", "lo", "hi"), folder)
    if links.isEmpty():
        return labels
    further = components(links, folder)
    return further if labels is None else cut(followed(labels, further).union(further.join(labels, "node", "left_anti")), folder)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``doc`` (all columns of ``docs``), class_id (least ``key`` of the class), class_size and representative (one row of each class)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    folder = shared_dir(spark)
    heavy = heavy_shingles(docs, text)
    table = cut(signed(docs, text, heavy), folder)
    k = f"doc.`{key}`"
    first = F.min(F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("k"), F.col("rid")))
    contents = cut(table.where(F.col("content").isNotNull()).groupBy("content").agg(first.alias("first"), F.count("*").alias("n"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size")), folder)

    def texts_of(needed: DataFrame) -> DataFrame:
        needed = cut(needed, folder)
        small = (needed.agg(F.sum(F.size("blocks"))).first()[0] or 0) <= BROADCAST_ROWS
        return table.select("rid", F.col(f"doc.`{text}`").alias("text")).join(F.broadcast(needed) if small else needed, "rid")

    labels = linked(contents.select("content", "first.rid", "bands", "size"), texts_of, heavy, similarity, folder)
    named = contents.select("content", "first", "n").withColumn("root", F.col("content"))
    if labels is not None:
        named = named.drop("root").join(labels.select(F.col("node").alias("content"), "root"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    whole = named.groupBy("root").agg(F.min("first").alias("least"), F.sum("n").alias("size")).where("size > 1")
    several = named.select("content", "root").join(whole, "root").select("content", "least", "size")
    out = table.select("doc", "rid", "content").join(several, "content", "left")
    alone = F.col("size").isNull()
    return out.select(
        "doc", F.when(alone, F.col(k)).otherwise(F.col("least.k")).alias("class_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("rid") == F.col("least.rid"))).alias("representative")
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, columns as in ``docs``."""
    return classes(docs, **options).where("representative").select("doc.*")


def op8(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select("doc.doc_id", "class_id", "class_size", "representative")
