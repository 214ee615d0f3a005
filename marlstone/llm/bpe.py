"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

Documents are dealt into blocks of bounded size. A block takes its texts apart into pre-tokens with positions: a list of distinct words, and for
each position of each document the word's place in that list. The distinct words go to the part of their hash, where every word of the
corpus is encoded once, whatever number of blocks has it. The ids come back to the blocks and are joined to the positions by place,
which puts each document together in order. What is shuffled are a block's words for a part, their ids, and a block's
places, compressed: never a row for each pre-token, which would be many times the input. A word stands once in a block, so no part is hot.

Decoding joins each id with the token-byte table, which is as large as the vocabulary and goes to all tasks: ids are the table's row
numbers, so the join takes rows by number.

Both sides of a block come from scans of the same rows. ``docs`` must give the same rows in the same order when read again, as files do;
digests of the words tell whether a block's ids are for its very words, and it is an error if they aren't.

Defined results: a null text is an empty one: no ids. Repeated rows are encoded each for itself; other columns are not read. An id
outside the vocabulary decodes to no bytes. Very long texts are blocks of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, blocks, bound_arrow, freeing, freeing_groups

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Letters and digits for which ``re`` classes written out equal the pattern's Unicode classes.
PLAIN = "[^\x00-\x7eÀ-ÖØ-öø-ɏ]"
PLAIN_PATTERN = (
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+"
    "| ?[^\\s0-9A-Za-zÀ-ÖØ-öø-ɏ]+|\\s+(?!\\S)|\\s+"
)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 token and rank lines."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def splitter(pattern: str):
    """Text -> pre-tokens. Texts of ASCII and Latin letters take an equal pattern of the faster ``re``."""
    import re

    import regex

    unusual, fast, full = re.compile(PLAIN).search, re.compile(PLAIN_PATTERN).findall, regex.compile(pattern).findall
    # separators 1C-1F are white space for re only
    rare = re.compile("[\x1c-\x1f]").search
    return lambda text: full(text) if unusual(text) or rare(text) else fast(text)


def pack(data: list[bytes], level: int = 3) -> bytes:
    """Byte strings as one compressed blob: count, lengths, contents."""
    import numpy as np
    import zstandard

    lengths = np.fromiter(map(len, data), np.uint32, len(data))
    return zstandard.ZstdCompressor(level=level).compress(np.uint32(len(data)).tobytes() + lengths.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(data))


def unpack(blob: bytes) -> list[bytes]:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    lengths = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T.copy().view(np.uint32).ravel()
    ends = (np.cumsum(lengths, dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def by_part(words: set[str], parts: int) -> dict[int, list[bytes]]:
    """The words of each part, sorted. A word's part is the same in every block."""
    import zlib

    found: dict[int, list[bytes]] = {}
    for word in map(str.encode, words):
        found.setdefault(zlib.crc32(word) % parts, []).append(word)
    for held in found.values():
        held.sort()
    return found


class Places(dict):
    """Word -> its place among the distinct words, in order of first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def mark(words: list[bytes]) -> bytes:
    """Digest by which a block knows that an answer is for its very list of words."""
    import hashlib

    import numpy as np

    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return hashlib.blake2b(lengths.tobytes() + b"".join(words), digest_size=16).digest()


def squeeze(numbers) -> bytes:
    """Integers below 2^32, compressed by planes of bytes."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze(blob: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def taken_apart(texts: list[str], split) -> tuple[Places, list]:
    """The distinct words of ``texts`` with their places, in order of first use, and for each text the places of its words by position."""
    import numpy as np

    place = Places()
    return place, [np.fromiter(map(place.__getitem__, split(text)), np.int32) for text in texts]


def _words(pattern: str, parts: int):
    """The distinct words of each block, a row for each part."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        split, at = splitter(pattern), TaskContext.get().partitionId()
        for i, table in enumerate(blocks(batches, "text", BLOCK_CHARS)):
            words: set[str] = set()
            for text in table.column("text").to_pylist():
                words.update(split(text))
            held = by_part(words, parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at << 24 | i] * len(held), pa.int64()), pa.array(held.keys(), pa.int32()), pa.array([pack(x) for x in held.values()], pa.binary())], ["block", "part", "words"]
            )

    return run


def _positions(pattern: str, parts: int):
    """The positions of each block: rows of some documents with the places of their words; the first one also says which part has which words.

    ``order`` has the places of a block's words part by part, in the parts' order; ``answers`` the digest of each part's words.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        split, at = splitter(pattern), TaskContext.get().partitionId()
        for i, table in enumerate(blocks(batches, "text", BLOCK_CHARS)):
            place, rows = taken_apart(table.column("text").to_pylist(), split)
            held = sorted(by_part(place, parts).items())
            order = squeeze(np.fromiter((place[w.decode()] for _, words in held for w in words), np.uint32, len(place)))
            answers = [{"part": k, "mark": mark(words)} for k, words in held]
            ids = table.column("doc_id").combine_chunks()
            for k in range(0, len(rows), 2_000):  # so that no batch to the JVM is large
                some = rows[k : k + 2_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at << 24 | i], pa.int64()), pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.slice(k, n)),
                        pa.array([squeeze([len(x) for x in some])], pa.binary()), pa.array([squeeze(np.concatenate(some))], pa.binary()),
                        pa.array([b"" if k else order], pa.binary()), pa.array([[] if k else answers], pa.list_(pa.struct([("part", pa.int32()), ("mark", pa.binary())]))),
                    ],
                    ["block", "first", "doc_ids", "lengths", "places", "order", "answers"],
                )

    return run


def _encoder(ranks: dict[bytes, int]):
    """Bytes of a pre-token -> its ids as packed 32-bit integers."""
    import numpy as np
    import tiktoken

    core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    one = {word: np.int32(i).tobytes() for word, i in ranks.items()}
    return lambda word: one.get(word) or (np.array(core._encode_single_piece(word), np.int32).tobytes() if word else b"")


#: Text for each part of the words, and most parts: a part reads its words as a stream and remembers up to REMEMBERED of them.
PART_BYTES, MOST_PARTS, REMEMBERED = 32 << 20, 10_000, 1_000_000


def _encode_words(ranks: dict[bytes, int]):
    def run(batches):
        import pyarrow as pa

        encode, known = _encoder(ranks), {}
        for batch in batches:
            for block, part, blob in zip(*(batch.column(k).to_pylist() for k in ("block", "part", "words")), strict=True):
                words = unpack(blob)
                if len(known) > REMEMBERED:
                    known.clear()
                codes = []
                for word in words:
                    code = known.get(word)
                    if code is None:
                        code = known[word] = encode(word)
                    codes.append(code)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([mark(words)], pa.binary()), pa.array([squeeze([len(c) // 4 for c in codes])], pa.binary()), pa.array([squeeze(np_ids(codes))], pa.binary())],
                    ["block", "part", "mark", "lengths", "codes"],
                )

    return run


def np_ids(codes: list[bytes]):
    import numpy as np

    return np.frombuffer(b"".join(codes), np.uint32)


def ends_of(lengths):
    import numpy as np
    import pyarrow as pa

    return pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), pa.int32())


def _assemble(key, docs, words):
    """The documents of one block: ids joined to positions by place."""
    import numpy as np
    import pyarrow as pa

    pieces = sorted(docs.to_pylist(), key=lambda x: x["first"])
    given, lengths, codes = {x["part"]: x for x in words.to_pylist()}, [], []
    for x in pieces[0]["answers"] if pieces else []:
        if x["part"] not in given or given[x["part"]]["mark"] != x["mark"]:
            raise ValueError("the documents differ between two readings: write them to a table first")
        lengths.append(unsqueeze(given[x["part"]]["lengths"]))
        codes.append(unsqueeze(given[x["part"]]["codes"]))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    ids_of = pa.ListArray.from_arrays(ends_of(join(lengths)), pa.array(join(codes).view(np.int32)))
    order = unsqueeze(pieces[0]["order"]) if pieces else np.zeros(0, np.uint32)
    row = np.empty(len(order), np.int32)
    row[order] = np.arange(len(order), dtype=np.int32)
    doc_ids, out = [], []
    for x, ids in zip(pieces, [docs.column("doc_ids")[i].values for i in np.argsort(docs.column("first").to_numpy(), kind="stable").tolist()], strict=True):
        found = ids_of.take(pa.array(row[unsqueeze(x["places"])]))
        token_ends, doc_ends = found.offsets.to_numpy(), ends_of(unsqueeze(x["lengths"])).to_numpy()
        out.append(pa.ListArray.from_arrays(pa.array(token_ends[doc_ends], pa.int32()), found.values))
        doc_ids.append(ids)
    kind = docs.schema.field("doc_ids").type.value_type
    return pa.table({"doc_id": pa.chunked_array(doc_ids, kind), "ids": pa.chunked_array(out, pa.list_(pa.int32()))})


def encode(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, as the tiktoken library gives them without special tokens."""
    import public_tokenizers

    bound_arrow(docs.sparkSession)
    table, pattern = load_ranks(ranks or default_ranks()), pattern or public_tokenizers.PATTERN
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-size // PART_BYTES)))
    words = rows.select("text").mapInArrow(freeing(_words(pattern, parts)), "block long, part int, words binary")
    coded = words.repartitionById(parts, "part").mapInArrow(freeing(_encode_words(table)), "block long, part int, mark binary, lengths binary, codes binary")
    places = rows.mapInArrow(freeing(_positions(pattern, parts)), f"block long, first int, doc_ids array<{kind}>, lengths binary, places binary, order binary, answers array<struct<part:int,mark:binary>>")
    return places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(freeing_groups(_assemble), f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """``coded`` with binary column ``decoded``: the bytes of its ids, by the token-byte table."""
    bound_arrow(coded.sparkSession)
    ranked = load_ranks(ranks or default_ranks())
    tokens = [b""] * (max(ranked.values(), default=-1) + 2)  # the last one is for ids that aren't in the table
    for word, i in ranked.items():
        tokens[i] = word

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.array(tokens, pa.binary())
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            ends, values = column.offsets.to_numpy(), column.values
            number = values.fill_null(-1).to_numpy() if values.null_count else values.to_numpy()
            row = np.where((number >= 0) & (number < len(table) - 1), number, len(table) - 1)[ends[0] : ends[-1]]
            joined = table.take(pa.array(row))
            cuts = np.frombuffer(joined.buffers()[1], np.int32, len(row) + 1)[ends - ends[0]]
            missing = pa.array(~column.is_valid().to_numpy(zero_copy_only=False))
            decoded = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), joined.buffers()[2]])
            decoded = pc.if_else(missing, pa.scalar(None, pa.binary()), decoded) if column.null_count else decoded
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(freeing(run), f"{fields}, decoded binary")


def op9(docs: DataFrame) -> DataFrame:
    coded = decode(encode(docs))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
