"""Language ID by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language; a word's probability is the sum over all its
segmentations into pieces, by the forward algorithm, and a text's is the product over its words (runs of letters, lower-cased, with
the vocabulary's mark of a word's start). Piece probabilities are fitted by expectation-maximisation, whose expected counts come
from the same lattice (forward and backward), on a bounded sample of labelled rows.

Words are scored many at a time in numpy, a place of all words after another; spans are looked up by a rolling hash. Only the sums of as many
places as the longest piece has characters are held, and they are scaled now and then, so a word may be as long as a text without
spaces. A task scores each distinct word of a block once and remembers words up to REMEMBERED numbers.

Defined results: a text that is null or has no letter (category L of Unicode) is ``und`` with score 0. Repeated rows are judged each for
itself. Long texts and long words are scored whole. Of languages equally likely the first by name is chosen. An empty training set makes
everything ``und``.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import blocks, bound_arrow, freeing

VOCABULARY = "piece_bpe_32k.model"
#: Bounds of the training sample: rows of each language, mean characters of a row (longer texts are taken whole, after the others), languages.
FIT_ROWS, FIT_CHARS, FIT_LANGUAGES = 400, 20_000, 200
#: Rows of a language that pass the first, hash-wise cut, as a multiple of FIT_ROWS.
MARGIN = 4
ROUNDS = 3
#: Numbers (words x languages) that a task remembers, characters of words (with languages in fitting) that are worked on at once, and places between two scalings.
REMEMBERED, CELLS, SCALED = 800_000, 100_000, 16
#: Bytes of text that are taken apart at once.
BLOCK = 1_000_000
#: Weight of one pseudo-count spread over the vocabulary, and the log-probability of a character in no piece.
SMOOTHING, UNKNOWN = 0.05, -16.0
#: :func:`keep` rejects a text whose score is below this multiple of an even share among the languages.
MIN_EDGE = 1.04


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of letters and the word mark; others are part of no word."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p.id_to_piece(i).lower() for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    return sorted(x for x in pieces if re.fullmatch("▁?[^▁]*", x) and x and all(c.isalpha() for c in x.removeprefix("▁")))


class Lattice:
    """Spans of words looked up in a vocabulary. ``p``: probabilities, pieces x languages."""

    def __init__(self, pieces: list[str]):
        import numpy as np

        self.longest = max(map(len, pieces), default=1)
        codes = np.array([self.hash_of(x) for x in pieces], np.uint64)
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], order.astype(np.int32)

    def hash_of(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * 1_000_003 + ord(c) + 1) % (1 << 64)
        return h

    def groups(self, words: list[str], most: int):
        """(places in ``words``, characters, lengths) of words of like length, longest first, at most ``most`` characters unless a word has more."""
        import numpy as np

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order, at = np.argsort(-lengths, kind="stable"), 0
        while at < len(order):
            size = int(lengths[order[at]])
            some = order[at : at + max(1, most // max(1, size))]
            # a much shorter word would mostly be padding
            some = some[: max(1, int(np.searchsorted(-lengths[some], -(size // 2), "right")))] if size > SCALED else some
            chars = np.zeros((len(some), size), np.uint64)
            flat = np.frombuffer("".join(words[i] for i in some.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            chars[np.arange(size)[None] < lengths[some][:, None]] = flat.astype(np.uint64) + np.uint64(1)
            yield some, chars, lengths[some]
            at += len(some)

    def spans(self, chars):
        """For pieces of 1, 2, ... characters: ids of the piece that begins at each place of each word, -1 where there is none."""
        import numpy as np

        found, h, mult = [], np.zeros_like(chars), np.uint64(1_000_003)
        for n in range(1, min(self.longest, chars.shape[1]) + 1):
            h = h[:, : chars.shape[1] - n + 1] * mult + chars[:, n - 1 :]
            at = np.searchsorted(self.codes, h)
            at[at == len(self.codes)] = 0
            found.append(np.where(self.codes[at] == h, self.ids[at], -1) if len(self.codes) else np.full(h.shape, -1))
        return found

    def sums(self, found, lengths, p, unknown: float, backward: bool = False, whole: bool = False):
        """log of the sum over segmentations (words x languages); ``whole``: also the sums up to each place, and the logarithms they are scaled by.

        Forward, the sum at place j goes over the segmentations of what is before; ``backward``, of what is behind, places counted from the start.
        """
        import numpy as np

        n, size, k = len(lengths), int(lengths.max()), p.shape[1]
        shift, held = np.zeros((n, k)), {}
        out, places, shifts = np.zeros((n, k)), {}, {}
        for step in range(size + 1):
            # words are sorted by length; backward they are in step by their ends, forward by their starts
            j = size - step if backward else step
            here = int(np.searchsorted(-lengths, -j, "right"))
            now = np.zeros((here, k))
            if backward:
                now[lengths[:here] == j] = 1.0
            elif j == 0:
                now[:] = 1.0
            for m, ids in enumerate(found, 1):
                i = j if backward else j - m
                if i < 0 or i >= ids.shape[1] or (j + m if backward else i) not in held:
                    continue
                other = held[j + m if backward else i]
                ids = ids[: min(here, len(other)), i]
                some = np.flatnonzero(ids >= 0)
                now[some] += other[some] * p[ids[some]]
            if (near := held.get(j + 1 if backward else j - 1)) is not None:
                now[: len(near)] += near[:here] * unknown
            held[j] = now
            held.pop(j + self.longest + 1 if backward else j - self.longest - 1, None)
            if step and step % SCALED == 0:
                top = np.maximum(now, 1e-300)
                fits = (lengths[:here, None] > j) if backward else np.ones((here, 1), bool)
                factor = np.where(fits, top, 1.0)
                shift[:here] += np.log(factor)
                held = {x: np.concatenate([v[:here] / factor[: len(v)], v[here:]]) for x, v in held.items()}
            if whole:
                places[j], shifts[j] = held[j].copy(), shift[:here].copy()
            done = np.arange(here) if backward and j == 0 else np.flatnonzero(lengths[:here] == j)
            if not backward or j == 0:
                out[done] = np.log(np.maximum(held[j][done], 1e-300)) + shift[done]
        return (out, places, shifts) if whole else out

    def score(self, words: list[str], p, unknown: float):
        """log-probabilities, words x languages, in the order of ``words``."""
        import numpy as np

        out = np.zeros((len(words), p.shape[1]))
        for some, chars, lengths in self.groups(words, max(1, CELLS * 8 // max(8, p.shape[1]))):
            out[some] = self.sums(self.spans(chars), lengths, p, unknown)
        return out

    def expected(self, words: list[str], weights, p, unknown: float):
        """Expected piece counts (pieces x languages) of ``words`` with ``weights`` (words x languages)."""
        import numpy as np

        counts = np.zeros_like(p)
        for some, chars, lengths in self.groups(words, max(1, CELLS // max(1, p.shape[1]))):
            found, w = self.spans(chars), weights[some]
            total, alpha, a = self.sums(found, lengths, p, unknown, whole=True)
            _, beta, b = self.sums(found, lengths, p, unknown, backward=True, whole=True)
            for m, ids in enumerate(found, 1):
                for i in range(ids.shape[1]):
                    here = len(beta[i + m])
                    ok = np.flatnonzero(ids[:here, i] >= 0)
                    if len(ok):
                        at = ids[ok, i]
                        np.add.at(counts, at, w[ok] * alpha[i][ok] * p[at] * beta[i + m][ok] * np.exp(a[i][ok] + b[i + m][ok] - total[ok]))
        return counts


def words_in(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, each after the mark of a word's start."""
    if not text:
        return []
    found = re.findall(r"[^\W\d_]+", text.lower())
    if not all(map(str.isalpha, found)):  # numerals that are no decimal digits
        found = [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return ["▁" + w for w in found]


def in_training(doc_id):
    """Rows whose crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", vocabulary_path: str | None = None) -> dict:
    """A model: {"languages", "pieces", "p", "unknown"}.

    Sample: of training rows with lang and a text, the FIT_ROWS of each language with least hash, texts of FIT_CHARS characters or less
    first, that have FIT_ROWS * FIT_CHARS characters together (but one row at least), after a first cut by hash to about MARGIN times as
    many rows (by counts over all rows), so that ranking never gathers more. Words are counted on the executors, and only the counts of
    that bounded sample reach the driver. More than FIT_LANGUAGES languages are an error.
    """
    import numpy as np

    labelled = docs.where(in_training(F.col(key)) & F.col(lang).isNotNull() & (F.char_length(text) > 0))
    sizes = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(FIT_LANGUAGES + 1).collect()
    if len(sizes) > FIT_LANGUAGES:
        raise ValueError(f"more than {FIT_LANGUAGES} languages")
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, MARGIN * FIT_ROWS / r["n"])) for r in sizes], "lang string, share double")
    h = F.xxhash64(key, text)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"))
    some = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    size = F.char_length("text")
    by = W.partitionBy("lang").orderBy(size > FIT_CHARS, F.pmod("h", F.lit(1 << 30)), "h", "text")
    ranked = some.withColumn("n", F.row_number().over(by)).where(F.col("n") <= FIT_ROWS)
    picked = ranked.withColumn("whole", F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0))).where((F.col("n") == 1) | (F.col("whole") <= FIT_ROWS * FIT_CHARS))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            n = Counter((x, w) for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) for w in words_in(t))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n], pa.string()), pa.array([w for _, w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "count"])

    bound_arrow(docs.sparkSession)
    words = picked.select("lang", "text").mapInArrow(freeing(count), "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count")).collect()
    languages = sorted({r["lang"] for r in words})
    pieces = vocabulary(vocabulary_path)
    model = {"languages": languages, "pieces": pieces, "p": np.zeros((len(pieces), 0)), "unknown": float(np.exp(UNKNOWN))}
    if not languages:
        return model
    place: dict[str, int] = {}
    for r in sorted(words):
        place.setdefault(r["word"], len(place))
    weights = np.zeros((len(place), len(languages)))
    for r in words:
        weights[place[r["word"]], languages.index(r["lang"])] += r["count"]
    lattice, held = Lattice(pieces), list(place)
    p = np.repeat(np.array([[0.1 ** min(len(x), 5) for x in pieces]]).T, len(languages), 1)
    p /= p.sum(0)
    for _ in range(ROUNDS):
        counts = lattice.expected(held, weights, p, model["unknown"])
        p = counts + SMOOTHING * weights.sum(0) / len(pieces)
        p /= p.sum(0)
    return model | {"p": p}


def predict(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` (all by default) with ``names``: the language, and the share of its mean letter probability among all."""
    kept = docs.columns if keep is None else keep
    languages = model["languages"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lattice, known = Lattice(model["pieces"]), {}
        scores = np.zeros((1024, len(languages)))
        for table in blocks(batches, text, BLOCK):
            chosen, best = [], []
            texts = table.column(text).to_pylist()
            split = [words_in(t) for t in texts]
            if len(known) * len(languages) > REMEMBERED or sum(map(len, known)) > REMEMBERED:
                known, scores = {}, scores[:1024]
            fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in known))
            if fresh and languages:
                low, high = len(known), len(known) + len(fresh)
                known.update(zip(fresh, range(low, high), strict=True))
                if high > len(scores):
                    scores = np.concatenate([scores[:low], np.zeros((2 * high - low, len(languages)))])
                scores[low:high] = lattice.score(fresh, model["p"], model["unknown"])
            for words in split:
                if not words or not languages:
                    chosen.append("und")
                    best.append(0.0)
                    continue
                total = scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                share = np.exp((total - total.max()) / sum(map(len, words)))
                chosen.append(languages[int(total.argmax())])
                best.append(float(1 / share.sum()))
            out = [table.column(c) for c in kept]
            for batch in pa.table([*out, pa.array(chosen, pa.string()), pa.array(best, pa.float64())], [*kept, *names]).to_batches():
                yield batch

    bound_arrow(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(freeing(run), schema)


def keep(docs: DataFrame, model: dict, text: str = "text", min_score: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known well enough (any text with letters, if one language is learned); columns as they were."""
    names = ("__lang", "__score")
    min_score = min(1.0, MIN_EDGE / max(1, len(model["languages"]))) if min_score is None else min_score
    return predict(docs, model, text, names=names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= min_score)).drop(*names)


def op7(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang")
    found = predict(rows.select("doc_id", "text"), fit(rows), keep=["doc_id"])
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
