"""The whole pipeline against brute force, stage by stage, in plain Python."""

import math
import random
import re
from fractions import Fraction

from test_corpus_ops import brute_classes
from test_text_ops import log_sums

from marlstone.llm import bpe, langid, mixing, neardup

SECRET = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}""", re.I)


def corpus():
    r = random.Random(4)
    words = {"en": [f"{a}{b}" for a in ("the", "and", "ing", "wor", "sto") for b in ("th", "ed", "er", "ly", "ong")], "fr": [f"{a}{b}" for a in ("é", "les", "que", "oi", "au") for b in ("ai", "eux", "ment", "tion", "è")]}
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        text = " ".join(r.choice(words[lang]) + str(r.randrange(9) or "") for _ in range(r.randrange(20, 120)))
        rows.append([i, text, lang, "hot" if i % 2 else f"s{i % 5}"])
    for i in range(90, 120):  # copies, exact and near
        parts = rows[i - 90][1].split()
        if i % 2:
            parts[len(parts) // 2] = "changed"
        rows.append([i, " ".join(parts), rows[i - 90][2], "hot"])
    for i, text in enumerate(["12 34 56", None, "", "½ ²", "password = hunter2hunter2 and so on then", "AKIAABCDEFGHIJKLMN stands the there", "x" * 300 + " the end of it"]):
        rows.append([200 + i, text, None, None])
    r.shuffle(rows)
    return [tuple(x) for x in rows]


def known_language(rows, model):
    languages, place, known, kept = model["languages"], {x: i for i, x in enumerate(model["pieces"])}, {}, []
    for row in rows:
        words = langid.words_in(row[1])
        for w in words:
            if w not in known:
                known[w] = [log_sums(w, place, model["p"][:, k], model["unknown"]) for k in range(len(languages))]
        if words:
            total = [sum(known[w][k] for w in words) / sum(map(len, words)) for k in range(len(languages))]
            if 1 / sum(math.exp(t - max(total)) for t in total) >= langid.MIN_EDGE / len(languages):
                kept.append(row)
    return kept


def first_of_classes(rows, heavy):
    first = {}
    for row, c in zip(rows, brute_classes([(x[0], x[1]) for x in rows], heavy), strict=True):
        first[c] = min(row, first.get(c, row))
    return sorted(first.values())


def redacted(text):
    done, at = "", 0
    for m in SECRET.finditer(text):
        if m[1] is None or len(m[1]) >= 12:
            done, at = done + text[at : m.start()] + "[secret]", m.end()
    return done + text[at:]


def in_turn(rows):
    """Sources' blocks of 16 rows by earliest deadline among those released, slot by slot."""
    held = {}
    for row in sorted(rows, key=lambda x: (x[0])):
        held.setdefault(row[3], []).append(row)
    weight = {k: Fraction(str(float(len(v)) ** mixing.TEMPERATURE)) for k, v in held.items()}
    share = {k: w / sum(weight.values()) for k, w in weight.items()}
    at, slot, out = dict.fromkeys(held, 1), 0, []
    while any((at[k] - 1) * 16 < len(v) for k, v in held.items()):
        open_ = {k: -(-at[k] // share[k]) for k, v in held.items() if (at[k] - 1) * 16 < len(v) and (at[k] - 1) // share[k] <= slot}
        if open_:
            k = min(open_, key=lambda k: (open_[k], open_[k] <= at[k] // share[k], k is not None, k or ""))
            out += held[k][(at[k] - 1) * 16 : at[k] * 16]
            at[k] += 1
        slot += 1
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from marlstone.llm.common import cut

    rows, schema = corpus(), "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = known_language(rows, langid.fit(docs))
    now = cut(corpus_pipeline.identify_language(spark, docs, str(tmp_path)))
    assert sorted(x[0] for x in kept) == sorted(r.doc_id for r in now.collect()) and len(rows) > len(kept) > 100
    kept = first_of_classes(kept, neardup.heavy_shingles(now, "text"))
    want = in_turn([(i, redacted(t), lang, source) for i, t, lang, source in kept])
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})
    got = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert got == [(x[0], own.encode_ordinary(x[1])) for x in want] and 80 < len(got) < len(rows) - 20
