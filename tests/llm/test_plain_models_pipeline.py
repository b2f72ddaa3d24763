"""The toxicity model against a plain recomputation, and the whole pipeline on odd rows."""
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from tidemark.llm import linededup, mixing, toxicity

MASK = 0xFFFFFFFF


def plain_slots(text):
    """The set of n-gram slots of a text, one gram at a time."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    found = set()
    for size in toxicity.SIZES:
        for i in range(len(data) - size + 1):
            h = size * 0x9E37
            for b in data[i:i + size]:
                h = (h * 0x01000193 & MASK) ^ b
            h ^= h >> 15
            h = h * 0x85EBCA6B & MASK
            found.add(h >> (32 - toxicity.BITS))
    return found


def plain_model(texts, labels, epochs=6, batch=256, rate=0.02, decay=1e-5):
    """Weights by slot, and the bias: counts, ratios and the same steps of Adam, slot by slot."""
    sets = [plain_slots(t) for t in texts]
    size = 1 << toxicity.BITS
    counts = [dict(), dict()]
    for own, y in zip(sets, labels):
        for s in own:
            counts[y][s] = counts[y].get(s, 0) + 1
    totals = [sum(c.values()) + size for c in counts]
    ratio = {}
    for s in set(counts[0]) | set(counts[1]):
        n, m = counts[0].get(s, 0) + 1, counts[1].get(s, 0) + 1
        r = math.log(m / totals[1]) - math.log(n / totals[0])
        if abs(r) >= toxicity.Z * math.sqrt(1 / n + 1 / m):
            ratio[s] = r
    rows = [[s for s in own if s in ratio] for own in sets]
    share = sum(labels) / len(labels)
    bias = float(np.float32(math.log((share + 1e-6) / (1 - share + 1e-6))))
    w, first, second = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0)
    b1 = b2 = 0.0
    rng, t = np.random.Generator(np.random.PCG64(8)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            errors = {k: 1 / (1 + math.exp(-(sum(w[s] * ratio[s] for s in rows[k]) + bias))) - labels[k] for k in some}
            grad = {s: decay * w[s] for s in ratio}
            for k in some:
                for s in rows[k]:
                    grad[s] += errors[k] * ratio[s] / len(some)
            t += 1
            up = lambda a, b: rate * (a / (1 - 0.9 ** t)) / (math.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
            for s, g in grad.items():
                first[s] += 0.1 * (g - first[s])
                second[s] += 0.001 * (g * g - second[s])
                w[s] -= up(first[s], second[s])
            g = sum(errors.values()) / len(some)
            b1 += 0.1 * (g - b1)
            b2 += 0.001 * (g * g - b2)
            bias -= up(b1, b2)
    return {s: w[s] * ratio[s] for s in ratio}, bias


def test_slots_of_each_gram():
    texts = ["", "abc", "ABCD abcd", "héé élan ß", "x" * 40, "mixed CASE words and more words"]
    got = [set(own.tolist()) for own in toxicity.distinct_slots(pa.array(texts))]
    assert got == [plain_slots(t) for t in texts]


def test_toxicity_equals_a_plain_recomputation():
    rng = random.Random(3)
    word = lambda kind: rng.choice(["kind words", "good day", "thank you"] if not kind else ["vile scum", "hate them", "good day"])
    labels = [int(rng.random() < 0.3) for _ in range(300)]
    texts = [" ".join([word(y) for _ in range(rng.randint(1, 6))] + [str(rng.random())]) for y in labels]
    weights, bias = plain_model(texts, labels)
    assert weights
    model = toxicity.fit(pa.array(texts), np.array(labels, float))
    probe = texts[:40] + ["", "vile", "good vile day scum", "HATE THEM"]
    got = toxicity.score_texts(pa.array(probe), model)
    want = [1 / (1 + math.exp(-(sum(weights.get(s, 0.0) for s in plain_slots(t)) + bias))) for t in probe]
    assert np.allclose(got, want, atol=1e-4)
    assert got[-1] > 0.5 > got[probe.index("")]


# ---- the pipeline on odd rows --------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, kept string, id string"


def odd_rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    row = lambda i, text, lang="en", source="src1": (i, text, lang, source, None if text is None else len(text), "a", None, "b", "c")
    rows = [row(i, say(rng.randint(20, 200)), rng.choice(["en", "de", None, "it"]), rng.choice(["src0", "src1", None, "other"])) for i in range(150)]
    copy = say(90)
    rows += [row(1000 + i, copy) for i in range(12)]
    rows += [row(i, None) for i in (2000, 2001)] + [row(2002, ""), row(2003, " \n\t "), row(2004, "one")]
    rows += [row(None, say(40)), row(None, None), row(None, say(40), None, None)]
    rows += [rows[3], rows[3], row(5, say(30)), row(3000, say(4000))]
    block = "\n".join([say(8), say(8), say(8)])
    rows += [row(4000 + i, say(20) + "\n" + block + "\n" + say(20)) for i in range(5)]
    return rows


def run_on(spark, tmp_path, rows, labels):
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, no usable label: what comes out is the
    encoding of what the stages, each recomputed plainly from its input, leave."""
    folder = run_on(spark, tmp_path, odd_rows(), [(None, 1, 1), (3, None, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/out-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        stages[name] = docs
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    source = spark.read.parquet(f"{folder}/documents.parquet")
    assert ids(stages["toxicity"]) == ids(source)               # without labels nothing is toxic
    assert ids(stages["line_dedup"]) == ids(source)             # lines go, rows stay
    near = ids(stages["minmax_near"])
    assert sum(1000 <= i < 1012 for _, i in near) == 1          # one of twelve copies
    assert sum(null for null, _ in near) == 3                   # null ids stay
    assert len([i for null, i in near if not null]) == len({i for null, i in near if not null})
    kept = stages["mixture"]
    odds = mixing.with_probability(stages["minmax_near"], corpus_pipeline.MIXTURE, corpus_pipeline.SIZE, corpus_pipeline.REST_SHARE)
    assert ids(kept) == ids(odds.where("kept"))
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = []
    for r in kept.collect():
        tokens = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r)[:4] for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 20
    cut = {r.doc_id: r.n_removed for r in linededup.dedup_lines(source).collect()}
    assert [cut[4000 + i] for i in range(5)] == [0, 3, 3, 3, 3]


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = run_on(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
