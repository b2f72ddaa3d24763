"""Periodic runs, prefix trie and quality rules against brute force."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import rules, runs, trie
from tidemark.llm.recompress import compressed, extension

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
sha = lambda text: hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ---- periodic runs -----------------------------------------------------------------------------------------------------

def brute_runs(words, least=24, times=3):
    """(start, length, smallest period) of all runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_rewrite(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digest(doc_id, text):
    words = brute_rewrite(doc_id, WORD.findall((text or "").encode()))
    own = brute_runs(words)
    dropped = {i for s, n, q in own for i in range(s + q, s + n)}
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else None
    return (doc_id, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(own, key=lambda r: (r[0], r[2])))),
            sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def periodic_corpus(corpus):
    rng = random.Random(11)
    rows = list(corpus)
    for k in range(1000, 1250):
        words = [rng.choice("ab" if k % 3 else "abcdefgh") + "é" * (k % 2) for _ in range(rng.choice([1, 23, 24, 30, 90, 200]))]
        if k % 4:
            a, p = rng.randrange(len(words)), rng.randint(1, 20)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        rows.append((k, rng.choice([" ", "\n", " \x0b\t"]).join(words) + rng.choice(["", " ", " "])))
    rows += [(2000, "same " * 700), (2001, "x y " * 300 + "x x " * 40), (2002, "\u0085 a " * 30), (2000, "same " * 700)]
    return rows


def test_extensions_of_the_grammar():
    rng = random.Random(2)
    for _ in range(40):
        texts = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 60))] for _ in range(rng.randint(1, 4))]
        line, places = [-1], []
        for d, text in enumerate(texts):
            places += [(len(line) + i, len(line) + j) for i in range(len(text)) for j in range(i + 1, len(text))]
            line += [*text, -2 - d]
        if not places:
            continue
        levels = compressed(np.array(line, np.int64))
        i, j = np.array(places).T
        on, back = extension(levels, i, j, True), extension(levels, i, j, False)
        for a, b, n, m in zip(i.tolist(), j.tolist(), on.tolist(), back.tolist()):
            assert line[a:a + n] == line[b:b + n] and line[a + n] != line[b + n]
            assert line[a - m:a] == line[b - m:b] and line[a - m - 1] != line[b - m - 1]


def test_runs_against_every_period():
    rng = random.Random(4)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(0, 5)):
            n, k = rng.choice([0, 1, 23, 24, 60, 150]), rng.choice([1, 2, 3, 40])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 9)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = list(zip(*(x.tolist() for x in runs.runs_of(np.array(sum(texts, []), np.int64), offsets))))
        for d, words in enumerate(texts):
            assert sorted(r[1:] for r in found if r[0] == d) == brute_runs(words)


def test_periodic_runs_query(spark, make_docs, corpus):
    rows = periodic_corpus(corpus)
    got = runs.digest(runs.periodic_runs(runs.rewritten(make_docs(rows))))
    want = [brute_digest(i, t) for i, t in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(r[1] for r in want) > 50


def test_periodic_runs_outputs(spark, make_docs):
    text = "a b " * 20 + "c d e"
    row, = runs.periodic_runs(make_docs([(1, text)])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 40, 2)] and row.collapsed == "a b c d e" and row.n_words == 43
    assert runs.periodic_runs(make_docs([])).count() == 0
    assert runs.digest(runs.periodic_runs(runs.rewritten(make_docs([])))).count() == 0


# ---- prefix trie -------------------------------------------------------------------------------------------------------

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows, rebuild):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(vs, key=lambda v: v[:2])] for c, vs in turns.items()}
    if rebuild:
        head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - c % 5, [])[:head[c]] + vs[head[c]:] for c, vs in own.items()}
    nodes, children = {}, {}
    for c, vs in own.items():
        for d in range(len(vs) + 1):
            nodes.setdefault(tuple(vs[:d]), []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = sorted(c for c in nodes[k] if len(own[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), leaves[k], saved[k], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def conversations(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for name in ("id", "size", "row", "pid", "key", "slab", "length"):
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(7)
    rows = [(c, t or None, rng.choice(["u", None]), rng.choice(["a", "bé", None])) for c in range(50) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "u", f"same {t}") for c in range(100, 140) for t in range(6)]
    rows += [(c, t, "u", f"x{t if t < 70 else t * c}") for c in range(200, 207) for t in range(rng.choice([31, 32, 33, 64, 65, 97]))]
    rows += [(300 + c, 0, "u", "copy") for c in range(700)]
    rows.append((None, 1, "u", "of no conversation"))
    return rows


@pytest.mark.parametrize("rebuild, width", [(True, 32), (False, 32), (True, 3)])
def test_trie_against_brute_force(spark, turns, rebuild, width):
    build = trie.rebuilt_trie if rebuild else trie.prefix_trie
    got = trie.digest(*build(conversations(spark, turns), width)).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(turns, rebuild)


def test_trie_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 2)
    rows = [(c, t, "u", "a" if t < 20 else str(t % (c + 2))) for c in range(6) for t in range(15 + 5 * c)]
    got = trie.digest(*trie.prefix_trie(conversations(spark, rows), 3)).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows, False)


def test_trie_edges(spark):
    assert trie.digest(*trie.rebuilt_trie(conversations(spark, []))).count() == 0
    # conversation 7 has fewer turns than its head and no base: it is left without turns, a member of the root alone
    assert zlib.crc32(b"7") % 9 > 1
    got = trie.digest(*trie.rebuilt_trie(conversations(spark, [(7, 0, "u", "x")]))).select(*NODE).collect()
    assert [tuple(r) for r in got] == [(7, 0, None, 1, 0, 1, 0, sha("7"))]


# ---- quality rules -----------------------------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = [w.decode() for w in WORD.findall(text.encode())]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line.encode())]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def rough(value):
    """The value with its leading eight bits."""
    shift = max(value.bit_length() - 8, 0)
    return value >> shift << shift


def brute_rules(rows):
    """kept by row, rows being (doc_id, lang, source, text)."""
    counts = [brute_counts(r[3]) for r in rows]
    failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
    stats = [None if f else {"word_length": 1000 * c[1] // c[0], "symbols": 10000 * c[2] // c[1], "repeats": 1000 * c[4] // c[0],
                             "dup_lines": 1000 * c[3] // c[0], "n_words": c[0]} for c, f in zip(counts, failed)]
    quartile = lambda values, q: next(v for i, v in enumerate(values) if 100 * (i + 1) >= q * len(values))
    kept = []
    for row, s in zip(rows, stats):
        if s is None:
            kept.append(False)
            continue
        groups = [[x for r, x in zip(rows, stats) if x and r[1:3] == row[1:3]], [x for r, x in zip(rows, stats) if x and r[1] == row[1]], [x for x in stats if x]]
        group = next((g for g in groups[:2] if len(g) >= rules.LEAST_DOCS), groups[2])
        fine = True
        middle = quartile(sorted(rough(x["n_words"]) for x in group), 50)
        for name, _, least, both in rules.STATISTICS:
            cells = sorted(rough(x[name]) for x in group)
            low, high = quartile(cells, 25), quartile(cells, 75)
            bound = (3 * max(high - low, least)) ** 2 * max(s["n_words"], middle)
            fine &= max(s[name] - high, 0) ** 2 * s["n_words"] <= bound
            fine &= not both or max(low - s[name], 0) ** 2 * s["n_words"] <= bound
        kept.append(fine)
    return [(r[0], *c, f, k) for r, c, f, k in zip(rows, counts, failed, kept)]


def test_rules_against_brute_force(spark, corpus):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdeéß") for _ in range(n))
    rows = [(i, "en", "s0", t) for i, t in corpus]
    for k in range(1000, 1700):
        source = rng.choice(["s0", "s0", "s0", None, f"rare{k}"])
        lang = rng.choice(["en", "en", None, "de", f"l{k}"])
        size = 9 if k % 20 == 0 else 4
        text = " ".join(word(rng.randint(2, 2 * size)) for _ in range(rng.randint(3, 120)))
        if k % 33 == 0:
            text += " # $ % & | <br> " * 20
        if k % 41 == 0:
            text += "\nline one of\nline one of\n" + "x " * 12
        rows.append((k, lang, source, text))
    rows += [(5000, "en", "s0", "w" * 50_000 + " a b c d e f g h i j"), (None, None, None, None), (1000, "en", "s0", "")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(4)
    for name in ("stat", "cell", "n", "docs", "t", "salt", "part", "kept"):
        frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    got = rules.quality_rules(frame).drop("lang", "source").collect()
    want = brute_rules(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert 20 < sum(not w[-2] and not w[-1] for w in want) < 200


def test_rules_edges(spark, make_docs):
    assert rules.quality_rules(make_docs([])).count() == 0
    row, = rules.quality_rules(make_docs([(1, None)])).collect()
    assert (row.n_words, row.word_chars, row.base_failed, row.kept) == (0, 0, True, False)
    text = " ".join(f"w{i}" for i in range(40))
    assert rules.quality_rules(make_docs([(1, text)]).drop("lang", "source")).first().kept


def test_sketches_merge(spark, make_docs, corpus):
    """Sketches of two halves add up to that of the whole, and quartiles are within a cell of the exact ones."""
    counts = rules.document_counts(make_docs(corpus))
    half = lambda k: rules.sketches(counts.where(f"coalesce(doc_id, 0) % 2 = {k}"), ["lang"])
    both = rules.merged(half(0).unionByName(half(1)), ["lang"])
    whole = rules.sketches(counts, ["lang"])
    assert sorted(map(tuple, both.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    exact = sorted(r.n_words for r in counts.where(~rules.base_failed()).collect())
    got = rules.quartiles(whole, ["lang"]).first()
    for q in (25, 50, 75):
        value = next(v for i, v in enumerate(exact) if 100 * (i + 1) >= q * len(exact))
        assert value * 127 / 128 <= got[f"n_words_q{q}"] <= value
