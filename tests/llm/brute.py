"""Plain versions of the operators, and documents that are hard on them."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = [a + b for a in ("ba", "ko", "mé", "tri", "zu") for b in ("la", "n", "ßi", "r", "sto", "")]


def words(text):
    return WORD.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages and lines, odd rows, ties and repeated rows."""
    r = random.Random(seed)
    passage, line, long = prose(r, 60), prose(r, 9), prose(r, 150)
    texts = [None, "", "  \n\t ", "one", "one two three", "a " * 300, "x" * 5000, "Ünïcode " * 40, "bad### $$$ " * 30, prose(r, 3000), f"{line}\n{line}\n{line}\n{line}"]
    for k in range(n):
        t = prose(r, r.randint(1, 120))
        x = r.random()
        if x < 0.15:
            t = long
        elif x < 0.35:
            w = long.split()
            for _ in range(r.randint(1, 12)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            t = " ".join(w)
        elif x < 0.55:
            t = f"{t} {passage} {prose(r, 20)}"
        elif x < 0.75:
            t = f"{t}\n{line}\n\n{line} {k % 3}\n{prose(r, 5)}"
        texts.append(t)
    rows = [(i, t, "en", r.choice(["src0", "src0", "src1", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[0], (None, long, "en", "src0", 0), (None, None, "en", "src1", 0), (5, "other text with the id five", "en", "src9", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """With columns that are named like those that operators use and return."""
    from pyspark.sql import functions as F

    names = ["_key", "_id", "_text", "_row", "key", "batch", "n_words", "n_lines", "n_deleted", "kept", "slot", "block", "class_id", "hit_spans", "gone", "quality", "rule", "_source", "x"]
    return df.select("*", *[F.lit("clash").alias(c) for c in names])


# 2
def stats(text):
    w = words(text)
    win = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, dup = [x for x in (text or "").split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": len(w) < 20 or 100 * len(hit) > 30 * len(w)}


# 4
def dedup_lines(rows, window=2):
    """{(id, text): (kept text, deleted lines)}; rows with equal id and text are one document, null ids come first."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    sequence = {d: [(i, x) for i, x in enumerate(d[1].split("\n")) if words(x)] for d in docs}
    first, gone = {}, collections.defaultdict(set)
    for d in docs:
        s = sequence[d]
        for j in range(len(s) - window + 1):
            run = tuple(x for _, x in s[j : j + window])
            if first.setdefault(run, (d, j)) != (d, j):
                gone[d] |= {i for i, _ in s[j : j + window]}
    return {d: ("\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone[d]), len(gone[d])) for d in docs}


# 6
def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_groups(rows, threshold=0.8):
    """{id: (class id, links)} for rows with distinct ids."""
    by = collections.defaultdict(list)
    for r in rows:
        by[shingles(r[1])].append(r[0])
    sets = [s for s in by if s]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = {r[0]: (r[0], 0) for r in rows}
    group = collections.defaultdict(list)
    for k, s in enumerate(sets):
        group[find(k)] += by[s]
    for k, s in enumerate(sets):
        for i in by[s]:
            out[i] = (min(group[find(k)]), links[k])
    return out


# 8
def lm_scores(texts, corpus, order=2, backoff=0.4):
    """(words, words scored by a pair or longer that the corpus has twice, backoffs, log score) of each text."""
    count = collections.Counter()
    for t in corpus:
        w = words(t)
        count.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total, out = sum(c for g, c in count.items() if len(g) == 1), []

    def score(gram):
        if len(gram) == 1:
            return max(1, count[gram]) / max(1, total), 0, 0
        if count[gram]:
            return count[gram] / count[gram[:-1]], int(count[gram] > 1), 0
        s, hit, cut = score(gram[1:])
        return backoff * s, hit, cut + 1

    for t in texts:
        w = words(t)
        got = [score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))]
        out.append((len(w), sum(h for _, h, _ in got), sum(b for _, _, b in got), sum(math.log(s) for s, _, _ in got) if w else None))
    return out


# 9
def remove_repeats(texts, window=35):
    count = collections.Counter()
    for t in texts:
        w = words(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


# 10
def contamination(texts, items, window=13):
    """items: (id, text). (n_words, n_hit, item ids, contaminated) of each text."""
    index = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(len(w), window)
        for j in range(len(w) - k + 1 if k else 0):
            index[tuple(w[j : j + k])].add(str(i))
    sizes = sorted({len(k) for k in index})
    out = []
    for t in texts:
        w, hit, got = alnum(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := index.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    got |= found
        out.append((len(w), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(w)))
    return out
