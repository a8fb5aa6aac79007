"""Plain versions of the operators, to compare with."""

import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows with everything that is odd: nulls, empty texts, repeated rows, long texts, other scripts.
ODD = [
    (1, "a b c d e f", "en", "s1", 11), (1, "a b c d e f", "en", "s1", 11), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "a b c d e f", None, "s2", 1), (None, None, None, None, None),
    (4, " \t\n ", "en", None, 4), (5, "one", "en", "s2", 3), (6, "ONE", "en", "s2", 3), (7, "naïve café ½ 日本語 \U0001f600 <|endoftext|> it's", "xx", "ß", 9), (7, "another text under the same id", "en", "s1", 5),
    (8, "word " * 60_000, "en", "s1", 300_000), (9, "x" * 300_000, "en", "s1", 300_000), (-4, "line one\nline one\n\nline two", "en", "s1", 3), (10, "it's 's don't we'll  double  space\r\n\ttab", "en", "s1", 3),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, COLUMNS)


def clashing(df):
    """``df`` with columns named like those that operators make for themselves."""
    from pyspark.sql import functions as F

    names = ["_text_", "score", "predicted", "n_lines", "n_deleted", "is_copy", "_hash_", "_id_", "size", "target", "key", "cut", "text_hash", "sketch", "k", "bucket", "s", "whole", "h", "_text_hash", "_size"]
    return df.withColumns({n: F.lit("x") for n in names})


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text, n):
    w = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_duplicates(rows, n, percent):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, by all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(sets[i]), min(ids[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeated(rows, n):
    """For each of (key, text) in document order, the words in runs of n words that occurred before, also in the same text."""
    seen, out = set(), {}
    for k, text in rows:
        w = words(text)
        out[k] = set()
        for i in range(len(w) - n + 1):
            gram = tuple(w[i : i + n])
            if gram in seen:
                out[k].update(range(i, i + n))
            seen.add(gram)
    return out


def line_dedup(rows, least, sure, order):
    """{key: words that go} of (key, text) rows in document order; ``order`` gives each running line the hash it is ranked by."""
    width, docs, chosen = sure - least + 1, [words(t) for _, t in rows], []
    for w in docs:
        lines = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        value = [order(x) for x in lines]
        picked = {min(range(i, i + width), key=value.__getitem__) for i in range(len(lines) - width + 1)} if len(lines) >= width else {min(range(len(lines)), key=value.__getitem__)} if lines else set()
        own = []
        for p in sorted(picked):
            begin = p
            while begin and lines[begin - 1] == lines[p]:
                begin -= 1
            if (p - begin) % width == 0:
                own.append((p, lines[p]))
        chosen.append(own)
    first, gone = {}, {}
    for d, (k, _) in enumerate(rows):
        gone[k] = set()
        for p, line in chosen[d]:
            e, q = first.setdefault(line, (d, p))
            if (e, q) == (d, p):
                continue
            a, b = 0, least
            while a < width and p - a > 0 and q - a > 0 and docs[d][p - a - 1] == docs[e][q - a - 1]:
                a += 1
            while b < least + width and p + b < len(docs[d]) and q + b < len(docs[e]) and docs[d][p + b] == docs[e][q + b]:
                b += 1
            begin = max(p - a, q - a + least) if e == d else p - a
            if p + b - begin >= least:
                gone[k].update(range(begin, p + b))
    return gone
